"""Byte-level BPE by segment trees over byte positions.

A piece of text is a row of a matrix.  Its leaves are byte positions; leaf i
holds the rank of the pair (token that starts at i, next live token), or NONE.
Inner nodes hold the least rank below them; going left on ties leads to the
leftmost minimum.  One merge replaces two live neighbours by one, so three
leaves change (the pair itself, the pair before it, the swallowed position), and
each is a point update that climbs log2(width) levels.  Pieces of similar length
form one matrix, and every step of the loop advances all of them by one merge.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

NONE = np.int32(2**31 - 1)
#: Pieces that a worker keeps with their ids, and the longest piece worth keeping.
CACHE_PIECES = 150_000
CACHE_BYTES = 24
#: A piece longer than this has a tree of its own.
LONG_PIECE = 64
#: Cells of one matrix of trees.
MATRIX_CELLS = 1 << 20


class Vocabulary:
    """Ranks of byte strings, and the rank of each pair of tokens whose joined bytes have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for joined, rank in ranks.items():
            for cut in range(1, len(joined)):
                left, right = ranks.get(joined[:cut]), ranks.get(joined[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(values, dtype=np.int32)[order], NONE)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.cache: dict[str, bytes] = {}
        self._pairs: dict[tuple[int, int], int] | None = None

    @classmethod
    def from_bytes(cls, content: bytes, pattern: str) -> Vocabulary:
        lines = (line.split() for line in content.splitlines() if line)
        return cls({base64.b64decode(a): int(b) for a, b in lines}, pattern)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty piece; pieces of one call share a tree width."""
        rows = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = 1 << max(1, int(lengths.max() - 1).bit_length())
        depth = width.bit_length() - 1
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        row_of = np.repeat(np.arange(rows), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((rows, width + 1), -1, dtype=np.int64)
        ids[row_of, column] = self.byte_id[flat]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (rows, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (rows, width)).copy()
        tree = np.full((rows, 2 * width), NONE, dtype=np.int32)
        paired = (ids[:, :-1] >= 0) & (ids[:, 1:] >= 0)
        tree[:, width:][paired] = self.pair_rank(ids[:, :-1][paired], ids[:, 1:][paired])
        for d in range(depth - 1, -1, -1):
            half = tree[:, 2 << d : 4 << d]
            tree[:, 1 << d : 2 << d] = np.minimum(half[:, ::2], half[:, 1::2])

        def put(who: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + width
            tree[who, node] = rank
            for _ in range(depth):
                node = node >> 1
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            rank = tree[live, 1]
            node = np.ones(len(live), dtype=np.int64)
            for _ in range(depth):  # the leftmost leaf with that rank
                node = 2 * node
                node += tree[live, node] != rank
            at = node - width
            gone = after[live, at]
            following = after[live, gone]
            after[live, at] = following
            inside = following < width
            before[live[inside], following[inside]] = at[inside]
            ids[live, at] = rank
            ids[live, gone] = -1
            put(live, gone, NONE)
            behind = ids[live, following]
            joined = np.where(behind >= 0, self.pair_rank(ids[live, at], np.maximum(behind, 0)), NONE)
            put(live, at, joined)
            ahead = before[live, at]
            has = ahead >= 0
            if has.any():
                who, leaf = live[has], ahead[has]
                put(who, leaf, self.pair_rank(ids[who, leaf], ids[who, at[has]]))
            live = live[tree[live, 1] != NONE]
        used = ids[:, :width] >= 0
        return np.split(ids[:, :width][used], np.cumsum(used.sum(axis=1))[:-1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same tree and merges for one long piece, with plain lists."""
        n = len(piece)
        depth = (n - 1).bit_length()
        width = 1 << depth
        none = int(NONE)
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = np.full(width, NONE, dtype=np.int32)
        leaves[: n - 1] = self.pair_rank(np.array(ids[:-1]), np.array(ids[1:]))
        levels = [leaves]
        while len(levels[0]) > 1:
            levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
        tree = [none, *np.concatenate(levels).tolist()]
        known = self.pair_dict()

        def put(leaf: int, rank: int) -> None:
            node = leaf + width
            tree[node] = rank
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a <= b else b
                if tree[node] == low:
                    break
                tree[node] = low

        while (rank := tree[1]) != none:
            node = 1
            while node < width:
                node *= 2
                node += tree[node] != rank
            at = node - width
            gone = after[at]
            following = after[at] = after[gone]
            ids[at], ids[gone] = rank, -1
            put(gone, none)
            put(at, known.get((rank, ids[following]), none) if following < n else none)
            if following < n:
                before[following] = at
            ahead = before[at]
            if ahead >= 0:
                put(ahead, known.get((ids[ahead], rank), none))
        return np.array([x for x in ids if x >= 0], dtype=np.int64)

    def pair_dict(self) -> dict[tuple[int, int], int]:
        if self._pairs is None:
            keys = self.pair_keys[:-1]
            self._pairs = dict(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()), self.pair_ranks[:-1].tolist()))
        return self._pairs

    def learn(self, pieces: Iterator[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit words, of pieces that the cache lacks."""
        out, by_width = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, found in by_width.items():
            if 1 << bits > LONG_PIECE:
                out.update((piece, self.merge_long(raw).astype("<u4").tobytes()) for piece, raw in found)
                continue
            rows = max(1, MATRIX_CELLS >> bits)
            for i in range(0, len(found), rows):
                part = found[i : i + rows]
                for (piece, _), ids in zip(part, self.merge([raw for _, raw in part])):
                    out[piece] = ids.astype("<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null text has none."""
        split = [self.find(t) if t else [] for t in texts]
        cache = self.cache
        new = {p for pieces in split for p in pieces if p not in cache}
        fresh = self.learn(iter(new))
        if len(cache) + len(fresh) > CACHE_PIECES:
            kept = {p: cache[p] for pieces in split for p in pieces if p in cache}
            cache.clear()
            cache.update(kept)
        known = {**cache, **fresh} if len(cache) + len(fresh) < 4 * CACHE_PIECES else None
        if known is None:
            known = {p: cache[p] for pieces in split for p in pieces if p in cache}
            known.update(fresh)
        out = [b"".join([known[p] for p in pieces]) for pieces in split]
        room = CACHE_PIECES - len(cache)
        for p, ids in fresh.items():
            if room <= 0:
                break
            if len(p) <= CACHE_BYTES:
                cache[p] = ids
                room -= 1
        return out

    def decode(self, ids: bytes) -> bytes:
        token = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(token):
            return b""
        length = self.token_len[token]
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return self.token_bytes[inside + np.repeat(self.token_at[token], length)].tobytes()


_LOADED: dict[tuple[bytes, str], Vocabulary] = {}


def _vocabulary(content: bytes, pattern: str) -> Vocabulary:
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary.from_bytes(content, pattern)
    return _LOADED[key]


def encode_decode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ids (binary, little-endian 32-bit) and decoded (binary) to (doc_id, text).

    A null or empty text has no ids and decodes to nothing.  Rows are independent:
    repeated ids or texts change nothing; an empty table stays empty.  The rank
    file (about 1 MB) is read on the driver and sent with the task.  A text is
    encoded whole; a piece without a break, such as a megabyte of letters, takes some
    seconds and 300 bytes of memory for each of its bytes.  Other columns are not read.
    """
    import public_tokenizers

    with open(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))
    schema = "doc_id bigint, ids binary, decoded binary"

    def run(batches):
        vocabulary = _vocabulary(*shared.value)
        for batch in batches:
            ids = vocabulary.encode_batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([vocabulary.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    return common.arrow_map(docs.select("doc_id", "text"), run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of :func:`encode_decode` over whole ``documents``."""
    out = encode_decode(common.table(spark, sf_dir, "documents"))
    return out.selectExpr(
        "doc_id", "CAST(octet_length(ids) / 4 AS BIGINT) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256"
    )
