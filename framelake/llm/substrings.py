"""Removal of passages that an earlier document holds, with a count-min prefilter.

A window is ``width`` consecutive words.  Three steps decide all windows:

1. Chunks.  Content-defined boundaries cut a text at the same words wherever a
   passage stands.  Two neighbouring chunks form a pair, and every window lies in
   at least one pair.  Pairs are grouped by 128-bit hashes; a pair that a smaller
   doc_id holds settles all its windows.  Whole copies end here, with about one
   row per 100 words.  The smallest document that holds a window always keeps it
   unsettled, so nothing is lost for others.
2. Count-min prefilter.  Each partition sketches its unsettled windows; the sketches
   hold used cells only, are merged by ranges of cells, and grow with the input (16
   cells a key and row).  The sum never is below a key's true count.  A window has
   two keys, the least hash among the shingles (a third of a window long) of either
   half of it: equal windows share both, and neighbouring windows mostly do, too.
   So a window's count is bounded from above by those of its keys, which are what the
   sketch counts; it is not estimated itself.
3. Exact grouping, by 128-bit hashes, of windows whose keys both are estimated at two
   documents or more.

Texts are read where they stand; what the steps find goes back to them as lists per
document (``common.with_lists``), and so do the cells that were hit twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 50
#: A window is so many shingles long.
SHINGLES = 3
BOUNDARY = 4
#: Rows of the sketch, cells of a row per key, and cells of a part when sketches are merged.
DEPTH = 2
SPARSITY = 16
PART_CELLS = 1_000_000
#: Cells of a task that are held before they are given out.
TASK_CELLS = 2_000_000
#: Bytes of cells hit twice up to which they are broadcast.
MOST_BROADCAST = common.MOST_BROADCAST
_TOP = np.uint64(2**64 - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values (len - width + 1 of them)."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])
    return out


def boundaries(words: common.Words, hashes: np.ndarray, radius: int) -> np.ndarray:
    """Ascending word indices that start a chunk, without those that start a text.

    A word starts a chunk if the hash of the next BOUNDARY words is below those at
    the ``radius`` words before and not above those at the ``radius`` words after,
    all in one text.  Two boundaries of a text are more than ``radius`` apart.
    """
    at = common.runs_in_docs(words, BOUNDARY)
    if not len(at):
        return at
    place = at + words.doc[at] * radius + radius
    padded = np.full(len(words) + (words.n_docs + 1) * radius + radius, _TOP)
    padded[place] = common.window_hashes(hashes, BOUNDARY)[at]
    least = sliding_min(padded, radius)
    value = padded[place]
    found = at[(value < least[place - radius]) & (value <= least[place + 1])]
    return found[found != words.first[words.doc[found]]]


def chunk_pairs(words: common.Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges [lo, hi) of two neighbouring chunks (or the only one), if a window fits in; and where all chunks start."""
    starts = np.union1d(boundaries(words, hashes, width), words.first[:-1][words.counts > 0])
    if not len(starts):
        return starts, starts, starts
    doc = words.doc[starts]
    text_end = words.first[doc + 1]
    second = np.append(starts[1:], len(words))
    third = np.append(second[1:], len(words))
    hi = np.minimum(third, text_end)
    only = (np.append(doc[1:], -1) != doc) & (starts != words.first[doc])  # a last chunk is in the pair before it
    good = (hi - starts >= width) & ~only
    return starts[good], hi[good], starts


def pair_hashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words of chunk pairs: each chunk's own, joined."""
    cuts = np.append(starts, len(hashes))
    chunk = common.range_hashes(hashes, cuts[:-1], cuts[1:], seed)
    first, last = np.searchsorted(cuts, lo), np.searchsorted(cuts, hi) - 1
    return common.mix64(common.joined(chunk[first], np.where(last > first, chunk[last], np.uint64(0))) + (hi - lo).astype(np.uint64))


def keys_in(text_bytes: int) -> int:
    """About the sketch keys of a text: some 6 bytes a word, a key per 9 words."""
    return text_bytes // (6 * 9)


def cell_bits(text_bytes: int) -> int:
    """Bits of a cell."""
    return max(16, (SPARSITY * keys_in(text_bytes)).bit_length())


class Windows:
    """The unsettled windows of a block of texts; ranges: packed [lo, hi) of settled words, or None."""

    def __init__(self, texts: list[bytes], ranges: list, width: int):
        self.width, self.words = width, common.Words(texts)
        self.hashes = self.words.hashes(1)
        at = common.runs_in_docs(self.words, width)
        reach = np.zeros(len(self.words) + 1, dtype=np.int64)
        for k, raw in enumerate(ranges):
            if raw:
                lo, hi = np.frombuffer(raw, dtype=np.int32).reshape(-1, 2).T + self.words.first[k]
                np.maximum.at(reach, lo, hi)
        reach = np.maximum.accumulate(reach)
        self.at = at[reach[at] < at + width]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The two sketch keys of each unsettled window."""
        shingle = max(1, self.width // SHINGLES)
        half = (self.width - shingle + 2) // 2
        least = sliding_min(common.window_hashes(self.hashes, shingle), half)
        return least[self.at], least[self.at + self.width - shingle + 1 - half]


def document_keys(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, sketch key) of the unsettled windows."""
    found, doc = [], w.words.doc[w.at]
    for keys in w.keys():
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        found.append((doc[new], keys[new]))
    doc, keys = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], keys[new]


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each key in each row, (DEPTH, keys); row r has the cells from r << bits on."""
    salt = np.uint64(0x632BE59BD9B4E019)
    return np.stack([common.mix64(keys + salt * np.uint64(r + 1)) >> np.uint64(64 - bits) | np.uint64(r << bits) for r in range(DEPTH)])


def blocks_of(batches, width: int):
    """(batch, i, j, windows) for texts with their settled ranges."""
    for batch in batches:
        texts, ranges = common.raw_texts(batch.column("text")), batch.column("ranges").to_pylist()
        for i, j in common.blocks(texts):
            yield batch, i, j, Windows(texts[i:j], ranges[i:j], width)


def cells_hit_twice(judged: DataFrame, width: int, bits: int, keys: int) -> DataFrame:
    """(n, cells): cells, as packed ascending 64-bit integers, in which two documents or more have a key."""
    parts = max(8, -(-DEPTH * keys // PART_CELLS))
    size = -(-(DEPTH << bits) // parts)

    def sketch(batches):
        held, n = [], 0
        for _, _, _, w in blocks_of(batches, width):
            held.append(cells_of(document_keys(w)[1], bits).ravel())
            n += len(held[-1])
            if n >= TASK_CELLS:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    def counted(held):
        cell, hits = np.unique(np.concatenate(held), return_counts=True)
        part = cell // np.uint64(size)
        rows = pa.RecordBatch.from_arrays([pa.array(cell - part * np.uint64(size)), pa.array(np.minimum(hits, 2).astype(np.int8))], names=["cell", "hits"])
        return common.packed_by(rows, part)

    def merge(batches):
        for part, rows in common.parts_of(batches, with_part=True):
            cell, hits = common.numbers(rows, "cell", "hits")
            order = np.argsort(cell)
            cell = cell[order]
            start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            twice = cell[start][np.add.reduceat(hits[order].astype(np.int64), start) >= 2] + np.uint64(part * size)
            yield pa.RecordBatch.from_arrays([pa.array([len(twice)], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["n", "cells"])

    found = common.arrow_map(judged, sketch, "part bigint, blob binary")
    return common.checkpointed(common.arrow_map(common.dealt(found), merge, "n bigint, cells binary"))


def with_repeated_keys(judged: DataFrame, twice: DataFrame, width: int, bits: int) -> DataFrame:
    """``judged`` with keys: the packed, ascending sketch keys of each text whose cells all were hit twice.

    For more cells than may be broadcast: keys meet them in shuffled joins.
    """

    def emit(batches):
        for batch, i, j, w in blocks_of(batches, width):
            doc, keys = document_keys(w)
            columns = [pa.array(batch.column("tkey").to_numpy()[i:j][doc]), pa.array(common.signed(keys)), *[pa.array(common.signed(c)) for c in cells_of(keys, bits)]]
            yield pa.RecordBatch.from_arrays(columns, names=["tkey", "key", *[f"c{r}" for r in range(DEPTH)]])

    def each(batches):
        for batch in batches:
            for raw in batch.column("cells").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, dtype=np.int64))], names=["cell"])

    def pack(batches):
        for batch in batches:
            lists = [np.sort(np.array(x, dtype=np.int64).view(np.uint64)).tobytes() for x in batch.column("list").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(lists, pa.binary())], names=["tkey", "keys"])

    keyed = common.arrow_map(judged, emit, "tkey bigint, key bigint, " + ", ".join(f"c{r} bigint" for r in range(DEPTH)))
    cells = common.checkpointed(common.arrow_map(twice.select("cells"), each, "cell bigint"))
    for r in range(DEPTH):
        keyed = keyed.join(cells.withColumnRenamed("cell", f"c{r}"), f"c{r}", "left_semi")
    lists = common.arrow_map(keyed.groupBy("tkey").agg(F.collect_set("key").alias("list")), pack, "tkey bigint, keys binary")
    return common.with_lists(judged, lists, "tkey", "keys", "inner")


def among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def span_lists(spans: DataFrame, column: str) -> DataFrame:
    """(tkey, column): the spans (lo, hi) of each text, merged and ascending, as packed 32-bit pairs."""
    found = spans.groupBy("tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("list"))

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("list").to_pylist():
                x = np.array([(r["lo"], r["hi"]) for r in x], dtype=np.int32).reshape(-1, 2)
                x = x[np.argsort(x[:, 0], kind="stable")]
                reach = np.maximum.accumulate(x[:, 1])
                start = np.concatenate(([True], x[1:, 0] > reach[:-1]))
                out.append(np.stack((x[start, 0], reach[np.append(np.flatnonzero(start)[1:], len(x)) - 1]), axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(out, pa.binary())], names=["tkey", column])

    return common.arrow_map(found, run, f"tkey bigint, {column} binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the words that an earlier document repeats.

    Returns doc_id, n_words, n_removed, kept (the remaining words joined by one
    space) and spans (removed [lo, hi) word ranges).  A word goes if a window that
    covers it also starts in a document with a smaller doc_id; windows are judged on
    the input.  A null text has no words.  A null doc_id has no order: such rows stay
    whole and remove nothing.  Rows with the same doc_id don't remove from each
    other, and repeated rows get equal results.  Texts of any length are judged
    whole, in blocks of 1 MB or one text.  Further columns of ``docs`` aren't read.
    An empty table stays empty.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tkey"))
    usable = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def emit_pairs(batches):
        for batch in batches:
            texts = common.raw_texts(batch.column("text"))
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("tkey").to_numpy()
            for i, j in common.blocks(texts):
                words = common.Words(texts[i:j])
                hashes = words.hashes(1)
                lo, hi, starts = chunk_pairs(words, hashes, width)
                doc = words.doc[lo]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(common.signed(pair_hashes(hashes, lo, hi, starts, 1))),
                        pa.array(common.signed(pair_hashes(words.hashes(2), lo, hi, starts, 2))),
                        pa.array(ids[i:j][doc].astype(np.int64)),
                        pa.array(keys[i:j][doc]),
                        pa.array((lo - words.first[doc]).astype(np.int32)),
                        pa.array((hi - words.first[doc]).astype(np.int32)),
                    ],
                    names=["k1", "k2", "doc_id", "tkey", "lo", "hi"],
                )

    spans = "k1 bigint, k2 bigint, doc_id bigint, tkey bigint, lo int, hi int"
    settled = common.checkpointed(later_copies(common.checkpointed(common.arrow_map(usable, emit_pairs, spans))))
    judged = common.with_lists(usable, span_lists(settled, "ranges"), "tkey", "ranges")

    text_bytes = common.bytes_of(usable)
    bits = cell_bits(text_bytes)
    twice = cells_hit_twice(judged, width, bits, keys_in(text_bytes))
    n_cells = twice.agg(F.sum("n")).first()[0] or 0
    shared = None
    if 8 * n_cells <= MOST_BROADCAST:
        raw = [x.as_py() for x in twice.select("cells").toArrow().column("cells")]
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(raw), dtype=np.uint64)))
    else:
        judged = with_repeated_keys(judged, twice, width, bits)

    def emit_windows(batches):
        for batch, i, j, w in blocks_of(batches, width):
            keep = np.ones(len(w.at), dtype=bool)
            for keys in w.keys():
                if shared is not None:
                    unique, place = np.unique(keys, return_inverse=True)
                    keep &= np.logical_and.reduce([among(shared.value, c) for c in cells_of(unique, bits)])[place]
                else:
                    edge = np.searchsorted(w.words.doc[w.at], np.arange(j - i + 1))
                    for k, raw in enumerate(batch.column("keys").to_pylist()[i:j]):
                        keep[edge[k] : edge[k + 1]] &= among(np.frombuffer(raw, dtype=np.uint64), keys[edge[k] : edge[k + 1]])
            at = w.at[keep]
            doc = w.words.doc[at]
            start = (at - w.words.first[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(common.signed(common.window_hashes(w.hashes, width, 1)[at])),
                    pa.array(common.signed(common.window_hashes(w.words.hashes(2), width, 2)[at])) if len(at) else pa.array([], pa.int64()),
                    pa.array(batch.column("doc_id").to_numpy()[i:j][doc]),
                    pa.array(batch.column("tkey").to_numpy()[i:j][doc]),
                    pa.array(start),
                    pa.array(start + np.int32(width)),
                ],
                names=["k1", "k2", "doc_id", "tkey", "lo", "hi"],
            )

    found = later_copies(common.checkpointed(common.arrow_map(judged, emit_windows, spans))).union(settled)

    def finish(batches):
        for batch in batches:
            out = [removed(t, s) for t, s in zip(common.raw_texts(batch.column("text")), batch.column("spans").to_pylist())]
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int32()))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), columns[0], columns[1], columns[2].cast(pa.string()), columns[3]], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    rows = rows.withColumn("tkey", F.when(F.col("doc_id").isNotNull(), F.col("tkey")))
    joined = common.with_lists(rows, span_lists(found, "spans"), "tkey", "spans")
    return common.arrow_map(joined.select("doc_id", "text", "spans"), finish, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<array<int>>")


def later_copies(found: DataFrame) -> DataFrame:
    """Rows whose key (k1, k2) also stands in a smaller doc_id.  Minima are taken before the shuffle; the join back can be split where a key is frequent."""
    first = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("k1", "k2", "least")
    return found.join(first, ["k1", "k2"]).filter("doc_id > least").select("tkey", "lo", "hi")


def removed(text: bytes, spans: bytes | None) -> tuple[int, int, bytes, list[list[int]]]:
    """n_words, n_removed, what is kept, and the removed spans."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words), []
    cut = np.frombuffer(spans, dtype=np.int32).reshape(-1, 2).tolist()
    kept, at = [], 0
    for lo, hi in cut:
        kept += words[at:lo]
        at = hi
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept), cut


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
