"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask of word positions; ignored positions may hold any word, so a
hit survives substitutions there.  Seed hashes of the benchmark meet those of the
documents; around each hit the item and the document are compared word by word on
that diagonal, and every best-scoring stretch (a match 1, a mismatch -2; the best, then
the best of what is left on either side) counts if it has enough matches.  An item
is found if the stretches of all its diagonals cover enough of its words, so
insertions and deletions are tolerated, too.

An item short enough to need a share of its words is also found in any window of
its length that has so many words in their places.  Its masks are all pairs of its
k + 2 parts, where k words may differ: two parts at least are then unchanged.

The benchmark is the stated query set: it is read in blocks of bounded size, each
block is broadcast and run against all rows.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MASKS = ("1110110101", "1101001011", "110110001101", "1011010000111")
#: Matches that make a stretch count, and words of an item that must be covered: so many, or this share of a short item.
LEAST_STRETCH = 6
LEAST_COVERED = 13
LEAST_SHARE = 0.8
#: An item with fewer words is too common to tell.
LEAST_ITEM = 5
#: Words of benchmark in a block.
BLOCK_WORDS = 1_000_000
_TABLE_BITS = 22
#: Seed hits that are held at once.
_BLOCK_HITS = 1_000_000


def needed(length: np.ndarray) -> np.ndarray:
    """Words to cover of items of these lengths."""
    return np.minimum(LEAST_COVERED, np.ceil(LEAST_SHARE * length)).astype(np.int64)


#: The longest item of which a share is needed.
LONGEST_SHARE = int(LEAST_COVERED / LEAST_SHARE)


def short_masks(length: int) -> list[str]:
    """Masks of a whole short item, one of which avoids any substitutions that leave enough words."""
    parts = length - int(needed(np.array([length]))[0]) + 2
    part = np.arange(length) * parts // length
    return ["".join("01"[int(p in pair)] for p in part) for pair in itertools.combinations(range(parts), 2)]


_OTHERS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain(text: str | None) -> bytes:
    """Lower case, with ASCII punctuation as space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_OTHERS) if text else b""


def seed_hashes(hashes: np.ndarray, at: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """Hash of the words at the mask's ones, for windows that start at ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    factor = common.random_words(len(mask), 40 + seed) | np.uint64(1)
    for k, x in enumerate(mask):
        if x == "1":
            out += hashes[at + k] * factor[k]
    return common.mix64(out)


class Index:
    """Seed hashes of some benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        words = common.Words([plain(t) for t in texts])
        self.hashes, self.first = words.hashes(1), words.first
        length = np.diff(self.first)
        self.need = needed(length)
        usable = length >= LEAST_ITEM
        short = [int(n) for n in np.unique(length) if LEAST_ITEM <= n <= LONGEST_SHARE]
        self.masks = [*MASKS, *(m for n in short for m in short_masks(n))]
        self.keys, self.places, self.tables = [], [], []
        for k, mask in enumerate(self.masks):
            at = common.runs_in_docs(words, len(mask))
            if k < len(MASKS):
                at = at[usable[words.doc[at]]]
            else:  # whole short items
                at = at[usable[words.doc[at]] & (length[words.doc[at]] == len(mask))]
            key = seed_hashes(self.hashes, at, mask, k)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.places.append(at[order])
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.tables.append(np.packbits(table))
        self.item_of = words.doc

    def hits(self, words: common.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct diagonals (document, item, document word less item word) with a seed hit."""
        found, held, span = [], 0, len(words) + len(self.item_of) + 1
        for k, mask in enumerate(self.masks):
            keys, places = self.keys[k], self.places[k]
            if not len(keys):
                continue
            at = common.runs_in_docs(words, len(mask))
            key = seed_hashes(hashes, at, mask, k)
            slot = (key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            maybe = np.flatnonzero(self.tables[k][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            at, key = at[maybe], key[maybe]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            total = np.cumsum(hi - lo)
            start = 0
            while start < len(at):  # repetitive texts meet repetitive items in very many places, mostly on few diagonals
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _BLOCK_HITS)))
                n = (hi - lo)[start:stop]
                p = np.repeat(at[start:stop], n)
                q = places[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)]
                start = stop
                found.append(np.unique((words.doc[p] * len(self.ids) + self.item_of[q]) * span + (p - q + len(self.item_of))))
                held += len(found[-1])
                if held > 4 * _BLOCK_HITS:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        diagonal = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        which, shift = diagonal // span, diagonal % span - len(self.item_of)
        return which // len(self.ids), which % len(self.ids), shift

    def find(self, words: common.Words) -> list[tuple[int, int, int]]:
        """(document, item, covered item words) for each item found."""
        hashes = words.hashes(1)
        covered: dict[tuple[int, int], np.ndarray] = {}
        for doc, item, shift in zip(*(x.tolist() for x in self.hits(words, hashes))):
            start, end = int(self.first[item]), int(self.first[item + 1])
            seen = covered.get((doc, item))
            if seen is None:
                seen = covered[(doc, item)] = np.zeros(end - start, dtype=bool)
            elif seen.all():
                continue
            lo, hi = max(start, int(words.first[doc]) - shift), min(end, int(words.first[doc + 1]) - shift)
            same = self.hashes[lo:hi] == hashes[shift + lo : shift + hi]
            if same.all():
                found = [(0, len(same))] if len(same) >= min(LEAST_STRETCH, self.need[item]) else []
            else:
                found = stretches(same, min(LEAST_STRETCH, self.need[item]))
            if hi - lo == end - start <= LONGEST_SHARE and same.sum() >= self.need[item]:
                found = [(0, len(same))]
            for a, b in found:
                seen[lo - start + a : lo - start + b] |= same[a:b]
        return [(d, i, int(s.sum())) for (d, i), s in covered.items() if s.sum() >= self.need[i]]


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """[a, b) with the greatest sum of 1 per match and -2 per mismatch; the first of equals."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(total)
    b = int((total - low).argmax())
    a = int(np.flatnonzero(total[: b + 1] == low[b])[-1])
    return a, b


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The best stretch and those of what is left on either side of it, each with at least so many matches."""
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if same[lo:hi].sum() >= least:
            a, b = best_stretch(same[lo:hi])
            if same[lo + a : lo + b].sum() >= least:
                out.append((lo + a, lo + b))
            todo += [(lo, lo + a), (lo + b, hi)]
    return out


def benchmark_blocks(benchmark: DataFrame, words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The items, by id, in blocks that hold so many words at most (or one longer item)."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").split())
        if ids and size + n > words:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield Index(ids, texts)


def _blocks_of(batch: pa.RecordBatch):
    texts = [plain(t) for t in batch.column("text").to_pylist()]
    for i, j in common.blocks(texts):
        yield i, common.Words(texts[i:j])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item found in it: doc_id, item_id, item_words, matched_words.

    Further columns aren't read.  Texts of any length are searched whole, with
    memory that grows with text and item, not with their product.
    Null and empty texts hold nothing, and items of fewer than LEAST_ITEM words are
    not looked for.  Repeated documents or items give a row each.  Null ids are
    given as they are.  An empty table on either side gives an empty result.
    """
    schema = "doc_id bigint, item_id bigint, item_words bigint, matched_words bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for i, words in _blocks_of(batch):
                    rows += [(ids[i + d], index.ids[k], int(index.first[k + 1] - index.first[k]), n) for d, k, n in index.find(words)]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "item_words", "matched_words"])

        found = found.union(common.arrow_map(docs.select("doc_id", "text"), run, schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item is found, with their columns unchanged."""
    for index in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, words in _blocks_of(batch):
                    keep[[i + d for d, _, _ in shared.value.find(words)]] = False
                yield batch.filter(pa.array(keep))

        docs = common.arrow_map(docs, run, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents only: clean ones have no row."""
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return overlaps(docs, items).withColumn("contaminated", F.lit(True))
