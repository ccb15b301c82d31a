"""Periodic runs of words by suffix automata.

A run is a maximal stretch of words with smallest period q (words q apart are the
same) that is long enough.  A suffix automaton is built; its states are visited
from the longest down, and each passes its ordered set of end positions to its
suffix link, the smaller set into the larger one.  A position that becomes the
neighbour of another at a distance d that does not exceed the state's length ends
a square of period d.  Neighbours of such a state never skip an occurrence, so d
is the square's smallest period; the square is extended to its run.

A stretch that counts repeats some window of ``least_state`` words at distance q
all along, so words outside windows that recur in their stretch are left out
first, by hashes (equal hashes of unlike windows only leave more in).  Automata
compare whole words.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_WORDS = 24
LEAST_TIMES = 3
#: Positions that a block of an ordered set holds before it is cut in two.
BLOCK = 1024


class SuffixAutomaton:
    """States as arrays: ``length``, ``link``, ``end`` (of the prefix a state stands for, -1 for a clone)."""

    def __init__(self, symbols: list[int]):
        length, link, end = array("q", [0]), array("q", [-1]), array("q", [-1])
        symbol, target = array("q", [-1]), array("q", [-1])  # a state's first transition; most have no other
        more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(symbols):
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            end.append(i)
            symbol.append(-1)
            target.append(-1)
            p, q = last, -1
            while p >= 0:
                if symbol[p] == c:
                    q = target[p]
                    break
                if symbol[p] < 0:
                    symbol[p], target[p] = c, new
                else:
                    others = more.setdefault(p, {})
                    q = others.get(c, -1)
                    if q >= 0:
                        break
                    others[c] = new
                p = link[p]
            if q >= 0:
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(-1)
                    symbol.append(symbol[q])
                    target.append(target[q])
                    if q in more:
                        more[clone] = dict(more[q])
                    link[q] = link[new] = clone
                    while p >= 0:
                        if symbol[p] == c:
                            if target[p] != q:
                                break
                            target[p] = clone
                        else:
                            others = more.get(p)
                            if others is None or others.get(c) != q:
                                break
                            others[c] = clone
                        p = link[p]
            last = new
        self.length, self.link, self.end = length, link, end


class Positions:
    """An ordered set of positions in blocks, so that adding one moves a bounded number of others."""

    __slots__ = ("blocks", "last", "size")

    def __init__(self, first: int):
        self.blocks, self.last, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Puts x in; returns its neighbours, -1 where there is none."""
        k = bisect_left(self.last, x)
        if k == len(self.last):
            k -= 1
            block = self.blocks[k]
            before, after = block[-1], -1
            block.append(x)
            self.last[k] = x
        else:
            block = self.blocks[k]
            at = bisect_left(block, x)
            after = block[at]
            before = block[at - 1] if at else self.last[k - 1] if k else -1
            block.insert(at, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.last.insert(k, block[half - 1])
        return before, after


def least_state(least: int, times: int) -> int:
    """A run of period q ends a square in a state of max(least - q, (times - 1) * q) words or more; the least of these."""
    return max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 2)))


def squares(symbols: list[int], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(end, period, length): the ``length`` words that end at ``end`` also end ``period`` words later, and length >= period."""
    automaton = SuffixAutomaton(symbols)
    length, link, end = automaton.length, automaton.link, automaton.end
    shortest = least_state(least, times)
    lengths = np.frombuffer(length, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], shortest) :][::-1]
    held: dict[int, Positions] = {}
    for v in order.tolist():
        mine, own, size = held.pop(v, None), end[v], length[v]
        if own >= 0:
            if mine is None:
                mine = Positions(own)
            else:
                yield from _near(mine.add(own), own, size, least, times)
        parent = link[v]
        size = length[parent]
        if size < shortest:
            continue
        other = held.get(parent)
        if other is None:
            held[parent] = mine
            continue
        if other.size < mine.size:
            mine, other = other, mine
            held[parent] = other
        for x in mine:
            yield from _near(other.add(x), x, size, least, times)


def _near(neighbours: tuple[int, int], x: int, size: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    before, after = neighbours
    if before >= 0:
        d = x - before
        if d <= size and size >= (times - 1) * d and size + d >= least:
            yield before, d, size
    if after >= 0:
        d = after - x
        if d <= size and size >= (times - 1) * d and size + d >= least:
            yield x, d, size


def _reach(same, low: int, high: int, least: int, most: int) -> tuple[int, int]:
    """The stretch [low, high) on which ``same(a, b)`` holds, extended both ways within [least, most), in doubling steps."""
    step = 64
    while low > least:
        a = max(least, low - step)
        unlike = np.flatnonzero(~same(a, low))
        if len(unlike):
            low = a + int(unlike[-1]) + 1
            break
        low, step = a, 2 * step
    step = 64
    while high < most:
        b = min(most, high + step)
        unlike = np.flatnonzero(~same(high, b))
        if len(unlike):
            high += int(unlike[0])
            break
        high, step = b, 2 * step
    return low, high


def runs_of(symbols: list[int], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers with length >= max(least, times * period), by start, then period."""
    values = np.array(symbols, dtype=np.int64)
    known: dict[int, tuple[list[int], list[int]]] = {}
    out = []
    for end, period, size in squares(symbols, least, times):
        lows, highs = known.setdefault(period, ([], []))
        k = bisect_right(lows, end)
        if k and end < highs[k - 1]:
            continue
        low, high = _reach(lambda a, b: values[a:b] == values[a + period : b + period], end - size + 1, end + 1, 0, len(values) - period)  # noqa: B023
        lows.insert(k, low)
        highs.insert(k, high)
        if high - low + period >= max(least, times * period):
            out.append((low, high - low + period, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(words: common.Words, width: int, rounds: int = 2) -> list[tuple[int, int]]:
    """Stretches of words, each within a text, outside of which no window of ``width`` words recurs in its stretch."""
    start = common.runs_in_docs(words, width)
    if not len(start):
        return []
    window = common.window_hashes(words.hashes(), width)[start]
    group = words.doc[start]
    low = high = np.zeros(0, np.int64)
    for _ in range(rounds):
        key = common.joined(window, group.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key = key[order]
        equal = key[1:] == key[:-1]
        again = np.zeros(len(key), dtype=bool)
        again[order] = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
        start, window = start[again], window[again]
        if not len(start):
            return []
        doc = words.doc[start]
        new = np.concatenate(([True], (start[1:] > start[:-1] + width) | (doc[1:] != doc[:-1])))
        group = np.cumsum(new)
        low = start[new]
        high = start[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))] + width
    return list(zip(low.tolist(), high.tolist()))


def runs_in_block(texts: list[bytes], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period; starts count its words from 0."""
    words = common.Words(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in repetitive(words, least_state(least, times)):
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(words.raw[a:b], len(number)) for a, b in zip(words.start[low:high].tolist(), words.end[low:high].tolist())]
        doc = int(words.doc[low])
        first = low - int(words.first[doc])
        out[doc].extend((first + s, n, q) for s, n, q in runs_of(symbols, least, times))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """The periodic runs of every row of ``docs`` (doc_id, text), and its text without their repeats.

    Returns doc_id, n_words, runs (array of start, length, period, in words, by
    start, then period), collapsed (string).  Words are ``[^\\x20\\x09-\\x0D]+``.  A
    run has ``least`` words and ``times`` (two at least) periods or more.  A null or empty text has
    no words, no runs and collapses to the empty string.  Rows are independent:
    repeated rows, equal or null ids change nothing, and an empty table stays
    empty.  Several runs may share words or a start; each is listed.  A text is
    worked on whole, in memory of its size, and about 150 bytes for each word
    that stands in a repetitive stretch.  Other columns are not read.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def run(batches):
        for batch in batches:
            raw = common.raw_texts(batch.column("text"))
            found: list[list[tuple[int, int, int]]] = []
            for i, j in common.blocks(raw):
                found.extend(runs_in_block(raw[i:j], least, times))
            split = [t.split() for t in raw]
            runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _RUNS)
            text = pa.array([collapsed(w, r) for w, r in zip(split, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), runs, text], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return common.arrow_map(docs.select("doc_id", "text"), run, schema)


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text, where every tenth id (by CRC-32) repeats a stretch of its words to the end.

    With h = crc32(doc_id), g = h // 10 and n words: if h % 10 = 0 and n > 0, word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    Other texts, and those of a null id, stay as they are.
    """
    import zlib

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
                words = texts[k].encode().split() if h % 10 == 0 and texts[k] else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, text string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of whole ``documents`` (with the contract's repeated tails): their number, the greatest, and digests."""
    out = collapse_runs(with_tails(common.table(spark, sf_dir, "documents")))
    # Runs come by start and period, so the first of the greatest ratio is the one asked for.
    best = F.expr("aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
