"""Line dedup by an exact set-similarity join.

A line is its set of lower-cased words.  Lines of LEAST_WORDS distinct words or more
are judged: a line goes if an earlier line, in order of (doc_id, line number), has a
Jaccard similarity of ``percent`` or more.

Steps
  1. Word rarity: each partition counts words in hashed counters, whose number grows
     with the text; their sums, rounded to eighths of a power of two (a byte each),
     are broadcast.  (count, hash) is a total order of words; prefix filtering needs
     no more than that, so shared counters are harmless.
  2. Classes: lines with equal sets form one class, kept by its first line.  Copies
     within a task are taken out before the shuffle, so a line that stands in a
     third of all documents costs a row per task.
  3. Prefix filter: lines with Jaccard >= t share one of the n - ceil(t n) + 1 rarest
     words.  Each class gives a posting per prefix word; words that no other line has
     give none.
  4. Per word: length filter, positional filter, and a parity signature of 128 bits,
     or up to 2048 for long lines (the symmetric difference is at least as large as
     the signatures' differing bits).
     A word with many lines is dealt to cells of bounded size in which parts of the
     list meet, and a bounded number of comparisons is held at once.
  5. Candidates are verified on the words themselves, read again from the documents:
     the likeliest of each line first, others only where these fail.
  6. First lines without an earlier match stay; all other judged lines go.

Classes and postings travel as packed batches, a row per task and part (``common.pack``),
so the shuffle moves columns and no single small rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PERCENT = 80
LEAST_WORDS = 5
#: Counters of words: 2**bits, one for about 800 bytes of text between these.  More words a counter make longer lists, not other results.
LEAST_BITS, MOST_BITS = 20, 24
BLOCK = 1 << 14
LANES = 16
#: Lines of one word that a cell holds per side, on average, and words that are dealt to several cells at most.
CELL = 2000
MOST_SPLIT = 1 << 20
#: Likeliest earlier lines that are given out for each line, and those of them that are verified first.
MANY, FEW = 16, 3
#: Bytes of files for a part of the classes, postings for a part of the join, comparisons that are held at once.
PART_BYTES = 4 << 20
PART_POSTINGS = 150_000
BLOCK_PAIRS = 250_000
#: Lines whose postings are made at once.
SLICE = 100_000
#: Lines of a task whose classes are packed together.
TASK_LINES = 100_000
#: Bits per open line or word of it in the filters of the second phase, and their greatest size (8 MB).
FILTER_SPARSITY, MOST_FILTER_BITS = 16, 26
FILTER_BLOCKS = 64
#: Packed bytes of open lines up to which they are broadcast.
MOST_OPEN = 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The judged lines of some texts: distinct words by line, each line's from the rarest on.

    ``doc``/``number`` say where line k stands, ``token[first[k]:first[k+1]]`` are the hashes of its words, ``code`` their counts.
    """

    def __init__(self, texts: list[bytes], least: int, table: np.ndarray):
        words = common.Words(texts, lower=True)
        breaks = np.flatnonzero(words.buf == 10)
        line = np.searchsorted(breaks, words.start)
        first_line = np.searchsorted(breaks, words.text_start)
        token = words.hashes(5)
        code = table[_counter(_short(token), table)]
        sortable = not len(line) or int(line[-1]) < 1 << 20
        if sortable:
            key = line.astype(np.uint64) << np.uint64(44) | code.astype(np.uint64) << np.uint64(36) | token >> np.uint64(28)
            order = np.argsort(key)
            key, sorted_token = key[order], token[order]
            sortable = not ((key[1:] == key[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any()
        if not sortable:  # a text with over a million lines, or words of a line that begin alike
            order = np.lexsort((token, code, line))
        line, token, code = line[order], token[order], code[order]
        new = np.ones(len(line), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        line, token, code = line[new], token[new], code[new]
        start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(line)))
        good = size >= least
        self.size = size[good]
        inside = np.repeat(good, size)
        self.token, self.code = token[inside], code[inside]
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        at = line[start[good]]
        self.doc = np.searchsorted(first_line, at, "right") - 1
        self.number = at - first_line[self.doc]

    def __len__(self) -> int:
        return len(self.size)

    def sums(self, salt: int) -> np.ndarray:
        return np.add.reduceat(common.mix64(self.token ^ common.random_words(1, salt)[0]), self.first[:-1])


def _short(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(32)).astype(np.uint32)


def _counter(short: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (common.mix64(short * _STEP) >> np.uint64(65 - len(table).bit_length())).astype(np.int64)


def _texts(batches, most: int = common.BLOCK_BYTES):
    """(batch, i, j, encoded texts i..j) in blocks of bounded bytes."""
    for batch in batches:
        texts = common.raw_texts(batch.column("text"))
        for i, j in common.blocks(texts, most):
            yield batch, i, j, texts[i:j]


def rarity(rows: DataFrame, text_bytes: int) -> np.ndarray:
    """floor(8 log2) of the occurrences of words per hashed counter, at most 255.  A word with a 0 stands in one line only."""
    bits = min(MOST_BITS, max(LEAST_BITS, (text_bytes // 800).bit_length()))

    def count(batches):
        total, lane = np.zeros(1 << bits, dtype=np.uint32), 0
        for _, _, _, texts in _texts(batches):
            token = common.Words(texts, lower=True).hashes(5)
            if len(token):
                at = _counter(_short(token), total)
                if bits <= 21:
                    total += np.bincount(at, minlength=1 << bits).astype(np.uint32)
                else:
                    at, n = np.unique(at, return_counts=True)
                    total[at] += n.astype(np.uint32)
                lane = int(token[0] % np.uint64(LANES))
        at = [k for k, part in enumerate(total.reshape(-1, BLOCK)) if part.any()]
        data = [zlib.compress(total[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([lane] * len(at), pa.int32()), pa.array(data, pa.binary())], names=["block", "lane", "counts"])

    def add(key, table):
        total = np.zeros(BLOCK, dtype=np.uint64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = common.arrow_map(rows.select("text"), count, "block int, lane int, counts binary")
    lanes = parts.groupBy("block", "lane").applyInArrow(add, "block int, counts binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    merged = lanes.groupBy("block").applyInArrow(add, "block int, counts binary").toArrow()  # 2**bits / BLOCK rows
    for block, raw in zip(merged.column("block").to_pylist(), merged.column("counts").to_pylist()):
        counts = np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
        out[block * BLOCK : (block + 1) * BLOCK] = np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)
    return out


#: Words from which a line has a second, wider signature, and the 64-bit words of that: it folds to the narrower ones by xor.
WIDE = ((160, 8), (640, 32))


def wide_signatures(lines: Lines) -> pa.Array:
    out = np.zeros(len(lines), dtype=object)
    out[:] = b""
    edges = [n for n, _ in WIDE] + [np.iinfo(np.int64).max]
    for (low, width), high in zip(WIDE, edges[1:]):
        at = np.flatnonzero((lines.size >= low) & (lines.size < high))
        if len(at):
            inside = np.concatenate([lines.token[lines.first[k] : lines.first[k + 1]] for k in at.tolist()])
            word = np.repeat(np.arange(len(at)), lines.size[at]) * width + (inside >> np.uint64(6) & np.uint64(width - 1)).astype(np.int64)
            total = np.zeros(len(at) * width, dtype=np.uint64)
            np.bitwise_xor.at(total, word, np.uint64(1) << (inside & np.uint64(63)))
            for k, x in zip(at.tolist(), total.reshape(-1, width)):
                out[k] = x.tobytes()
    return pa.array(out.tolist(), pa.binary())


class WideSignatures:
    """The wide signatures of some rows, each also folded to the narrower widths."""

    def __init__(self, column: pa.BinaryArray):
        values = column.to_pylist()
        raw = np.frombuffer(b"".join(values), dtype=np.uint64)
        self.width = np.array([len(x) // 8 for x in values], dtype=np.int64)
        start = np.cumsum(self.width) - self.width
        self.at, self.table = {}, {}
        for _, width in WIDE:
            rows = np.flatnonzero(self.width >= width)
            self.at[width] = np.zeros(len(self.width), dtype=np.int64)
            self.at[width][rows] = np.arange(len(rows))
            self.table[width] = np.zeros((len(rows), width), dtype=np.uint64)
            for own in np.unique(self.width[rows]).tolist():
                same = np.flatnonzero(self.width[rows] == own)
                words = raw[start[rows[same]][:, None] + np.arange(own)]
                self.table[width][same] = np.bitwise_xor.reduce(words.reshape(len(same), -1, width), axis=1)

    def difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of rows a and b at the narrower width of both; 0 where one has no wide signature."""
        out = np.zeros(len(a), dtype=np.int64)
        least = np.minimum(self.width[a], self.width[b])
        for _, width in WIDE:
            for at in np.array_split(np.flatnonzero(least == width), len(a) // 50_000 + 1):
                x, y = (self.table[width][self.at[width][side[at]]] for side in (a, b))
                out[at] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


_CLASS = ("c1", "c2", "doc_id", "number", "n", "sig1", "sig2")


def _first_of_each(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The first line of each class, and (doc_id, number) of all others."""
    c1, c2, doc, number = common.numbers(rows, "c1", "c2", "doc_id", "number")
    order = np.lexsort((number, doc, c2, c1))
    same = (c1[order][1:] == c1[order][:-1]) & (c2[order][1:] == c2[order][:-1])
    start = np.concatenate(([True], ~same))
    head = order[start][np.cumsum(start) - 1]
    copy = (doc[order] != doc[head]) | (number[order] != number[head])
    return rows.take(pa.array(np.sort(order[start]))), rows.select(["doc_id", "number"]).take(pa.array(order[copy]))


def classes(rows: DataFrame, counts, percent: int, least: int, parts: int) -> DataFrame:
    """Packed rows: firsts (the first line of each class: doc_id, number, n, signature and prefix), how many, their postings, and gone (doc_id, number of its copies)."""

    def run(batches):
        table, held, n = counts.value, [], 0
        for batch, i, j, texts in _texts(batches):
            lines = Lines(texts, least, table)
            if not len(lines):
                continue
            line = np.repeat(np.arange(len(lines)), lines.size)
            place = np.arange(len(line)) - np.repeat(lines.first[:-1], lines.size)
            prefix = lines.size - -(-percent * lines.size // 100) + 1
            used = (place < prefix[line]) & (lines.code > 0)  # words that stand nowhere else come first
            bit = np.uint64(1) << (lines.token & np.uint64(63))
            upper = (lines.token & np.uint64(64)) > 0
            signature = [np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), lines.first[:-1]) for half in (~upper, upper)]
            cut = np.concatenate(([0], np.cumsum(np.bincount(line[used], minlength=len(lines)))))
            held.append(
                pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(common.signed(lines.sums(salt))) for salt in (21, 22)],
                        pa.array(batch.column("doc_id").to_numpy()[i:j][lines.doc]),
                        pa.array(lines.number.astype(np.int32)),
                        pa.array(lines.size.astype(np.int32)),
                        *[pa.array(common.signed(x)) for x in signature],
                        wide_signatures(lines),
                        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(_short(lines.token[used]))),
                    ],
                    names=[*_CLASS, "wide", "prefix"],
                )
            )
            n += len(lines)
            if n >= TASK_LINES:
                yield from dealt(held)
                held, n = [], 0
        if held:
            yield from dealt(held)

    def dealt(held):
        firsts, copies = _first_of_each(pa.concat_batches(held))
        out = common.packed_by(firsts, common.numbers(firsts, "c1")[0].view(np.uint64) % np.uint64(parts))
        yield common.with_columns_of(out, gone=pa.nulls(out.num_rows, pa.binary()))
        if copies.num_rows:
            yield pa.RecordBatch.from_arrays([out.column("part")[:1], pa.nulls(1, pa.binary()), pa.array([common.pack(copies)], pa.binary())], names=["part", "blob", "gone"])

    def reduce(batches):
        def only_classes():
            for batch in batches:
                passed.extend(x for x in batch.column("gone").to_pylist() if x is not None)
                yield batch.filter(batch.column("blob").is_valid())

        def row(firsts, copies):
            known = firsts is not None
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([common.pack(firsts.select([*_CLASS[2:], "wide", "prefix"])) if known else None], pa.binary()),
                    pa.array([firsts.num_rows if known else 0], pa.int64()),
                    pa.array([len(firsts.column("prefix").flatten()) if known else 0], pa.int64()),
                    pa.array([copies], pa.binary()),
                ],
                names=["firsts", "n", "postings", "gone"],
            )

        passed: list[bytes] = []
        for rows in common.parts_of(only_classes()):
            firsts, copies = _first_of_each(rows)
            yield row(firsts, common.pack(copies) if copies.num_rows else None)
            while passed:
                yield row(None, passed.pop())
        while passed:
            yield row(None, passed.pop())

    found = common.arrow_map(rows, run, "part bigint, blob binary, gone binary")
    return common.arrow_map(common.dealt(found), reduce, "firsts binary, n bigint, postings bigint, gone binary")


def _unpacked(batches, column: str):
    for batch in batches:
        for raw in batch.column(column):
            if raw.is_valid:
                yield common.unpack(raw.as_py())


def gone_rows(found: DataFrame) -> DataFrame:
    """(doc_id, number) of the copies that classes() found."""
    return common.arrow_map(found.select("gone"), lambda batches: _unpacked(batches, "gone"), "doc_id bigint, number int")


def split_words(firsts: DataFrame, counts, postings: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that stand in the prefixes of more lines than a cell holds, and the parts of each.

    A cell grows once there are more than CELL * MOST_SPLIT postings, so there are
    MOST_SPLIT such words at most (12 MB).
    """
    cell = max(CELL, -(-postings // MOST_SPLIT))

    def run(batches):
        for rows in _unpacked(batches, "firsts"):
            token = rows.column("prefix").flatten().to_numpy()
            word, n = np.unique(token[counts.value[_counter(token, counts.value)] >= 8 * np.log2(cell) - 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n)], names=["token", "lines"])

    found = common.arrow_map(firsts.select("firsts"), run, "token bigint, lines bigint").groupBy("token").agg(F.sum("lines").alias("lines"))
    rows = found.filter(F.col("lines") > cell).toArrow()
    token, lines = (rows.column(c).to_numpy() for c in ("token", "lines"))
    order = np.argsort(token)
    return token[order].astype(np.uint32), -(-lines[order] // cell)


#: Bits of ``side``: which side of a cell a line is on (0: the only one), and whether it is open.
_OPEN = 4
_PAIR = "a_doc bigint, a_line int, b_doc bigint, b_line int, differ int, more boolean"


def postings_of(rows: pa.RecordBatch, is_open: np.ndarray, words_in: Bits | None, percent: int) -> pa.RecordBatch:
    """A row per prefix word of each line; with ``words_in``, for lines that aren't open, only of words that an open line of like length may have."""
    prefix = rows.column("prefix")
    size = prefix.value_lengths().to_numpy()
    line = np.repeat(np.arange(rows.num_rows), size)
    token = prefix.flatten().to_numpy()
    place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    if words_in is not None:
        keep = is_open[line] | words_in.has(_word_hash(token, _length_class(rows.column("n").to_numpy(), percent)[line]))
        line, token, place = line[keep], token[keep], place[keep]
    out = rows.select(["doc_id", "number", "n", "sig1", "sig2", "wide"]).take(pa.array(line))
    side = np.where(is_open, _OPEN, 0).astype(np.int8)[line]
    return common.with_columns_of(out, token=pa.array(token), cell=pa.array(np.zeros(len(token), np.int64)), place=pa.array(place.astype(np.int32)), side=pa.array(side))


def open_candidates(firsts: DataFrame, still: DataFrame, counts, postings: int, percent: int) -> DataFrame:
    """All pairs of first lines (earlier a, later and open b) that pass the filters.

    Open lines are few: up to a bound of bytes their postings are broadcast and meet
    those of all lines where these stand.  Beyond it, postings are shuffled as before.
    """
    filters = open_filters(firsts, still, postings, percent)
    shared = still.sparkSession.sparkContext.broadcast(filters)

    def own(batches):
        for rows in _unpacked(batches, "firsts"):
            rows = rows.filter(pa.array(shared.value[0].has(_places(rows))))
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([common.pack(postings_of(rows, np.ones(rows.num_rows, dtype=bool), None, percent))], pa.binary())], names=["blob"])

    found = common.checkpointed(common.arrow_map(firsts.select("firsts"), own, "blob binary"))
    if (found.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) > MOST_OPEN:
        return candidates(firsts, counts, postings, percent, filters)
    blobs = still.sparkSession.sparkContext.broadcast([x.as_py() for x in found.toArrow().column("blob")])

    def meet(batches):
        opened = [common.unpack(x) for x in blobs.value]
        for rows in _unpacked(batches, "firsts"):
            mine = postings_of(rows, np.zeros(rows.num_rows, dtype=bool), shared.value[1], percent)
            yield from cell_pairs(pa.concat_batches([mine, *opened]), percent, False)

    pairs = common.arrow_map(firsts.select("firsts"), meet, _PAIR)
    return pairs.select("a_doc", "a_line", "b_doc", "b_line").distinct()


def candidates(firsts: DataFrame, counts, postings: int, percent: int, opened: tuple | None = None) -> DataFrame:
    """Pairs of first lines (earlier a, later b) that pass the length, positional and signature filters for some prefix word.

    Of each b, the MANY pairs whose signatures differ least with their rank, and
    ``more``: whether others were left out.  With ``opened``, bit filters of lines and of their words,
    all pairs whose b passes the first.
    """
    context = firsts.sparkSession.sparkContext
    split = context.broadcast(split_words(firsts, counts, postings))
    filters = context.broadcast(opened)
    parts = max(8, -(-postings // PART_POSTINGS))

    def emit(batches):
        words, cells = split.value
        for rows in (whole.slice(k, SLICE) for whole in _unpacked(batches, "firsts") for k in range(0, whole.num_rows, SLICE)):
            is_open = np.zeros(rows.num_rows, dtype=bool) if opened is None else filters.value[0].has(_places(rows))
            out = postings_of(rows, is_open, None if opened is None else filters.value[1], percent)
            token, place_hash = out.column("token").to_numpy(), _places(out)
            if len(words):
                at = np.minimum(np.searchsorted(words, token), len(words) - 1)
                n = np.where(words[at] == token, cells[at], 1)
                own = np.repeat((common.mix64(place_hash) % n.astype(np.uint64)).astype(np.int64), n)
                other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out = out.take(pa.array(np.repeat(np.arange(len(token)), n)))
                side = out.column("side").to_numpy() + np.where(own == other, 0, np.where(own < other, 1, 2))
                out = common.with_columns_of(out, cell=pa.array(np.minimum(own, other) << 31 | np.maximum(own, other)), side=pa.array(side.astype(np.int8)))
            token, cell = common.numbers(out, "token", "cell")
            yield common.packed_by(out, common.mix64(token * _STEP ^ common.mix64(cell.view(np.uint64))) % np.uint64(parts))

    def run(batches):
        for rows in common.parts_of(batches):
            yield from cell_pairs(rows, percent, opened is None)

    posted = common.arrow_map(firsts.select("firsts"), emit, "part bigint, blob binary")
    pairs = common.arrow_map(common.dealt(posted), run, _PAIR)
    if opened is not None:
        return pairs.select("a_doc", "a_line", "b_doc", "b_line").distinct()
    # A line has MANY rows per part at most, so the sets are short.
    found = pairs.groupBy("b_doc", "b_line").agg(F.array_sort(F.collect_set(F.struct("differ", "a_doc", "a_line"))).alias("c"), F.max("more").alias("more"))
    found = found.select("b_doc", "b_line", (F.col("more") | (F.size("c") > MANY)).alias("more"), F.posexplode(F.slice("c", 1, MANY)).alias("rank", "a"))
    return found.select("a.a_doc", "a.a_line", "b_doc", "b_line", "rank", "more")


def cell_pairs(rows: pa.RecordBatch, percent: int, best: bool):
    """Candidates among the postings of some words and cells, BLOCK_PAIRS comparisons at once."""
    token, cell, n, place, side, doc, number, sig1, sig2 = common.numbers(rows, "token", "cell", "n", "place", "side", "doc_id", "number", "sig1", "sig2")
    order = np.lexsort((n, cell, token)) if cell.any() else np.argsort(token.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64))
    token, cell, n, place, side, doc, number, sig1, sig2 = (x[order] for x in (token, cell, n, place, side, doc, number, sig1, sig2))
    wide, rest = WideSignatures(rows.column("wide").take(pa.array(order))), n - place
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
    edges = np.flatnonzero(new)
    first = np.repeat(edges, np.diff(np.append(edges, len(new))))
    # Length filter: row k meets the rows before it in its cell whose n is at least percent of n[k].  Of those, the
    # shorter lines, only the words count that may be the first shared one: 2 * percent / (100 + percent) of n must follow.
    key = np.cumsum(new) * (1 << 32) + n
    low = np.maximum(np.searchsorted(key, key - n + -(-percent * n.astype(np.int64) // 100)), first)
    index = np.flatnonzero(place <= n + -(2 * percent * n.astype(np.int64) // (100 + percent))).astype(np.int32)
    until = np.searchsorted(index, np.arange(len(n)))
    low = np.searchsorted(index, low)
    many = until - low
    total = np.cumsum(many)
    found, start = [], 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK_PAIRS)))
        here = many[start:stop]
        b = np.repeat(np.arange(start, stop, dtype=np.int32), here)
        a = index[np.arange(len(b)) + np.repeat(low[start:stop] - (np.cumsum(here) - here), here)]
        start = stop
        # Positional filter: words from here on bound the overlap, as the words before are rarer and shared once at most.
        both = n[a] + n[b]
        ok = (np.minimum(place[a], place[b]) + np.minimum(rest[a], rest[b])) * (100 + percent) >= percent * both
        a, b, room = a[ok], b[ok], both[ok] * (100 - percent) // (100 + percent)  # greatest symmetric difference
        differ = np.bitwise_count((sig1[a] ^ sig1[b]).view(np.uint64)).astype(np.int32)
        ok = differ <= room
        a, b, room = a[ok], b[ok], room[ok]
        differ = differ[ok] + np.bitwise_count((sig2[a] ^ sig2[b]).view(np.uint64))
        ok = differ <= room
        ok &= (side[a] % _OPEN + side[b] % _OPEN) % 3 == 0  # both of the cell's only part, or of either
        a, b, differ, room = a[ok], b[ok], differ[ok], room[ok]
        closer = wide.difference(a, b)
        ok = closer <= room
        a, b, differ = a[ok], b[ok], np.maximum(differ, closer)[ok]
        other = (doc[a] != doc[b]) | (number[a] != number[b])
        a, b, differ = a[other], b[other], differ[other]
        swap = (doc[a] > doc[b]) | ((doc[a] == doc[b]) & (number[a] > number[b]))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        if not best:
            ok = side[b] >= _OPEN
            a, b, differ = a[ok], b[ok], differ[ok]
        found.append((a, b, differ))
        if sum(len(x[0]) for x in found) >= BLOCK_PAIRS:
            yield from _pairs(found, doc, number, best)
            found = []
    yield from _pairs(found, doc, number, best)


def _pairs(found: list, doc: np.ndarray, number: np.ndarray, best: bool):
    a, b, differ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    if not len(a):
        return
    ends = [doc[a], number[a], doc[b], number[b]]
    order = np.lexsort((ends[1], ends[0], differ, ends[3], ends[2]))
    ends, differ = [x[order] for x in ends], differ[order]
    same_b = np.concatenate(([False], (ends[2][1:] == ends[2][:-1]) & (ends[3][1:] == ends[3][:-1])))
    again = same_b & np.concatenate(([False], (ends[0][1:] == ends[0][:-1]) & (ends[1][1:] == ends[1][:-1])))
    ends, differ, same_b = [x[~again] for x in ends], differ[~again], same_b[~again]
    more = np.zeros(len(differ), dtype=bool)
    if best:
        start = np.flatnonzero(~same_b)
        size = np.diff(np.append(start, len(differ)))
        few = np.arange(len(differ)) - np.repeat(start, size) < MANY
        more = np.repeat(size > MANY, size)[few]
        ends, differ = [x[few] for x in ends], differ[few]
    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in ends], pa.array(differ.astype(np.int32)), pa.array(more)], names=["a_doc", "a_line", "b_doc", "b_line", "differ", "more"])


def _place_hash(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    return common.mix64(common.mix64(doc.astype(np.int64).view(np.uint64) * _STEP) + number.astype(np.uint64) * _STEP)


def _places(rows: pa.RecordBatch) -> np.ndarray:
    return _place_hash(*common.numbers(rows, "doc_id", "number"))


def _length_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Lines that may match are at most one class apart."""
    return np.floor(np.log(n) / np.log(100.5 / percent)).astype(np.int64)


def _word_hash(token: np.ndarray, length_class: np.ndarray) -> np.ndarray:
    return common.mix64(token * _STEP + length_class.astype(np.uint64))


class Bits:
    """A bit per hash; what isn't in it surely was not put in."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def has(self, value: np.ndarray) -> np.ndarray:
        at = value >> np.uint64(64 - (8 * len(self.packed)).bit_length() + 1)
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def bits_of(hashes: DataFrame, keys: int) -> Bits:
    """Bits of the column h (bigint), FILTER_SPARSITY per key up to 2**MOST_FILTER_BITS; a fuller filter lets more rows through and loses none."""
    bits = min(MOST_FILTER_BITS, max(16, (keys * FILTER_SPARSITY).bit_length()))
    size = (1 << bits) // FILTER_BLOCKS

    def mark(batches):
        table = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            table[(batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = [(k, np.packbits(x)) for k, x in enumerate(table.reshape(FILTER_BLOCKS, size)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in packed], pa.binary())], names=["block", "bits"])

    def merge(key, table):
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    marks = common.arrow_map(hashes.coalesce(64), mark, "block int, bits binary").groupBy("block").applyInArrow(merge, "block int, bits binary")
    out = np.zeros((FILTER_BLOCKS, size // 8), dtype=np.uint8)
    merged = marks.toArrow()  # FILTER_BLOCKS rows
    for block, raw in zip(merged.column("block").to_pylist(), merged.column("bits").to_pylist()):
        out[block] = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return Bits(out.ravel())


def number_lists(places: DataFrame) -> DataFrame:
    """(doc_id, numbers): the distinct numbers of each document as packed 32-bit integers, ascending."""
    found = places.groupBy("doc_id").agg(F.array_sort(F.collect_set("number")).alias("list"))

    def run(batches):
        for batch in batches:
            lists = [np.array(x, dtype=np.int32).tobytes() for x in batch.column("list").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.binary())], names=["doc_id", "numbers"])

    return common.arrow_map(found, run, "doc_id bigint, numbers binary")


def word_sets(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, number, words): the distinct lower-cased words, joined by a space, of the lines in ``places``."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for i, t, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "numbers"))):
                split = t.encode("utf-8", "surrogatepass").split(b"\n")
                for k in np.frombuffer(raw, dtype=np.int32).tolist():
                    if k < len(split):
                        for column, x in zip(out, (i, k, b" ".join(set(split[k].lower().split())))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["doc_id", "number", "words"])

    needed = common.with_lists(rows.select("doc_id", "text"), number_lists(places), "doc_id", "numbers", "inner")
    return common.arrow_map(needed, run, "doc_id bigint, number int, words binary")


def verified(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc_id, number) of the pairs that are similar on their words."""
    places = pairs.selectExpr("a_doc doc_id", "a_line number").union(pairs.selectExpr("b_doc", "b_line"))
    sets = common.checkpointed(word_sets(rows, places))
    side = lambda s: sets.select(F.col("doc_id").alias(f"{s}_doc"), F.col("number").alias(f"{s}_line"), F.col("words").alias(s))
    both = pairs.join(side("b"), ["b_doc", "b_line"]).join(side("a"), ["a_doc", "a_line"])

    def run(batches):
        for batch in batches:
            sure = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = set(a.split()), set(b.split())
                both = len(x & y)
                sure.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(sure, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("b_doc").filter(keep), batch.column("b_line").filter(keep)], names=["doc_id", "number"])

    return common.arrow_map(both.select("b_doc", "b_line", "a", "b"), run, "doc_id bigint, number int").distinct()


def open_filters(firsts: DataFrame, still: DataFrame, postings: int, percent: int) -> tuple[Bits, Bits]:
    """Bit filters of the open lines ``still``, and of the words in their prefixes with the length classes that they may match."""

    def hash_places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(_places(batch)))], names=["h"])

    lines = still.count()
    shared = still.sparkSession.sparkContext.broadcast(bits_of(common.arrow_map(still, hash_places, "h bigint"), lines))

    def hash_words(batches):
        for rows in _unpacked(batches, "firsts"):
            is_open = shared.value.has(_places(rows))
            prefix = rows.column("prefix").filter(pa.array(is_open))
            token = prefix.flatten().to_numpy()
            own = np.repeat(_length_class(rows.column("n").to_numpy()[is_open], percent), prefix.value_lengths().to_numpy())
            found = np.unique(np.concatenate([_word_hash(token, own + k) for k in (-1, 0, 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(found))], names=["h"])

    words = common.arrow_map(firsts.select("firsts"), hash_words, "h bigint")
    return shared.value, bits_of(words, min(3 * postings, 100 * lines))


def matches(rows: DataFrame, firsts: DataFrame, counts, postings: int, percent: int) -> DataFrame:
    """First lines (doc_id, number) that an earlier first line matches.

    The FEW likeliest earlier lines of each are verified first: that settles most,
    and a group of n alike lines costs FEW * n pairs.  Lines that these don't settle
    meet the others of the MANY, and only lines that have still more candidates, and
    none of these a match, meet all of them.
    """
    names = ["doc_id", "number"]
    best = common.checkpointed(candidates(firsts, counts, postings, percent))
    open_pairs = lambda pairs, gone: pairs.join(gone.toDF("b_doc", "b_line"), ["b_doc", "b_line"], "left_anti")
    gone = common.checkpointed(verified(rows, best.filter(F.col("rank") < FEW), percent))
    others = common.checkpointed(open_pairs(best.filter(F.col("rank") >= FEW), gone))
    if others.isEmpty():
        return gone
    gone = common.checkpointed(gone.union(verified(rows, others, percent)))
    still = common.checkpointed(open_pairs(others.filter("more"), gone).selectExpr("b_doc doc_id", "b_line number").distinct())
    if still.isEmpty():
        return gone
    rest = common.checkpointed(open_candidates(firsts, still, counts, postings, percent))
    return gone.union(verified(rows, rest, percent)).select(*names)


def gone_lines(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """(doc_id, numbers) of the judged lines that go."""
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    text_bytes = common.about_bytes(rows)
    counts = rows.sparkSession.sparkContext.broadcast(rarity(rows, text_bytes))
    found = common.checkpointed(classes(rows, counts, percent, least, max(8, -(-text_bytes // PART_BYTES))))
    postings = found.agg(F.sum("postings")).first()[0] or 0
    return number_lists(gone_rows(found).union(matches(rows, found, counts, postings, percent)))


def has_words(line: bytes, least: int) -> bool:
    """Whether the line has so many distinct words; mostly the first few tell."""
    return len(line) >= 2 * least - 1 and (len(set(line.lower().split(None, 2 * least)[: 2 * least])) >= least or len(set(line.lower().split())) >= least)


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, counts: bool = True, keep_emptied: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and others) with later matching lines taken out of text.

    With ``counts``, n_lines, n_judged and n_removed are added; columns so named are
    replaced.  Without, all other columns are as they were.  Further columns pass
    unchanged, whatever their names.  Without ``keep_emptied``, rows whose text loses
    its last word go.

    The text of a row that loses nothing is unchanged, as are lines of fewer than
    ``least`` distinct words.  A text that loses all lines becomes empty.  A null
    text stays null; a row with a null doc_id has no order, stays whole and removes
    nothing.  Rows that share a doc_id are one document: line k goes from all of
    them if it goes from one.  Of equal lines the first stays.  Texts of any length
    are judged whole, in blocks of 1 MB or one text.  An empty table stays empty.
    """
    added = ["n_lines", "n_judged", "n_removed"] if counts else []
    base = docs.drop(*added)
    names = base.columns
    mark = common.fresh(base, "numbers")
    gone = gone_lines(base, percent, least).withColumnRenamed("numbers", mark)
    joined = common.with_lists(base, gone, "doc_id", mark).select(*names, mark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", ".join(["", *[f"{c} bigint" for c in added]])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, out, stays = np.zeros((3, len(texts)), dtype=np.int64), list(texts), np.ones(len(texts), dtype=bool)
            for k, (t, raw) in enumerate(zip(texts, batch.column(mark).to_pylist())):
                if not t:
                    continue
                parts = t.encode("utf-8", "surrogatepass").split(b"\n") if counts or raw else []
                drop = {x for x in np.frombuffer(raw or b"", dtype=np.int32).tolist() if x < len(parts) and has_words(parts[x], least)}
                if counts:
                    n[:, k] = len(parts), sum(has_words(p, least) for p in parts), len(drop)
                if drop:
                    kept = b"\n".join([p for x, p in enumerate(parts) if x not in drop])
                    out[k], stays[k] = kept.decode("utf-8", "surrogatepass"), keep_emptied or bool(kept.split())
            new = pa.array(out, pa.string())
            rows = pa.RecordBatch.from_arrays([*[new if c == "text" else batch.column(c) for c in names], *[pa.array(x) for x in n[: len(added)]]], names=[*names, *added])
            yield rows if stays.all() else rows.filter(pa.array(stays))

    return common.arrow_map(joined, run, schema)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_judged", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
