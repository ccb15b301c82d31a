"""Shared ground of the text operators: Arrow batches, words, hashes, Spark helpers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  All hashing runs
over whole blocks of texts with NumPy, never word by word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpointed  # noqa: F401  (the operators take it from here)

U64 = np.uint64
#: Bytes of per-document lists up to which they are broadcast.
MOST_BROADCAST = 32 << 20
#: Bytes of text that one block of vectorised work holds (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20
#: Lanes of eight bytes that are hashed one after the other; a longer word's others are hashed by place.
CHAIN = 8

_SPACE = bytes(int(c in b"\t\n\x0b\x0c\r ") for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Memory that is free to the system: Python workers stay, and the next task may run in others."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes; a task gives its memory back."""
    bounded_batches(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def pack(batch: pa.RecordBatch) -> bytes:
    """A batch as one value of a row: many small rows travel as few, column by column and compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def packed_by(batch: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    """Rows (part, blob): the batch cut by ``part``, in ascending order of it."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    rows = batch.take(pa.array(order))
    blobs = [pack(rows.slice(a, b - a)) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def dealt(parts: DataFrame) -> DataFrame:
    """Rows (part, blob) with those of a part side by side."""
    return parts.repartition("part").sortWithinPartitions("part")


def parts_of(batches: Iterator[pa.RecordBatch], with_part: bool = False) -> Iterator:
    """All packed rows of one part after the other, or (part, rows)."""
    part, held = None, []

    def rows():
        whole = pa.concat_batches(held)
        held.clear()  # so that only one copy stays while the caller works
        return (part, whole) if with_part else whole

    for batch in batches:
        for p, raw in zip(batch.column("part").to_pylist(), batch.column("blob")):
            if p != part and held:
                yield rows()
            part = p
            held.append(unpack(raw.as_py()))
    if held:
        yield rows()


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def with_lists(docs: DataFrame, lists: DataFrame, key: str, column: str, how: str = "left", most: int | None = None) -> DataFrame:
    """``docs`` with ``column`` (binary, a value per ``key``) of ``lists``.

    ``lists`` is small against the texts.  If all of it takes MOST_BROADCAST bytes at
    most, it is broadcast and the texts stay where they are; beyond that the join
    is shuffled, with the same result.
    """
    lists = checkpointed(lists)
    size = lists.agg(F.sum(F.octet_length(column)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    small = (size["bytes"] or 0) + 64 * size["rows"] <= (MOST_BROADCAST if most is None else most)
    return docs.join(F.broadcast(lists) if small else lists.hint("merge"), key, how)


def bytes_of(texts: DataFrame) -> int:
    """The bytes of the column text."""
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def about_bytes(texts: DataFrame) -> int:
    """Bytes of the files behind the column text, as Catalyst guesses them (texts may take several times that), or else a count."""
    known = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else bytes_of(texts)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Batches of numbers joined to larger ones, which vectorised work likes better."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def roughly_in(rows: DataFrame, key: str, needed: DataFrame, needed_key: str, words: int = 1 << 17) -> DataFrame:
    """Rows whose key is in ``needed``, and a few others: a bit filter ahead of an exact join.

    The filter has ``words`` rows of 64 bits at most, whatever the input (2 MB), so
    it is broadcast.  A full filter lets all rows through and loses none.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(words))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST(pmod(shiftright(xxhash64(`{c}`), 20), 64) AS INT))")
    bits = needed.select(word(needed_key).alias("__w"), bit(needed_key).alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__bits"))
    found = rows.withColumn("__w", word(key)).join(F.broadcast(bits), "__w")
    return found.filter(F.col("__bits").bitwiseAND(bit(key)) != 0).drop("__w", "__bits")


def null_safe_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a column of texts; a null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def encode_all(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts with about ``most`` bytes together."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    t = y >> U64(27)
    y ^= t
    y *= U64(0x94D049BB133111EB)
    t = y >> U64(31)
    y ^= t
    return y


def random_words(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_LIBC = ctypes.CDLL(None)
_STEP = U64(0x9E3779B97F4A7C15)
#: The first k bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


class Words:
    """The words of several texts: where they are, and 64-bit hashes of them.

    ``start``/``end`` are byte positions in ``buf``; ``doc`` is the index of a
    word's text; ``first[d]:first[d+1]`` are the words of text d.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n_docs = len(texts)
        raw = b"\n".join([*texts, b""])
        if lower:
            raw = raw.lower()
        self.raw = raw
        self.buf = np.frombuffer(raw, dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_end = np.cumsum(lengths) if texts else np.zeros(0, np.int64)
        self.text_start = self.text_end - lengths
        space = np.frombuffer(b"\x01" + raw.translate(_SPACE) + b"\x01", dtype=np.uint8)
        edge = np.flatnonzero(space[1:] != space[:-1])  # in turn, where a word starts and ends
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate((self.text_start, [len(raw)])))
        self.counts = np.diff(self.first) if self.n_docs else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, seed)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span.

    Every eight bytes go through a full mix that depends on what stands before them
    (or, from CHAIN lanes on, on their place), so there is no sum of powers in which
    terms of unlike words could cancel out.
    """
    if not len(start):
        return np.zeros(0, dtype=U64)
    key, later = random_words(2, seed)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    out = mix64((lanes[start] & _MASKS[np.minimum(length, 8)]) ^ key)
    at, lane = np.flatnonzero(length > 8), 1
    while len(at) and lane < CHAIN:
        rest = length[at] - 8 * lane
        value = lanes[start[at] + 8 * lane] & _MASKS[np.minimum(rest, 8)]
        out[at] = mix64((out[at] ^ value) * (later | U64(1)) + key)
        at, lane = at[rest > 8], lane + 1
    if len(at):  # long words: their other lanes, each mixed with its place
        count = (length[at] + 7) // 8 - CHAIN
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + CHAIN
        byte = np.repeat(start[at], count) + 8 * place
        value = lanes[byte] & _MASKS[np.minimum(np.repeat(end[at], count) - byte, 8)]
        mixed = mix64(mix64(value ^ later) + mix64(place.astype(U64) ^ key))
        out[at] = mix64(out[at] ^ np.add.reduceat(mixed, np.cumsum(count) - count))
    return mix64(out + length.astype(U64) * _STEP)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of a followed by b, from theirs; the order counts."""
    x = a >> U64(29)
    x ^= a
    x *= U64(0xBF58476D1CE4E5B9)
    x += b
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x


def window_hashes(values: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values (len - width + 1 of them), joined by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    have, size, done, out = values ^ random_words(1, seed + 2000)[0], 1, 0, None
    while True:
        if width & size:
            part = have[done : done + n]
            out = part if out is None else joined(out, part)
            done += size
        if done == width:
            return mix64(out)
        have = joined(have[:-size], have[size:])
        size *= 2


def range_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hashes of values[lo:hi] for ranges that follow each other without overlap, none of them empty."""
    if not len(lo):
        return np.zeros(0, dtype=U64)
    key = random_words(1, seed + 3000)[0]
    length = hi - lo
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    mixed = mix64((values[np.repeat(lo, length) + place] ^ key) + place.astype(U64) * _STEP)
    return mix64(np.add.reduceat(mixed, np.cumsum(length) - length) + length.astype(U64))


def runs_in_docs(words: Words, width: int) -> np.ndarray:
    """Indices i of words such that i .. i+width-1 lie in one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def with_columns_of(batch: pa.RecordBatch, **new) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, value in new.items():
        if name in names:
            arrays[names.index(name)] = value
        else:
            names.append(name)
            arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, names=names)
