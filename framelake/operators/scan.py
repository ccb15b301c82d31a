"""Ordered scans (running products) of long series, without a series in one task.

Rows are dealt by ranges of (keys, order), so a series lies in consecutive
partitions.  Each partition runs the scan over its own rows; the last value of
each partition, one row for each, is carried on at the driver; what is carried
into a partition is applied to the rows of its first series.  The operation must
be associative; it need not commute.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpointed

Operation = Callable[[np.ndarray, np.ndarray], np.ndarray]


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def multiply_matrices(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of nine doubles as 3x3 matrices, multiplied; any further numbers of a row are added up."""
    n = len(b)
    whole = np.matmul(a[:, :9].reshape(-1, 3, 3), b[:, :9].reshape(n, 3, 3)).reshape(n, 9)
    return np.concatenate((whole, a[:, 9:] + b[:, 9:]), axis=1)


def scanned(values: np.ndarray, group: np.ndarray, op: Operation) -> np.ndarray:
    """The running ``op`` inside each group of consecutive rows, in log(rows) vectorised steps."""
    out, step = values.copy(), 1
    while step < len(out):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        out[same + step] = op(out[same], out[same + step])
        step *= 2
    return out


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; nulls are alike."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def segmented_scan(df: DataFrame, keys: list[str], order: list[str], state: str, op: Operation, out: str) -> DataFrame:
    """``df`` with ``out``: ``op`` over ``state`` (array<double>, never null) of all rows of the same keys up to this one.

    Rows with equal keys and order are taken in no stated order.  Null keys are a
    series of their own.  An empty table stays empty.  Columns are kept; ``df`` may
    not have one called ``out``.
    """
    bounded_batches(df.sparkSession)
    names = {"part": "__part", "row": "__row", "first": "__first"}
    while set(names.values()) & set(df.columns):
        names = {k: f"{v}_" for k, v in names.items()}
    part, row, first = names.values()
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    def local(batches):
        number, seen, held, opening, carry = TaskContext.get().partitionId(), 0, None, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = _changes(batch, keys)
            start = tuple(batch.column(k)[0].as_py() for k in keys)
            change[0] = held is not None and start != held
            group = np.cumsum(change)
            values = scanned(_matrix(batch.column(state)), group, op)
            if carry is not None and not change[0]:
                on = np.flatnonzero(group == 0)
                values[on] = op(np.repeat(carry, len(on), axis=0), values[on])
            is_first = (group == 0) & opening & (not change[0])
            opening = bool(is_first[-1])
            held, carry = tuple(batch.column(k)[n - 1].as_py() for k in keys), values[-1:]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values.tolist(), pa.list_(pa.float64())), pa.array(np.full(n, number, dtype=np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(is_first)],
                names=[*batch.schema.names, out, part, row, first],
            )
            seen += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = checkpointed(dealt.mapInArrow(local, f"{fields}, `{out}` array<double>, `{part}` int, `{row}` bigint, `{first}` boolean"))
    name = F.struct(*[F.col(k) for k in keys])
    ends = placed.groupBy(part).agg(F.min_by(name, row).alias("low"), F.max_by(name, row).alias("high"), F.max_by(out, row).alias("last"), F.max_by(first, row).alias("one")).collect()  # a row per partition
    carried, open_key, running = {}, None, None
    for e in sorted(ends, key=lambda e: e[part]):
        last = np.array([e["last"]])
        if open_key is not None and tuple(e["low"]) == open_key:
            carried[e[part]] = running
            if e["one"]:
                last = op(running, last)
        open_key, running = tuple(e["high"]), last

    def mend(batches):
        for batch in batches:
            parts, firsts = batch.column(part).to_numpy(), batch.column(first).to_numpy(zero_copy_only=False)
            values = None
            for number in np.unique(parts[firsts]).tolist():
                if number in carried:
                    values = _matrix(batch.column(out)) if values is None else values
                    on = np.flatnonzero(firsts & (parts == number))
                    values[on] = op(np.repeat(carried[number], len(on), axis=0), values[on])
            columns = {n: batch.column(n) for n in batch.schema.names if n not in (part, row, first)}
            if values is not None:
                columns[out] = pa.array(values.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return placed.mapInArrow(mend, f"{fields}, `{out}` array<double>")


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "k") -> DataFrame:
    """``df`` with the row's number (bigint, from 0) inside its series."""
    ones = df.withColumn("__one", F.array(F.lit(1.0)))
    return segmented_scan(ones, keys, order, "__one", add, "__k").withColumn(out, (F.col("__k")[0] - 1).cast("bigint")).drop("__one", "__k")
