"""Frames as rows: h, w and one array of values (row by row, channels last), so that no pixel is shuffled.

A kernel gets one frame as a NumPy array; Arrow batches are bounded by bytes, and a
task holds one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches


#: Arrow types of the columns that kernels make.
KINDS = {"array<double>": pa.list_(pa.float64()), "double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}


def image(values: pa.Scalar, h: int, w: int) -> np.ndarray:
    """h x w, or h x w x channels."""
    flat = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape((h, w) if len(flat) == h * w else (h, w, -1))


def row_map(df: DataFrame, keep: list[str], made: dict[str, str], kernel: Callable[[dict], dict], read: list[str] = ("values",)) -> DataFrame:
    """``kernel`` on every row: a dict of ``keep``, h, w and the images ``read`` in, one of the columns ``made`` (name -> type) out."""
    bounded_batches(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"`{k}` {v}" for k, v in made.items())])
    extra = [c for c in ("h", "w") if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hs, ws = batch.column("h").to_pylist(), batch.column("w").to_pylist()
            others = [c for c in batch.schema.names if c not in read]
            plain = {c: batch.column(c).to_pylist() for c in others}
            out = []
            for i, (h, w) in enumerate(zip(hs, ws)):
                row = {c: plain[c][i] for c in others}
                for c in read:
                    cell = batch.column(c)[i]
                    row[c] = image(cell, h, w) if cell.is_valid and h and w else None
                out.append(kernel(row))
            arrays = [batch.column(k) for k in keep]
            for name, kind in made.items():
                column = [o[name] for o in out]
                arrays.append(pa.array([c.ravel() if isinstance(c, np.ndarray) else c for c in column], KINDS[kind]))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    return df.select(*keep, *extra, *[c for c in read if c not in keep]).mapInArrow(run, schema)


def pixels(df: DataFrame, keys: list[str], channels: list[str], values: str = "values") -> DataFrame:
    """Array rows as pixels: keys..., y, x and a column per channel."""
    n = len(channels)
    at = F.posexplode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("__i", "__at")
    cell = df.select(*keys, "w", values, at)
    value = [F.element_at(values, F.col("__at") * n + k + 1).alias(c) for k, c in enumerate(channels)]
    return cell.select(*keys, F.expr("CAST(__at DIV w AS INT)").alias("y"), F.expr("CAST(__at % w AS INT)").alias("x"), *value)
