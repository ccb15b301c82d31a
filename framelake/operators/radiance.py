"""The response curve of a camera from exposures of one scene, and radiance by it.

g(z), the log exposure at level z, minimises the weighted squares of
g(z) - ln E - ln t over all pixels and exposures, plus a weighted roughness.  The
pixels' unknown ln E drop out of the normal equations one by one, so these are
sums over pixels with a cell per pair of levels: a plain aggregate, whose result
for a series (levels squared numbers) is solved in one small task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of the curve's roughness.
SMOOTH = 10.0


def level_weight(level, levels: int):
    """Trust in a level: the distance to the nearer end of the range, plus one."""
    return F.least(level, F.lit(levels - 1) - level) + F.lit(1.0)


def normal_equations(px: DataFrame, series: list[str], pixel: list[str], levels: int = 256) -> DataFrame:
    """series..., z, z2, a: the matrix cells (z2 >= 0), and the right side (z2 = -1).

    ``px``: series..., pixel..., z (level, 0 to levels - 1), t (exposure, above 0).  All
    pixels count.  A pixel's exposures are first added up by level, so it makes
    levels squared rows at most, however many exposures it has.
    """
    squared = F.pow(level_weight(F.col("z"), levels), F.lit(2.0))
    by_level = px.groupBy(*series, *pixel, "z").agg(F.sum(squared).alias("d"), F.sum(squared * F.log("t")).alias("dt"))
    by_pixel = by_level.groupBy(*series, *pixel).agg(F.collect_list(F.struct("z", "d", "dt")).alias("of"), F.sum("d").alias("s"), F.sum("dt").alias("q"))
    cells = by_pixel.select(*series, "of", "s", "q", F.explode("of").alias("one"))
    other = F.transform("of", lambda o: F.struct(o["z"].alias("z2"), (F.when(o["z"] == F.col("one.z"), F.col("one.d")).otherwise(0.0) - F.col("one.d") * o["d"] / F.col("s")).alias("a")))
    right = F.array(F.struct(F.lit(-1).alias("z2"), (F.col("one.dt") - F.col("one.d") * F.col("q") / F.col("s")).alias("a")))
    pairs = cells.select(*series, F.col("one.z").alias("z"), F.explode(F.concat(other, right)).alias("cell"))
    return pairs.groupBy(*series, "z", F.col("cell.z2").alias("z2")).agg(F.sum("cell.a").alias("a"))


def solved(z: np.ndarray, z2: np.ndarray, a: np.ndarray, levels: int, smooth: float = SMOOTH) -> np.ndarray:
    """The curve that solves the equations, 0 in the middle of the range."""
    matrix, right = np.zeros((levels, levels)), np.zeros(levels)
    inside = z2 >= 0
    matrix[z[inside], z2[inside]] = a[inside]
    right[z[~inside]] = a[~inside]
    middle = np.arange(1, levels - 1)
    bend = np.zeros((levels - 2, levels))
    bend[middle - 1, middle - 1], bend[middle - 1, middle], bend[middle - 1, middle + 1] = 1, -2, 1
    bend *= (smooth * (np.minimum(middle, levels - 1 - middle) + 1))[:, None]
    matrix += bend.T @ bend
    matrix[levels // 2, levels // 2] += 1.0
    return np.linalg.lstsq(matrix, right, rcond=None)[0]


def response_curve(px: DataFrame, series: list[str], pixel: list[str], levels: int = 256, smooth: float = SMOOTH) -> DataFrame:
    """series..., z, g for every level of each series; g is 0 at levels // 2 and grows by ln 2 when exposure doubles.

    Levels that no pixel has follow from smoothness.  One exposure time alone tells
    nothing about the curve: what comes back is then the smoothest one.  An empty
    table has no curve.
    """
    if levels < 4:
        raise ValueError("a curve needs four levels at least")
    kinds = {f.name: f.dataType.simpleString() for f in px.schema}
    schema = ", ".join(f"`{s}` {kinds[s]}" for s in series) + ", z int, g double"

    def solve(key, pdf):
        import pandas as pd

        g = solved(pdf["z"].to_numpy(), pdf["z2"].to_numpy(), pdf["a"].to_numpy(), levels, smooth)
        return pd.DataFrame({s: [k] * levels for s, k in zip(series, key)} | {"z": np.arange(levels, dtype="int32"), "g": g})

    return normal_equations(px, series, pixel, levels).groupBy(*series).applyInPandas(solve, schema)


def radiance(px: DataFrame, curve: DataFrame, series: list[str], pixel: list[str], levels: int = 256) -> DataFrame:
    """series..., pixel..., value: the weighted mean of g(z) - ln t over a pixel's exposures, as a number again."""
    w = level_weight(F.col("z"), levels)
    both = px.join(curve.select(*series, "z", "g"), [*series, "z"])
    return both.groupBy(*series, *pixel).agg(F.exp(F.sum(w * (F.col("g") - F.log("t"))) / F.sum(w)).alias("value"))
