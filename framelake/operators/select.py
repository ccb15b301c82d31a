"""Selection of frames: best shares, samples, relative rules, greedy cover."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def top_share(df: DataFrame, groups: list[str], score: str, tie: str, share: float = 0.3, least: int = 1) -> DataFrame:
    """The max(least, int(n * share)) best rows of each group; equal scores by ``tie``.  share is cut to [0.01, 1]."""
    share = min(1.0, max(0.01, share))
    w = Window.partitionBy(*groups).orderBy(F.desc(score), tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*groups))
    df = df.withColumns({"place": F.row_number().over(w), "__n": n})
    return df.filter(F.col("place") <= F.greatest(F.lit(least), F.floor(F.col("__n") * share))).drop("__n")


def best_share(df: DataFrame, score: str, tie: str, share: float = 0.3) -> DataFrame:
    """As top_share over all rows, null scores last.

    Scores are numbered by range partitions (:mod:`scan`), the last one that counts is
    looked up, and the rows are filtered by it where they are: neither a sort nor a
    limit brings the share into one task.  Rows equal in score and tie stay together.
    """
    share = min(1.0, max(0.01, share))
    order = df.select(F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))).alias("__s"), F.col(tie).alias("__t"))
    placed = scan.positions(order.withColumn("__all", F.lit(0)), ["__all"], ["__s", "__t"], "__n")
    cut = placed.filter(F.col("__n") == max(1, int(df.count() * share)) - 1).first()
    if cut is None:
        return df
    key = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    within = F.col(tie).isNull() if cut["__t"] is None else F.col(tie).isNull() | (F.col(tie) <= F.lit(cut["__t"]))
    return df.filter((key < cut["__s"]) | ((key == cut["__s"]) & within))


def even_sample(df: DataFrame, series: list[str], order: list[str], sample: int = 8) -> DataFrame:
    """Rows at truncated, evenly spaced places from the first to the last, at most ``sample`` per series."""
    w = Window.partitionBy(*series).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series))
    df = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": n})
    m = F.least(F.lit(sample).cast("bigint"), F.col("__n"))
    # Place k is taken if floor(k * (n - 1) / (m - 1)) is i for some k: the least such k is ceil(i * (m - 1) / (n - 1)).
    k = F.ceil(F.col("__i") * (m - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    taken = (m <= 1) & (F.col("__i") == 0) | (m > 1) & (k <= m - 1) & (F.floor(k * (F.col("__n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("__i"))
    return df.filter(taken).drop("__i", "__n")


def every(df: DataFrame, series: list[str], order: list[str], most: int) -> DataFrame:
    """Every step-th row with step = max(1, n // most)."""
    w = Window.partitionBy(*series).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series))
    df = df.withColumns({"__i": F.row_number().over(w) - 1, "__step": F.greatest(F.lit(1), F.floor(n / most))})
    return df.filter("__i % __step = 0").drop("__i", "__step")


def select_subs(df: DataFrame, series: list[str], fwhm_factor: float = 1.5, ecc_max: float = 1.7, star_share: float = 0.5, background_factor: float = 1.6) -> DataFrame:
    """keep and reasons per frame against the medians of its series; needs fwhm, ecc, stars, bg, trail."""
    medians = df.groupBy(*series).agg(*[F.median(c).alias(f"__{c}") for c in ("fwhm", "stars", "bg")])
    df = df.join(medians, series)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("trail"), F.lit("trail")),
            F.when(F.col("fwhm") > fwhm_factor * F.col("__fwhm"), F.lit("blurred")),
            F.when(F.col("ecc") > ecc_max, F.lit("elongated")),
            F.when(F.col("stars") < star_share * F.col("__stars"), F.lit("few stars")),
            F.when(F.col("bg") > background_factor * F.col("__bg"), F.lit("bright sky")),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("keep", F.size("reasons") == 0).drop("__fwhm", "__stars", "__bg")


def distinct_points(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """One row per place, with its best score; places under 12 % of the best of all are left out."""
    best = df.groupBy(*keys).agg(F.max(score).alias("q"))
    top = best.agg(F.max("q").alias("__top"))
    return best.crossJoin(F.broadcast(top)).filter("q >= 0.12D * __top").drop("__top")  # one row


def greedy_cover(tiles: DataFrame, threshold: float = 0.8, levels=(1.0, 0.8, 0.6, 0.4)) -> DataFrame:
    """Coverage of the content tiles by the K best frames of a greedy set cover, per series.

    ``tiles`` has series_id, seq, tile, s.  A series' sharpness matrix (frames by
    tiles) is the bounded unit that one task holds; series run in parallel.
    """

    def cover(key, table):
        import numpy as np

        seq, tile = (np.unique(table.column(c).to_numpy(), return_inverse=True) for c in ("seq", "tile"))
        m = np.zeros((len(seq[0]), len(tile[0])))
        m[seq[1], tile[1]] = table.column("s").to_numpy()
        peak = m.max(axis=0)
        positive = peak[peak > 0]
        content = peak > (0.15 * np.median(positive) if len(positive) else 0.0)
        won = np.bincount(m.argmax(axis=0)[content], minlength=len(m))
        good = m[:, content] / (peak[content] + 1e-9) >= threshold
        covered, order, left = np.zeros(good.shape[1], bool), [], list(range(len(m)))
        while left and not covered.all():
            gains = (good[left] & ~covered).sum(axis=1)
            k = int(gains.argmax())
            if gains[k] <= 0:
                break
            order.append(left.pop(k))
            covered |= good[order[-1]]
        order += sorted(left, key=lambda i: -int(won[i]))
        rows = [(max(1, round(level * len(m))), level) for level in levels] if good.shape[1] else []
        return pa.table(
            {
                "series_id": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "level": pa.array([x for _, x in rows], pa.float64()),
                "frames": pa.array([k for k, _ in rows], pa.int64()),
                "coverage": pa.array([round(100.0 * float(good[order[:k]].any(axis=0).mean()), 1) for k, _ in rows], pa.float64()),
            }
        )

    return tiles.groupBy("series_id").applyInArrow(cover, "series_id bigint, level double, frames bigint, coverage double")
