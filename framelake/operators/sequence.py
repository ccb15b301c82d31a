"""Operators over the order of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIP_RATIO = 0.4


def local_dip(df: DataFrame, series: list[str], order: list[str], value: str = "v", dip: float = DIP_RATIO, floor: float = 0.1) -> DataFrame:
    """keep and reasons per frame: under the floor, or an inner frame under dip times both neighbours; frames taken out still count as neighbours."""
    w = Window.partitionBy(*series).orderBy(*order)
    low = F.least(F.lag(value).over(w), F.lead(value).over(w))
    inner = F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()
    df = df.withColumn("__low", F.when(inner, low))
    flat = F.col(value) < floor
    dipped = ~flat & F.coalesce((F.col("__low") > 0) & (F.col(value) < dip * F.col("__low")), F.lit(False))
    reason = F.when(flat, F.lit("flat")).when(dipped, F.lit("dip"))
    return df.withColumns({"reason": reason, "keep": reason.isNull()}).drop("__low")


def brackets_auto(df: DataFrame, series: list[str], order: list[str], value: str = "v") -> DataFrame:
    """Groups that start where the value drops under half of the one before; groups of one are left out.

    A series with a missing or non-positive value is one group.
    """
    w = Window.partitionBy(*series).orderBy(*order)
    whole = Window.partitionBy(*series)
    bad = F.max((F.col(value).isNull() | (F.col(value) <= 0)).cast("int")).over(whole) == 1
    start = F.when(bad, 0).otherwise((F.col(value) < 0.5 * F.lag(value).over(w)).cast("int"))
    df = df.withColumn("__start", F.coalesce(start, F.lit(0))).withColumn("bracket", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*series, "bracket"))
    return df.withColumn("size", size).filter("size >= 2").drop("__start")


def brackets_fixed(df: DataFrame, series: list[str], order: list[str], size: int = 3) -> DataFrame:
    """Blocks of ``size`` frames; a last block of one is left out."""
    w = Window.partitionBy(*series).orderBy(*order)
    df = df.withColumn("bracket", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))
    return df.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*series, "bracket"))).filter("size >= 2")


def centred_mean(df: DataFrame, series: list[str], order: list[str], value: str = "v", least: int = 1, share: int = 8) -> DataFrame:
    """Mean of 2k + 1 values with k = max(least, n // share); the first and last value are repeated beyond the ends.

    The width depends on the series, so prefix sums are subtracted instead of a frame of fixed size.
    """
    w = Window.partitionBy(*series).orderBy(*order)
    whole = Window.partitionBy(*series)
    df = df.withColumns({"__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole), "__sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    ends = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumns({"__k": F.greatest(F.lit(least), F.floor(F.col("__n") / share)), "__a": ends[0], "__b": ends[1]})
    sums = df.select(*series, F.col("__i").alias("__j"), F.col("__sum").alias("__to"))
    hi = df.withColumn("__hi", F.least(F.col("__i") + F.col("__k"), F.col("__n"))).withColumn("__lo", F.greatest(F.col("__i") - F.col("__k") - 1, F.lit(0)))
    hi = hi.join(sums.withColumnsRenamed({"__j": "__hi", "__to": "__upper"}), [*series, "__hi"])
    hi = hi.join(sums.withColumnsRenamed({"__j": "__lo", "__to": "__lower"}), [*series, "__lo"], "left")
    inside = F.col("__upper") - F.coalesce("__lower", F.lit(0.0))
    before = F.greatest(F.col("__k") + 1 - F.col("__i"), F.lit(0)) * F.col("__a")
    after = F.greatest(F.col("__i") + F.col("__k") - F.col("__n"), F.lit(0)) * F.col("__b")
    smooth = (inside + before + after) / (2 * F.col("__k") + 1)
    return hi.withColumn("smooth", smooth).drop("__i", "__n", "__k", "__a", "__b", "__hi", "__lo", "__upper", "__lower", "__sum")


def monotone(df: DataFrame, series: list[str], order: list[str], value: str = "v") -> DataFrame:
    """Running maximum where the series ends higher than it starts, else running minimum."""
    w = Window.partitionBy(*series).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    up = F.last(value).over(whole) >= F.first(value).over(whole)
    return df.withColumn("trend", F.when(up, F.max(value).over(running)).otherwise(F.min(value).over(running)))


def interpolate_gaps(df: DataFrame, series: list[str], order: str, value: str = "v") -> DataFrame:
    """Missing values on the line between the nearest known ones; beyond the ends the nearest one."""
    w = Window.partitionBy(*series).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order)).cast("double")
    df = df.withColumns(
        {
            "__v0": F.last(value, True).over(back), "__v1": F.first(value, True).over(ahead),
            "__t0": F.last(at, True).over(back), "__t1": F.first(at, True).over(ahead),
        }
    )
    share = (F.col(order).cast("double") - F.col("__t0")) / F.nullif(F.col("__t1") - F.col("__t0"), F.lit(0.0))
    line = F.col("__v0") + share * (F.col("__v1") - F.col("__v0"))
    return df.withColumn("filled", F.coalesce(line, "__v0", "__v1")).drop("__v0", "__v1", "__t0", "__t1")


def middle(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """The middle frame of each series: number n // 2, from 0."""
    w = Window.partitionBy(*series).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*series))
    return df.withColumns({"__r": F.row_number().over(w), "__n": n}).filter("__r = floor(__n / 2) + 1").drop("__r", "__n")
