"""Robust combination of a series, element by element.

Every operator takes its column roles: ``keys`` name an element (series and
position), ``value`` its numbers, ``order`` their order where that matters.  All
are plain aggregates, so the values of an element are reduced before the shuffle;
clipping passes join the few statistics back instead of collecting a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KAPPA = 2.5


def average(df: DataFrame, keys: list[str], value: str = "v", weight: str | None = None) -> DataFrame:
    if weight is None:
        return df.groupBy(*keys).agg(F.avg(value).alias("value"))
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("value"))


def median(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("value"))


def lighten(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The maximum, from 0 on."""
    return df.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(0.0)).alias("value"))


def total(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))


def _band(df: DataFrame, keys: list[str], value: str, kappa: float) -> DataFrame:
    """[lo, hi] per element: kappa population deviations around the mean."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return stats.select(*keys, (F.col("__m") - kappa * F.col("__s")).alias("lo"), (F.col("__m") + kappa * F.col("__s")).alias("hi"))


def _within(df: DataFrame, band: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.join(band, keys).filter(F.col(value).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def sigma_clip(df: DataFrame, keys: list[str], value: str = "v", kappa: float = KAPPA, iterations: int = 2, weight: str | None = None) -> DataFrame:
    """Mean of the values within kappa deviations; the band is estimated anew from the kept values iterations - 1 times."""
    band = _band(df, keys, value, kappa)
    for _ in range(max(0, iterations - 1)):
        band = _band(_within(df, band, keys, value), keys, value, kappa)
    return average(_within(df, band, keys, value), keys, value, weight)


def winsorize(df: DataFrame, keys: list[str], value: str = "v", kappa: float = KAPPA, weight: str | None = None) -> DataFrame:
    """Mean of the values cut to the band."""
    cut = df.join(_band(df, keys, value, kappa), keys).withColumn(value, F.least(F.greatest(value, "lo"), F.col("hi")))
    return average(cut, keys, value, weight)


def linear_fit(df: DataFrame, keys: list[str], value: str = "v", kappa: float = KAPPA) -> DataFrame:
    """Mean of the values near a line over their rank, after two rounds of rejection.

    One window sorts an element's values; all sums run over the same partitioning,
    so the plan has a single shuffle.
    """
    element = Window.partitionBy(*keys)
    rank = F.row_number().over(element.orderBy(value)).cast("double") - 1.0
    df = df.select(*keys, F.col(value).alias("v"), rank.alias("rank"))
    df = df.withColumn("dx", F.col("rank") - F.avg("rank").over(element))
    df = df.withColumn("xv", F.sum(F.col("dx") * F.col("dx")).over(element) + 1e-9).withColumn("w", F.lit(1.0))
    for _ in range(2):
        df = df.withColumn("sw", F.greatest(F.sum("w").over(element), F.lit(1.0)))
        df = df.withColumn("ym", F.sum(F.col("v") * F.col("w")).over(element) / F.col("sw"))
        df = df.withColumn("slope", F.sum(F.col("dx") * (F.col("v") - F.col("ym")) * F.col("w")).over(element) / F.col("xv"))
        df = df.withColumn("rest", F.col("v") - (F.col("slope") * F.col("dx") + F.col("ym")))
        df = df.withColumn("sd", F.sqrt(F.sum(F.col("rest") * F.col("rest") * F.col("w")).over(element) / F.col("sw")) + 1e-9)
        df = df.withColumn("w", (F.abs("rest") <= kappa * F.col("sd")).cast("double"))
    return df.groupBy(*keys).agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("value"))


def normalize(df: DataFrame, series: list[str], frame: list[str], value: str = "v") -> DataFrame:
    """Adds to each frame the median of its series' frame medians minus its own."""
    medians = df.groupBy(*series, *frame).agg(F.median(value).alias("__med"))
    middle = medians.groupBy(*series).agg(F.median("__med").alias("__all"))
    shift = medians.join(middle, series).select(*series, *frame, (F.col("__all") - F.col("__med")).alias("__shift"))
    return df.join(shift, [*series, *frame]).withColumn(value, F.col(value) + F.col("__shift")).drop("__shift")


def background_sigma(df: DataFrame, frame: list[str], value: str = "v", least: int = 16) -> DataFrame:
    """Robust noise per frame: 1.4826 MAD of the values up to the 80th percentile (of all, if those are fewer than ``least``), at least 1e-5."""
    at = df.groupBy(*frame).agg(F.expr(f"percentile({value}, 0.8D)").alias("__cut"))
    low = df.join(at, frame)
    count = F.sum((F.col(value) <= F.col("__cut")).cast("int")).over(Window.partitionBy(*frame))
    low = low.withColumn("__n", count).filter((F.col(value) <= F.col("__cut")) | (F.col("__n") < least))
    med = low.groupBy(*frame).agg(F.median(value).alias("__med"))
    return low.join(med, frame).groupBy(*frame).agg(F.greatest(F.median(F.abs(F.col(value) - F.col("__med"))) * 1.4826, F.lit(1e-5)).alias("sigma"))


def noise_weights(df: DataFrame, series: list[str], frame: list[str], value: str = "v") -> DataFrame:
    """Inverse-variance weight per frame, 1 on average over its series."""
    sigma = background_sigma(df, [*series, *frame], value)
    raw = sigma.withColumn("w", 1.0 / (F.col("sigma") * F.col("sigma")))
    whole = Window.partitionBy(*series)
    return raw.withColumn("weight", F.col("w") * F.count(F.lit(1)).over(whole) / F.sum("w").over(whole)).select(*series, *frame, "weight")


def comet(df: DataFrame, keys: list[str], rank: str, last: str, value: str = "v", decay: float = 0.9) -> DataFrame:
    """acc = max(acc * decay, value) over the order, in closed form: the maximum of value * decay ** (steps to the end)."""
    return df.groupBy(*keys).agg(F.max(F.col(value) * F.pow(F.lit(decay), (F.col(last) - F.col(rank)).cast("double"))).alias("value"))


def bright(df: DataFrame, series: list[str], position: list[str], value: str = "v", q: float = 0.9995) -> DataFrame:
    """Sum over frames by the q-quantile of the series' sums, cut to [0, 1]."""
    sums = df.groupBy(*series, *position).agg(F.sum(value).alias("s"))
    top = sums.groupBy(*series).agg(F.expr(f"percentile(s, {q}D)").alias("top"))
    return sums.join(top, series).select(*series, *position, unit(F.col("s") / F.greatest(F.col("top"), F.lit(1e-6))).alias("value"))


def bin_image(df: DataFrame, frame: list[str], height: int, width: int, factor: int = 2, value: str = "v") -> DataFrame:
    """Block means; rows and columns beyond the last whole block are left out."""
    whole = df.filter((F.col("y") < height - height % factor) & (F.col("x") < width - width % factor))
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return whole.groupBy(*frame, block("y"), block("x")).agg(F.avg(value).alias("value"))


def calibrate(light: DataFrame, dark: DataFrame, flat: DataFrame, keys: list[str]) -> DataFrame:
    """(light - dark) / max(flat / mean flat, 0.2), from 0 on; dark and flat hold ``value`` per position."""
    mean = flat.agg(F.avg("value").alias("__mean"))
    gain = flat.crossJoin(F.broadcast(mean)).select(*keys, F.greatest(F.col("value") / F.col("__mean"), F.lit(0.2)).alias("__gain"))  # one row
    dark = dark.select(*keys, F.col("value").alias("__dark"))
    joined = light.join(dark, keys).join(gain, keys)
    return joined.withColumn("value", F.greatest((F.col("v") - F.col("__dark")) / F.col("__gain"), F.lit(0.0))).drop("v", "__dark", "__gain")


def unit(x: Column) -> Column:
    """Cut to [0, 1]."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def combine(df: DataFrame, keys: list[str], method: str, value: str = "v", **options) -> DataFrame:
    """The method by its name."""
    methods = {"average": average, "median": median, "max": lighten, "sum": total, "sigma": sigma_clip, "winsor": winsorize, "linearfit": linear_fit}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}; known: {sorted(methods)}")
    return methods[method](df, keys, value, **options)
