"""Scores of frames and tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, frame: list[str], value: str = "v", height: int = 8, width: int = 8) -> DataFrame:
    """Adds up, down, left, right; beyond an edge the row or column on the inner side of the edge is mirrored (reflect, edge not repeated).

    Two windows, one per axis, both within a frame: Spark shuffles once by frame and row and once by frame and column.
    """
    along_y = Window.partitionBy(*frame, "x").orderBy("y")
    along_x = Window.partitionBy(*frame, "y").orderBy("x")
    df = df.withColumns({"__u": F.lag(value).over(along_y), "__d": F.lead(value).over(along_y)})
    df = df.withColumns({"__l": F.lag(value).over(along_x), "__r": F.lead(value).over(along_x)})
    return df.withColumns(
        {
            "up": F.coalesce("__u", "__d", value), "down": F.coalesce("__d", "__u", value),
            "left": F.coalesce("__l", "__r", value), "right": F.coalesce("__r", "__l", value),
        }
    ).drop("__u", "__d", "__l", "__r")


def laplacian(df: DataFrame, frame: list[str], value: str = "v") -> DataFrame:
    return neighbours(df, frame, value).withColumn("lap", F.col("up") + F.col("down") + F.col("left") + F.col("right") - 4.0 * F.col(value)).drop("up", "down", "left", "right")


def focus_measure(df: DataFrame, frame: list[str], value: str = "v") -> DataFrame:
    """Sum-modified Laplacian per pixel."""
    n = neighbours(df, frame, value)
    sml = F.abs(2.0 * F.col(value) - F.col("up") - F.col("down")) + F.abs(2.0 * F.col(value) - F.col("left") - F.col("right"))
    return n.withColumn("sml", sml).drop("up", "down", "left", "right")


def gradient(df: DataFrame, frame: list[str], value: str = "v") -> DataFrame:
    """Magnitude of central differences."""
    n = neighbours(df, frame, value)
    return n.withColumn("grad", F.hypot((F.col("right") - F.col("left")) / 2.0, (F.col("down") - F.col("up")) / 2.0)).drop("up", "down", "left", "right")


def extreme(df: DataFrame, frame: list[str], value: str = "v", largest: bool = True, radius: int = 1) -> DataFrame:
    """Dilation (or erosion) by a square as two passes of a window, one per axis."""
    pick = F.max if largest else F.min
    along_y = Window.partitionBy(*frame, "x").orderBy("y").rowsBetween(-radius, radius)
    along_x = Window.partitionBy(*frame, "y").orderBy("x").rowsBetween(-radius, radius)
    return df.withColumn("__m", pick(value).over(along_y)).withColumn("extreme", pick("__m").over(along_x)).drop("__m")


def box_mean(df: DataFrame, frame: list[str], value: str = "v", radius: int = 1) -> DataFrame:
    """Mean over the (2 radius + 1) square inside the frame, by sums and counts per axis."""
    along_y = Window.partitionBy(*frame, "x").orderBy("y").rowsBetween(-radius, radius)
    along_x = Window.partitionBy(*frame, "y").orderBy("x").rowsBetween(-radius, radius)
    df = df.withColumns({"__s": F.sum(value).over(along_y), "__n": F.count(value).over(along_y)})
    return df.withColumn("box", F.sum("__s").over(along_x) / F.sum("__n").over(along_x)).drop("__s", "__n")


def tile_sharpness(df: DataFrame, frame: list[str], height: int | None = None, width: int | None = None, grid: int = 4, value: str = "v") -> DataFrame:
    """Population variance of the Laplacian per tile of a grid x grid raster; remainder pixels are left out.

    Without ``height`` and ``width``, each frame's own size counts.
    """
    lap = laplacian(df, frame, value)
    if height is None or width is None:
        size = df.groupBy(*frame).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
        lap = lap.join(size, frame)
        th, tw = F.greatest(F.lit(1), F.expr(f"__h DIV {grid}")), F.greatest(F.lit(1), F.expr(f"__w DIV {grid}"))
    else:
        th, tw = F.lit(max(1, height // grid)), F.lit(max(1, width // grid))
    lap = lap.filter((F.col("y") < th * grid) & (F.col("x") < tw * grid))
    tile = (F.floor(F.col("y") / th) * grid + F.floor(F.col("x") / tw)).cast("int")
    return lap.groupBy(*frame, tile.alias("tile")).agg(F.var_pop("lap").alias("s"))


def peak_sharpness(tiles: DataFrame, frame: list[str], share: float = 0.95) -> DataFrame:
    return tiles.groupBy(*frame).agg(F.expr(f"percentile(s, {share}D)").alias("peak_sharp"), F.avg("s").alias("mean_sharp"))


def detect_blurry(tiles: DataFrame, series: list[str], order: str, rel: float = 0.45) -> DataFrame:
    """Frames whose sharpest tile is under rel times the series' median of these."""
    peaks = tiles.groupBy(*series, order).agg(F.max("s").alias("peak"))
    middle = peaks.groupBy(*series).agg((F.median("peak") + 1e-9).alias("__mid"))
    return peaks.join(middle, series).withColumn("ratio", F.col("peak") / F.col("__mid")).filter(F.col("ratio") < rel).drop("__mid", "peak")


def tile_winners(tiles: DataFrame, series: list[str], order: str, content: float = 0.15) -> DataFrame:
    """Per content tile its sharpest frame (the first of equals): series, tile, winner, peak."""
    best = tiles.groupBy(*series, "tile").agg(F.max(F.struct("s", (-F.col(order)).alias("o"))).alias("b"))
    best = best.select(*series, "tile", (-F.col("b.o")).alias("winner"), F.col("b.s").alias("peak"))
    cut = best.filter("peak > 0").groupBy(*series).agg((content * F.median("peak")).alias("__cut"))
    return best.join(cut, series, "left").filter(F.col("peak") > F.coalesce("__cut", F.lit(0.0))).drop("__cut")


def focus_sweep(tiles: DataFrame, series: list[str], order: str) -> DataFrame:
    """Tiles won per frame; 0 marks a redundant frame."""
    won = tile_winners(tiles, series, order).groupBy(*series, F.col("winner").alias(order)).agg(F.count(F.lit(1)).alias("contrib"))
    frames = tiles.select(*series, order).distinct()
    return frames.join(won, [*series, order], "left").withColumn("contrib", F.coalesce("contrib", F.lit(0)).cast("bigint"))


def sweep_range(sweep: DataFrame, series: list[str], order: str) -> DataFrame:
    used = sweep.filter("contrib > 0").groupBy(*series).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("contributing"), F.sum("contrib").alias("tiles"))
    return used


def coverage(tiles: DataFrame, series: list[str], order: str) -> DataFrame:
    """Share of content tiles that reach a quarter of the median of the sharpest quarter; complete from 92 % on."""
    peaks = tiles.groupBy(*series, "tile").agg(F.max("s").alias("peak"))
    by_peak = Window.partitionBy(*series).orderBy(F.desc("peak"), "tile")
    ranked = peaks.filter("peak > 0").withColumns({"r": F.row_number().over(by_peak), "n": F.count(F.lit(1)).over(Window.partitionBy(*series))})
    sharp = ranked.filter("r <= greatest(1, n div 4)").groupBy(*series).agg(F.median("peak").alias("__ref"))
    content = tile_winners(tiles, series, order)
    out = content.join(sharp, series).groupBy(*series).agg((F.sum((F.col("peak") >= 0.25 * F.col("__ref")).cast("double")) / F.count(F.lit(1))).alias("share"))
    return out.select(*series, F.col("share").alias("coverage"), (F.col("share") >= 0.92).alias("complete"))


def outliers(tiles: DataFrame, series: list[str], order: str, grid: int = 4) -> DataFrame:
    """Frames whose won tiles lie far (median distance over 0.55 * grid) from those of up to two neighbours on each side."""
    won = tile_winners(tiles, series, order)
    centre = won.groupBy(*series, F.col("winner").alias(order)).agg(F.avg(F.floor(F.col("tile") / grid)).alias("cy"), F.avg(F.col("tile") % grid).alias("cx"))
    w = Window.partitionBy(*series).orderBy(order)
    distance = [F.hypot(F.col("cy") - f("cy", k).over(w), F.col("cx") - f("cx", k).over(w)) for f in (F.lag, F.lead) for k in (1, 2)]
    found = F.array_compact(F.array(*distance))
    ordered = F.array_sort(found)
    middle = F.when(
        F.size(found) >= 2,
        (F.element_at(ordered, F.floor((F.size(found) + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(F.size(found) / 2 + 1).cast("int"))) / 2.0,
    )
    return centre.withColumn("jump", middle).filter(F.col("jump") > 0.55 * grid).select(*series, order, "jump")


def series_status(tiles: DataFrame, series: list[str], order: str, grid: int = 4) -> DataFrame:
    """One status per frame: blurry, then outlier, then good, else redundant."""
    keys = [*series, order]
    out = focus_sweep(tiles, series, order)
    out = out.join(detect_blurry(tiles, series, order), keys, "left").join(outliers(tiles, series, order, grid), keys, "left")
    status = F.when(F.col("ratio").isNotNull(), "blurry").when(F.col("jump").isNotNull(), "outlier").when(F.col("contrib") > 0, "good").otherwise("redundant")
    return out.select(*keys, "contrib", status.alias("status"))


def disagreement(df: DataFrame, series: list[str], value: str = "v") -> DataFrame:
    """Population deviation per pixel over the frames, as a share of the series' greatest."""
    spread = df.groupBy(*series, "y", "x").agg(F.stddev_pop(value).alias("d"))
    top = spread.groupBy(*series).agg(F.max("d").alias("__top"))
    return spread.join(top, series).select(*series, "y", "x", (F.col("d") / F.greatest(F.col("__top"), F.lit(1e-6))).alias("disagreement"))


def cosmetic(df: DataFrame, frame: list[str], value: str = "v", strength: float = 3.0) -> DataFrame:
    """Pixels that deviate from their 3x3 median by more than ``strength`` population deviations of that difference take the median (frame edges mirrored by repetition).

    Nine shifted copies of each value meet by position: an aggregate, not a self-join.
    """
    shifts = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    size = df.agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    near = df.crossJoin(F.broadcast(size)).withColumn("t", shifts)  # one row
    near = near.select(*frame, (F.col("y") + F.col("t.dy")).alias("ty"), (F.col("x") + F.col("t.dx")).alias("tx"), "__h", "__w", F.col(value).alias("nv"))
    inside = near.filter("ty BETWEEN 0 AND __h AND tx BETWEEN 0 AND __w")
    med = inside.groupBy(*frame, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.median("nv").alias("med"))
    out = df.join(med, [*frame, "y", "x"]).withColumn("diff", F.col(value) - F.col("med"))
    spread = out.groupBy(*frame).agg(F.stddev_pop("diff").alias("sd"))
    out = out.join(spread, frame)
    hot = F.abs("diff") > strength * F.col("sd")
    return out.select(*frame, "y", "x", F.when(hot, F.col("med")).otherwise(F.col(value)).alias("value"), hot.alias("replaced"))


def depth_weighted(df: DataFrame, series: list[str], frame: str, gamma: float = 8.0, value: str = "v") -> DataFrame:
    """Mean per pixel with weight (sharpness / greatest sharpness) ** gamma."""
    sharp = focus_measure(df, [*series, frame], value)
    top = sharp.groupBy(*series, "y", "x").agg(F.max("sml").alias("__top"))
    joined = sharp.join(top, [*series, "y", "x"]).withColumn("w", F.pow(F.col("sml") / (F.col("__top") + 1e-6), F.lit(gamma)))
    return joined.groupBy(*series, "y", "x").agg((F.sum(F.col("w") * F.col(value)) / (F.sum("w") + 1e-6)).alias("value"))


def winner_value(df: DataFrame, series: list[str], frame: str, value: str = "v") -> DataFrame:
    """Per pixel the value of its sharpest frame; the first of equals."""
    sharp = focus_measure(df, [*series, frame], value)
    best = sharp.groupBy(*series, "y", "x").agg(F.max(F.struct("sml", (-F.col(frame)).alias("o"), F.col(value).alias("v"))).alias("b"))
    return best.select(*series, "y", "x", (-F.col("b.o")).alias("winner"), F.col("b.v").alias("value"))


def ghost_area(disagreement: DataFrame, series: list[str], threshold: float = 0.35) -> DataFrame:
    return disagreement.groupBy(*series).agg(F.avg((F.col("disagreement") > threshold).cast("double")).alias("ghost_share"))


def centroid(df: DataFrame, frame: list[str], value: str = "v", factor: float = 0.5, least: int = 5) -> DataFrame:
    """Mean position of the pixels over mean + factor deviations; frames with fewer than ``least`` of them have none."""
    stats = df.groupBy(*frame).agg((F.avg(value) + factor * F.stddev_pop(value)).alias("__cut"))
    bright = df.join(stats, frame).filter(F.col(value) > F.col("__cut"))
    return bright.groupBy(*frame).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def motion_span(centres: DataFrame, series: list[str]) -> DataFrame:
    """Diagonal of the box around a series' centroids; under three of them there is none."""
    box = centres.groupBy(*series).agg((F.max("cx") - F.min("cx")).alias("w"), (F.max("cy") - F.min("cy")).alias("h"), F.count(F.lit(1)).alias("n"))
    return box.select(*series, F.when(F.col("n") >= 3, F.hypot("w", "h")).alias("span"))


def sky_profile(df: DataFrame, series: list[str], value: str = "v") -> DataFrame:
    """Temporal deviation per pixel against median + MAD, row shares of moving pixels, and the last row whose running mean is at least half of the greatest."""
    spread = df.groupBy(*series, "y", "x").agg(F.stddev_pop(value).alias("sd"))
    med = spread.groupBy(*series).agg(F.median("sd").alias("m"))
    dev = spread.join(med, series).withColumn("a", F.abs(F.col("sd") - F.col("m")))
    mad = dev.groupBy(*series).agg(F.median("a").alias("mad"))
    rows = dev.join(mad, series).groupBy(*series, "y").agg(F.avg((F.col("sd") > F.col("m") + F.col("mad")).cast("double")).alias("share"))
    running = rows.withColumn("mean", F.avg("share").over(Window.partitionBy(*series).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))
    top = running.groupBy(*series).agg(F.max("mean").alias("__top"))
    return running.join(top, series).groupBy(*series).agg(F.max(F.when(F.col("mean") >= 0.5 * F.col("__top"), F.col("y"))).alias("horizon"))


def column_sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
