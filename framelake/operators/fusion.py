"""Fusion of frames that differ in focus, exposure or motion, and verdicts on series and results.

Everything per pixel is an expression or an aggregate over (series, y, x); a task of
the NumPy steps holds one frame, or one merged image of a series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, score, select

#: Gray levels between which a pixel of an exposure counts as well exposed, of 255.
DARK, BRIGHT = 13.0, 242.0


def luma(b: str = "b", g: str = "g", r: str = "r") -> Column:
    return 0.114 * F.col(b) + 0.587 * F.col(g) + 0.299 * F.col(r)


# --- focus ---------------------------------------------------------------------------------------


def focus_average(df: DataFrame, series: list[str], frame: str, radius: int = 4, value: str = "v") -> DataFrame:
    """Mean per pixel, weighted by the focus measure's mean over a square."""
    sharp = score.box_mean(score.focus_measure(df, [*series, frame], value), [*series, frame], "sml", radius)
    weight = F.col("box") + 1e-6
    return sharp.groupBy(*series, "y", "x").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("value"))


def voted_winner(df: DataFrame, series: list[str], frame: str, window: int = 0, vote: int = 2, value: str = "v") -> DataFrame:
    """Per pixel the median of the sharpest frames in the square of radius ``vote`` around it (edges repeated; places without a pixel don't vote), as column ``frame``.

    Sharpness is the focus measure, averaged over a square of radius ``window``.  One
    image per series is voted on; an array of (2 vote + 1) ** 2 frame numbers is a row's bound.
    """
    sharp = score.focus_measure(df, [*series, frame], value)
    if window:
        sharp = score.box_mean(sharp, [*series, frame], "sml", window).withColumn("sml", F.col("box"))
    best = sharp.groupBy(*series, "y", "x").agg(F.max_by(frame, F.struct("sml", -F.col(frame))).alias("__w"))
    size = best.groupBy(*series).agg(F.max("y").alias("__h"), F.max("x").alias("__v"))
    steps = F.sequence(F.lit(-vote), F.lit(vote))
    at = best.select(*series, "y", "x").join(size, series).withColumn("__dy", F.explode(steps)).withColumn("__dx", F.explode(steps))
    inside = lambda c, d, top: F.least(F.greatest(F.col(c) + F.col(d), F.lit(0)), F.col(top))
    at = at.withColumns({"__sy": inside("y", "__dy", "__h"), "__sx": inside("x", "__dx", "__v")}).select(*series, "y", "x", "__sy", "__sx")
    source = best.select(*series, F.col("y").alias("__sy"), F.col("x").alias("__sx"), "__w")
    votes = at.join(source, [*series, "__sy", "__sx"]).groupBy(*series, "y", "x").agg(F.array_sort(F.collect_list("__w")).alias("__all"))
    return votes.select(*series, "y", "x", F.expr("__all[size(__all) DIV 2]").alias(frame))  # of an even number the later


def reassign(df: DataFrame, series: list[str], frame: str, window: int = 0, vote: int = 2, value: str = "v") -> DataFrame:
    """Each pixel's value in its voted sharpest frame."""
    chosen = voted_winner(df, series, frame, window, vote, value)
    return df.join(chosen, [*series, "y", "x", frame]).select(*series, "y", "x", F.col(frame).alias("winner"), F.col(value).alias("value"))


def deghost_sharpest(df: DataFrame, merged: DataFrame, series: list[str], frame: str, threshold: float = 0.35, value: str = "v") -> DataFrame:
    """``merged`` (series..., y, x, value), blended to the voted sharpest frame where the frames disagree by more than ``threshold``."""
    sharp = reassign(df, series, frame, 3, 2, value).select(*series, "y", "x", F.col("value").alias("__s"))
    apart = score.disagreement(df, series, value)
    mask = F.least(F.greatest((F.col("disagreement") - threshold) / max(1e-6, 1.0 - threshold), F.lit(0.0)), F.lit(1.0))
    out = merged.join(sharp, [*series, "y", "x"]).join(apart, [*series, "y", "x"])
    return out.select(*series, "y", "x", (F.col("value") * (1.0 - mask) + F.col("__s") * mask).alias("value"))


def consistent_merge(df: DataFrame, series: list[str], frame: str, levels: int = 2, radius: int = 2, margin: float = 1.25, value: str = "v") -> DataFrame:
    """Pyramid merge whose choices hold across scales: a finer band leaves the coarser band's frame only for ``margin`` times its window energy.

    Choices are aggregates per coefficient, from the coarsest band to the finest.
    """

    def split(x):
        *bands, base = kernels.pyramid(x, levels)
        return [*((b, kernels.box(np.abs(b), radius)) for b in bands), (base, np.zeros_like(base))]

    at = [*series, "band", "y", "x"]
    rows = kernels.band_rows(df, series, frame, split, value)
    best = rows.groupBy(*at).agg(F.struct(kernels.strongest(frame, frame).alias("f"), F.max("energy").alias("e"), kernels.strongest(frame, value).alias("v"), F.avg(value).alias("m")).alias("own"))
    merged = best.filter(F.col("band") == levels).select(*at, F.col("own.m").alias(value))
    prior = None
    for band in reversed(range(levels)):
        own = best.filter(F.col("band") == band)
        if prior is None:
            chosen = own.select(*at, F.col("own.f").alias(frame), F.col("own.v").alias(value))
        else:
            up = prior.select(*series, F.col("y").alias("__py"), F.col("x").alias("__px"), F.col(frame).alias("__pf"))
            held = own.withColumns({"__py": F.floor(F.col("y") / 2).cast("int"), "__px": F.floor(F.col("x") / 2).cast("int")}).join(up, [*series, "__py", "__px"])
            here = rows.filter(F.col("band") == band).select(*series, "y", "x", F.col(frame).alias("__pf"), F.col(value).alias("__pv"), F.col("energy").alias("__pe"))
            both = held.join(here, [*series, "y", "x", "__pf"])
            leave = F.col("own.e") > F.col("__pe") * margin + 1e-6
            chosen = both.select(*at, F.when(leave, F.col("own.f")).otherwise(F.col("__pf")).alias(frame), F.when(leave, F.col("own.v")).otherwise(F.col("__pv")).alias(value))
        merged = merged.union(chosen.select(*at, value))
        prior = chosen
    return kernels.rebuild(merged, series, [value], lambda bands: kernels.collapse([b[value] for b in bands]), value)


# --- exposure ------------------------------------------------------------------------------------


def exposure_weights(df: DataFrame, series: list[str], frame: str, contrast: float = 1.0, saturation: float = 1.0, exposure: float = 1.0) -> DataFrame:
    """``weight`` of each pixel (b, g, r in [0, 1]) among the exposures: local contrast, spread of the channels and closeness to the middle, to the given powers; they add up to 1."""
    gray = score.laplacian(df.withColumn("__gray", luma()), [*series, frame], "__gray")
    mean = (F.col("b") + F.col("g") + F.col("r")) / 3.0
    power = lambda e, p: F.pow(e, F.lit(float(p)))
    spread = F.sqrt((power(F.col("b") - mean, 2) + power(F.col("g") - mean, 2) + power(F.col("r") - mean, 2)) / 3.0)
    middle = F.exp(-(power(F.col("b") - 0.5, 2) + power(F.col("g") - 0.5, 2) + power(F.col("r") - 0.5, 2)) / 0.08)
    raw = power(F.abs("lap"), contrast) * power(spread, saturation) * power(middle, exposure) + 1e-12
    raw_rows = gray.withColumn("__raw", raw).drop("__gray", "lap")
    total = raw_rows.groupBy(*series, "y", "x").agg(F.sum("__raw").alias("__total"))
    return raw_rows.join(total, [*series, "y", "x"]).withColumn("weight", F.col("__raw") / F.col("__total")).drop("__raw", "__total")


def exposure_fusion(weighted: DataFrame, series: list[str], frame: str, levels: int = 2) -> DataFrame:
    """Multi-band fusion: Laplacian bands of each exposure's channels times Gaussian levels of its weight, added over the exposures, collapsed and cut to [0, 1].

    Rows of all exposures are added before any task sees a series.
    """
    def split(images):
        share = [images["weight"]]
        for _ in range(levels):
            share.append(kernels.halve(share[-1]))
        return [{"c": c, "band": k, "value": band * share[k]} for c, name in enumerate(("b", "g", "r")) for k, band in enumerate(kernels.pyramid(images[name], levels))]

    rows = kernels.stack_map(weighted, [*series, frame], ["b", "g", "r", "weight"], {"c": "int", "band": "int", "value": "double"}, split)
    merged = rows.groupBy(*series, "c", "band", "y", "x").agg(F.sum("value").alias("value"))
    return kernels.rebuild(merged, [*series, "c"], ["value"], lambda bands: np.clip(kernels.collapse([b["value"] for b in bands]), 0, 1), "value")


def reference_exposure(df: DataFrame, series: list[str], frame: str, value: str = "v") -> DataFrame:
    """The frame with most well exposed pixels of each series (the first of equals); values of 255."""
    well = df.groupBy(*series, frame).agg(F.sum(((F.col(value) > DARK) & (F.col(value) < BRIGHT)).cast("int")).alias("__n"))
    return well.groupBy(*series).agg(F.max_by(frame, F.struct("__n", -F.col(frame))).alias(frame))


def exposure_motion(df: DataFrame, series: list[str], frame: str, kappa: float = 4.0, value: str = "v") -> DataFrame:
    """``moving`` (0 or 1) per pixel: its gradient in some frame, brought to the reference's median, is further from the reference's than median + kappa MAD.

    Holes up to 5 pixels are closed and specks under 3 taken away.
    """
    keys = [*series, frame]
    ref = reference_exposure(df, series, frame, value).select(*series, F.col(frame).alias("__ref"))
    gray = df.select(*keys, "y", "x", (F.col(value) + 1e-3).alias("__g"))
    middle = gray.groupBy(*keys).agg(F.median("__g").alias("__m")).join(ref, series)
    target = middle.filter(F.col(frame) == F.col("__ref")).select(*series, F.col("__m").alias("__t"))
    gain = middle.join(target, series).select(*keys, (F.col(frame) == F.col("__ref")).alias("__is"), (F.col("__t") / F.col("__m")).alias("__gain"))
    matched = gray.join(gain, keys).withColumn("__g", F.when(F.col("__is"), F.col("__g")).otherwise(F.least(F.greatest(F.col("__g") * F.col("__gain"), F.lit(0.0)), F.lit(255.0))))
    grad = score.gradient(matched, keys, "__g").select(*keys, "y", "x", "__is", "grad")
    base = grad.filter("__is").select(*series, "y", "x", F.col("grad").alias("__rg"))
    dev = grad.filter("NOT __is").join(base, [*series, "y", "x"]).withColumn("__d", F.abs(F.col("grad") - F.col("__rg")))
    mid = dev.groupBy(*keys).agg(F.median("__d").alias("__md"))
    off = dev.join(mid, keys).withColumn("__a", F.abs(F.col("__d") - F.col("__md")))
    cut = off.groupBy(*keys).agg((F.first("__md") + kappa * (F.median("__a") * 1.4826 + 1e-6)).alias("__cut"))
    out = dev.join(cut, keys).groupBy(*series, "y", "x").agg(F.max((F.col("__d") > F.col("__cut")).cast("double")).alias("moving"))
    for radius, largest in ((2, True), (2, False), (1, False), (1, True)):
        out = score.extreme(out, series, "moving", largest, radius).select(*series, "y", "x", F.col("extreme").alias("moving"))
    return out


def deghost_exposures(df: DataFrame, fused: DataFrame, series: list[str], frame: str, aggressive: bool = False, soft: float = 4.0, value: str = "v") -> DataFrame:
    """``fused`` (series..., y, x, value; of 255), blended to the best exposed frame where something moved."""
    moving = exposure_motion(df, series, frame, 2.5 if aggressive else 4.0, value)
    mask = kernels.frame_map(moving, series, lambda m: kernels.blur(m, soft), "moving").withColumnRenamed("value", "__m")
    ref = df.join(reference_exposure(df, series, frame, value), [*series, frame]).select(*series, "y", "x", F.col(value).alias("__r"))
    out = fused.join(mask, [*series, "y", "x"]).join(ref, [*series, "y", "x"])
    mixed = F.col("value") * (1.0 - F.col("__m")) + F.col("__r") * F.col("__m")
    return out.select(*series, "y", "x", F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0)).alias("value"))


# --- background ----------------------------------------------------------------------------------


def background_surface(x: np.ndarray, factor: int = 8) -> np.ndarray:
    """The smooth background of a frame, or of each of a stack: block means (at least 8 per axis, or the pixels of a smaller frame), blurred, and stretched again."""
    small, stretch = x, []
    for axis in (-2, -1):
        n = x.shape[axis]
        edge = np.linspace(0, n, min(n, max(8, n // factor)) + 1).astype(int)
        size = np.diff(edge)
        small = np.add.reduceat(small, edge[:-1], axis=axis) / (size[:, None] if axis == -2 else size)
        places = edge[:-1] + (size - 1) / 2
        stretch.append(np.stack([np.interp(np.arange(n), places, one) for one in np.eye(len(size))], axis=1))
    small = kernels.blur(small, max(2.0, small.shape[-1] / 10.0))
    return stretch[0] @ small @ stretch[1].T


def local_normalize(df: DataFrame, series: list[str], frame: str, factor: int = 8, value: str = "v") -> DataFrame:
    """Each frame moved, place by place, to the background of its series' first frame."""
    keys = [*series, frame]
    own = kernels.frame_map(df, keys, lambda x: background_surface(x, factor), value, stacked=True).withColumnRenamed("value", "__own")
    first = df.groupBy(*series).agg(F.min(frame).alias(frame))
    ref = own.join(first, keys).select(*series, "y", "x", F.col("__own").alias("__ref"))
    out = df.join(own, [*keys, "y", "x"]).join(ref, [*series, "y", "x"])
    return out.select(*keys, "y", "x", (F.col(value) + F.col("__ref") - F.col("__own")).alias("value"))


# --- lucky imaging -------------------------------------------------------------------------------


def lucky_stack(df: DataFrame, series: list[str], frame: str, share: float = 0.3, value: str = "v") -> DataFrame:
    """Mean of the sharpest share of each series' frames (variance of the Laplacian over squared brightness)."""
    keys = [*series, frame]
    grade = score.laplacian(df, keys, value).groupBy(*keys).agg((F.var_pop("lap") / F.pow(F.avg(value) + 1.0, F.lit(2.0))).alias("__q"))
    kept = select.top_share(grade, series, "__q", frame, share).select(*keys)
    return df.join(kept, keys).groupBy(*series, "y", "x").agg(F.avg(value).alias("value"))


def lucky_map(df: DataFrame, series: list[str], frame: str, step: int = 2, half: int = 2, share: float = 0.3, value: str = "v") -> DataFrame:
    """Per point of a grid the mean of the patches (2 half wide) of its best frames by local structure, blended by Hann weights.

    Pixels are copied to the few patches that cover them; a patch's frames are ranked by a
    window over grades, of which there is one per patch and frame.  The grid spans the
    series' largest frame; its last row and column of patches end at the edge.
    """
    keys = [*series, "py", "px", frame]
    last = lambda c: F.greatest(F.max(c) + 1 - half, F.lit(half)).cast("int")
    ends = df.groupBy(*series).agg(last("y").alias("__ly"), last("x").alias("__lx"))
    spots = lambda end: F.array_union(F.sequence(F.lit(half), F.col(end), F.lit(step)), F.array(end))
    covers = lambda c, p: (F.col(c) >= F.col(p) - half) & (F.col(c) < F.col(p) + half)
    cells = df.join(ends, series).withColumn("py", F.explode(spots("__ly"))).filter(covers("y", "py")).withColumn("px", F.explode(spots("__lx"))).filter(covers("x", "px")).drop("__ly", "__lx")
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    steep = cells.withColumns({"__gx": F.abs(F.col(value) - F.lag(value).over(across)), "__gy": F.abs(F.col(value) - F.lag(value).over(down))})
    grade = steep.groupBy(*keys).agg(F.least(F.avg("__gx"), F.avg("__gy")).alias("__q"))
    kept = select.top_share(grade, [*series, "py", "px"], "__q", frame, share).select(*keys)
    mean = cells.join(kept, keys).groupBy(*series, "py", "px", "y", "x").agg(F.avg(value).alias("__v"))
    hann = lambda c, p: 0.5 - 0.5 * F.cos(2.0 * np.pi * (F.col(c) - F.col(p) + half + 0.5) / (2 * half))
    weight = hann("y", "py") * hann("x", "px")
    return mean.groupBy(*series, "y", "x").agg((F.sum(weight * F.col("__v")) / F.sum(weight)).alias("value"))


# --- verdicts ------------------------------------------------------------------------------------


def stack_score(result: DataFrame, sources: DataFrame, series: list[str], frame: str, subject_aligned: bool = False, edge: float = 18.75, value: str = "v") -> DataFrame:
    """sharpness, halo, ghost_area_pct, findings and a score of 100 per series; values of 255.

    Edges are pixels with a gradient over ``edge``; the ghost area counts for three frames and more.
    """
    lap = score.laplacian(result, series, value).groupBy(*series).agg(F.var_pop("lap").alias("sharpness"))
    soft = kernels.frame_map(result, series, lambda x: kernels.blur(x, 2.0), value).withColumnRenamed("value", "__b")
    over = score.gradient(result, series, value).join(soft, [*series, "y", "x"]).filter(F.col("grad") > edge)
    halo = over.groupBy(*series).agg(F.avg(F.greatest(F.col(value) - F.col("__b"), F.lit(0.0))).alias("halo"))
    apart = score.disagreement(sources, series, value)
    cut = apart.groupBy(*series).agg((F.avg("disagreement") + 4.0 * F.stddev_pop("disagreement")).alias("__cut"))
    area = apart.join(cut, series).groupBy(*series).agg(F.avg((F.col("disagreement") > F.col("__cut")).cast("double")).alias("__area"))
    frames = sources.groupBy(*series).agg(F.countDistinct(frame).alias("__n"))
    out = lap.join(halo, series, "left").join(area, series).join(frames, series)
    out = out.withColumns({"halo": F.coalesce("halo", F.lit(0.0)), "__area": F.when(F.col("__n") >= 3, F.col("__area")).otherwise(0.0)})
    halos, blurred, ghosts = F.col("halo") > 6, F.col("sharpness") < 50, F.col("__area") > 0.002
    findings = F.array_compact(F.array(F.when(halos, "halos"), F.when(blurred, "soft"), F.when(ghosts, "moving background" if subject_aligned else "ghosts")))
    points = 100 - F.when(halos, 12).otherwise(0) - F.when(blurred, 12).otherwise(0) - F.when(ghosts, 3 if subject_aligned else 15).otherwise(0)
    return out.select(*series, points.cast("bigint").alias("score"), "sharpness", "halo", (100.0 * F.col("__area")).alias("ghost_area_pct"), F.array_join(findings, ",").alias("findings"))


def suggest_mode(df: DataFrame, series: list[str], frame: str, sample: int = 8, value: str = "v") -> DataFrame:
    """Long-exposure mode and alignment of each series, from an even sample of its frames (values of 255): shares of moving pixels, brightness, greatest shift."""
    keys = [*series, frame]
    names = select.even_sample(df.select(*keys).distinct(), series, [frame], sample)
    px = df.join(names, keys)
    per = px.groupBy(*series, "y", "x").agg(F.avg(value).alias("__m"), F.max(value).alias("__top"))
    moved = px.join(per, [*series, "y", "x"]).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    cut = moved.groupBy(*series).agg((F.avg("__d") + 2.0 * F.stddev_pop("__d") + 1e-6).alias("__cut"))
    spot = moved.groupBy(*series, "y", "x").agg(F.max("__d").alias("__d"), F.first("__m").alias("__m"), F.first("__top").alias("__top")).join(cut, series)
    moving = F.col("__d") > F.col("__cut")
    stats = spot.groupBy(*series).agg(
        F.avg(moving.cast("double")).alias("moving_frac"), (F.avg("__m") / 255.0).alias("mean_bright"),
        F.coalesce(F.avg(F.when(moving, F.col("__top") - F.col("__m"))), F.lit(0.0)).alias("bright_motion"), (F.max("x") + 1).alias("__width"),
    )
    first = names.groupBy(*series).agg(F.min(frame).alias(frame))
    ref = px.join(first, keys).select(*series, "y", "x", F.col(value).alias("__r"))

    def run(key, pdf):
        import pandas as pd

        shape = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        a, b = np.zeros(shape), np.zeros(shape)
        a[pdf["y"], pdf["x"]], b[pdf["y"], pdf["x"]] = pdf["__r"], pdf[value]
        return pd.DataFrame({f: [int(k)] for f, k in zip(keys, key)} | {"__s": [float(np.hypot(*kernels.phase_shift(a, b)))]})

    shifts = px.join(ref, [*series, "y", "x"]).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} bigint" for k in keys) + ", __s double")
    out = stats.join(shifts.groupBy(*series).agg(F.max("__s").alias("__s")), series).withColumn("shift_frac", F.col("__s") / F.col("__width"))
    mode = (
        F.when((F.col("mean_bright") < 0.28) & (F.col("bright_motion") > 18), "trails")
        .when((F.col("moving_frac") > 0.02) & (F.col("moving_frac") < 0.25), "declutter")
        .when(F.col("mean_bright") < 0.22, "bright")
        .otherwise("smooth")
    )
    align = F.when(F.col("shift_frac") > 0.10, "feature").when(F.col("shift_frac") > 0.01, "shift").otherwise("none")
    return out.select(*series, mode.alias("mode"), align.alias("align"), "moving_frac", "mean_bright", "shift_frac")
