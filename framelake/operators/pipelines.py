"""Whole runs as one plan: astronomy, focus, exposures, long exposures and lucky imaging, composed of the library's operators.

Frames come as array rows (series..., frame, h, w, values) or as pixels (series...,
frame, y, x, v).  A run returns its result as pixels and, where frames are judged,
a table that says of each frame what became of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as mx
from ..session import bounded_batches, stored
from . import align, combine, fusion, kernels, refine, rows, scan, score, select, stars, trails

#: Stars of a frame that take part in its registration.
MOST_STARS = 60
#: Stars that must agree for a pair of frames to count.
LEAST_MATCHES = 8


def numbered(frames: DataFrame, series: list[str], frame: str) -> DataFrame:
    """series..., frame, k (its number in the series) and middle (that of the reference, n // 2)."""
    k = stored(scan.positions(frames.select(*series, frame).distinct(), series, [frame]))
    return k.join(k.groupBy(*series).agg(F.expr("CAST(count(*) DIV 2 AS BIGINT)").alias("middle")), series)


def star_pairs(table: DataFrame, places: DataFrame, series: list[str], frame: str, tolerance: float = 1.5, most: int = MOST_STARS, least: int = LEAST_MATCHES) -> DataFrame:
    """series..., mov, ref, m (3x3, from mov to ref), score (stars that agree) of each frame with the one before it and with the reference.

    ``table``: a row per star (series..., frame, id, x, y; id 0 is the brightest), of which
    the first ``most`` count; ``places``: the result of ``numbered``.  Triangles of stars vote
    for pairs, and sample consensus finds the similarity.
    """
    lists = table.filter(F.col("id") < most).groupBy(*series, frame).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("stars"))
    known = stored(places.join(lists, [*series, frame]))
    mov = known.select(*series, F.col(frame).alias("mov"), "k", F.col("stars").alias("ms"), F.explode(F.array_distinct(F.array(F.col("k") - 1, "middle"))).alias("to")).filter(F.col("to") != F.col("k"))
    ref = known.select(*series, F.col("k").alias("to"), F.col(frame).alias("ref"), F.col("stars").alias("rs"))
    pairs = mov.join(ref, [*series, "to"]).select(*series, "mov", "ref", "ms", "rs")
    bounded_batches(table.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a, b = (np.array([(s["x"], s["y"]) for s in row[c]]).reshape(-1, 2) for c in ("rs", "ms"))
                if min(len(a), len(b)) < 3:
                    continue
                i, j = kernels.match_triangles(a, b, most)
                m, good = kernels.ransac(b[j], a[i], tolerance)
                if m is not None and good.sum() >= least:
                    out.append((*[row[c] for c in [*series, "mov", "ref"]], [*m.ravel().tolist(), 0.0, 0.0, 1.0], float(good.sum())))
            yield pd.DataFrame(out, columns=[*series, "mov", "ref", "m", "score"])

    # A pair costs much more than its few bytes tell: dealt anew, so that these are not joined into one task.
    dealt = pairs.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, *series, "mov", "ref")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*series, "mov", "ref"]) + ", m array<double>, score double"
    return dealt.mapInPandas(run, schema)


def judged(frames: DataFrame, series: list[str], frame: str, factor: float = 5.0, least_votes: int = 60, share: float = 0.3) -> DataFrame:
    """series..., frame, stars, fwhm, ecc, bg, trail, keep, reasons: every frame against the medians of its series, trails included."""
    key = [*series, frame]
    quality = stars.frame_quality(frames, key, factor).withColumnsRenamed({"elongation": "ecc", "background": "bg"})
    lines = trails.detect_trails(rows.pixels(frames.filter("values IS NOT NULL"), key, ["v"]), key, 4.0, least_votes, share)
    return select.select_subs(quality.join(lines, key, "left").withColumn("trail", F.coalesce("trail", F.lit(False))), series)


def astro(frames: DataFrame, series: list[str], frame: str, method: str = "sigma", factor: float = 5.0, least_votes: int = 60, judge: bool = True, tolerance: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Frames of stars to one image: judge, register over bridges, move, combine by ``method``.

    Returns pixels (series..., y, x, value) and what became of each frame: series...,
    frame, state (of ``align.register``, or ``rejected``), reasons.  Series of which fewer
    than two frames are kept use all of theirs.
    """
    key = [*series, frame]
    if judge:
        verdict = stored(judged(frames, series, frame, factor, least_votes))
        few = verdict.groupBy(*series).agg((F.sum(F.col("keep").cast("int")) < 2).alias("__few"))
        verdict = verdict.join(few, series).select(*key, (F.col("keep") | F.col("__few")).alias("keep"), "reasons")
    else:
        verdict = frames.select(*key, F.lit(True).alias("keep"), F.array().cast("array<string>").alias("reasons"))
    kept = frames.join(verdict.filter("keep").select(*key), key, "left_semi")
    places = stored(numbered(kept, series, frame))
    table = stored(stars.star_table(kept, key, factor))
    pairs = stored(star_pairs(table, places, series, frame, tolerance))
    named = places.select(*series, F.col(frame).alias("frame"), (F.col("k") == F.col("middle")).alias("reference"))
    moves = stored(align.register(named, pairs, series).withColumnRenamed("frame", frame))
    moved = stars.moved_frames(kept, series, frame, moves)
    px = rows.pixels(moved, key, ["v"], "moved").filter("NOT isnan(v)")
    fate = verdict.join(moves.drop("m"), key, "left").select(*key, F.when(F.col("keep"), F.coalesce("state", F.lit("unpaired"))).otherwise("rejected").alias("state"), "reasons")
    return combine.combine(px, [*series, "y", "x"], method), fate


def focus(px: DataFrame, series: list[str], frame: str, blurry: float = 0.45, levels: int = 2, sharpen: float = 0.0, value: str = "v") -> tuple[DataFrame, DataFrame]:
    """A focus series to one image: leave out blurred frames, merge so that choices hold across scales, sharpen by ``sharpen`` percent.

    Returns pixels (series..., y, x, value) and series..., frame, contrib (tiles it won), kept.
    """
    key = [*series, frame]
    tiles = stored(score.tile_sharpness(px, key, value=value))
    bad = stored(score.detect_blurry(tiles, series, frame, blurry).select(*key))
    kept = px.join(bad, key, "left_anti")
    merged = fusion.consistent_merge(kept, series, frame, levels, value=value).withColumnRenamed(value, "value")
    if sharpen:
        merged = kernels.frame_map(merged, series, lambda x: kernels.unsharp(x, sharpen, 1.0), "value")
    fate = score.focus_sweep(tiles, series, frame).join(bad.withColumn("__bad", F.lit(True)), key, "left")
    return merged, fate.select(*key, "contrib", F.col("__bad").isNull().alias("kept"))


def exposures(colour: DataFrame, series: list[str], frame: str, deghost: str = "auto", levels: int = 2) -> DataFrame:
    """Exposures (series..., frame, y, x, b, g, r in [0, 1]) to one image: fusion by contrast, colour and exposure; where something moved, the best exposed frame.

    ``deghost``: off, auto or aggressive.  Returns series..., y, x, b, g, r.
    """
    if deghost not in ("off", "auto", "aggressive"):
        raise ValueError(f"deghost is off, auto or aggressive, not {deghost!r}")
    place = [*series, "y", "x"]
    fused = fusion.exposure_fusion(fusion.exposure_weights(colour, series, frame), series, frame, levels)
    flat = fused.groupBy(*place).agg(*[F.max(F.when(F.col("c") == k, F.col("value"))).alias(c) for k, c in enumerate("bgr")])
    if deghost == "off":
        return flat
    gray = colour.select(*series, frame, "y", "x", (fusion.luma() * 255.0).alias("v"))
    moving = fusion.exposure_motion(gray, series, frame, 2.5 if deghost == "aggressive" else 4.0)
    soft = kernels.frame_map(moving, series, lambda m: kernels.blur(m, 4.0), "moving").withColumnRenamed("value", "__m")
    best = colour.join(fusion.reference_exposure(gray, series, frame), [*series, frame]).select(*place, *[F.col(c).alias(f"__{c}") for c in "bgr"])
    out = flat.join(soft, place).join(best, place)
    return out.select(*place, *[(F.col(c) * (1.0 - F.col("__m")) + F.col(f"__{c}") * F.col("__m")).alias(c) for c in "bgr"])


def long_exposure(px: DataFrame, series: list[str], frame: str, mode: str = "smooth", strength: float = 1.0, value: str = "v") -> DataFrame:
    """A series as one long exposure: smooth (mean), clean (sigma clipping), median, trails (lightest), bright (the lights of all frames above the mean).

    ``strength`` of 0 to 1 blends from the middle frame to the whole.  Returns series..., y, x, value.
    """
    place = [*series, "y", "x"]
    methods = {"smooth": "average", "clean": "sigma", "median": "median", "trails": "max"}
    if mode in methods:
        whole = combine.combine(px, place, methods[mode], value)
    elif mode == "bright":
        whole = px.groupBy(*place).agg((0.4 * F.avg(value) + 0.6 * F.max(value)).alias("value"))
    else:
        raise ValueError(f"mode is one of {sorted([*methods, 'bright'])}, not {mode!r}")
    if strength >= 1:
        return whole
    where = numbered(px, series, frame).filter("k = middle").select(*series, frame)
    one = px.join(where, [*series, frame]).select(*place, F.col(value).alias("__one"))
    share = min(1.0, max(0.0, strength))
    return whole.join(one, place, "left").select(*place, (F.col("value") * share + F.coalesce("__one", "value") * (1.0 - share)).alias("value"))


def lucky(px: DataFrame, series: list[str], frame: str, share: float = 0.3, local: bool = True, gains: tuple[float, ...] = (2.0, 1.6, 1.3), step: int = 2, half: int = 2, value: str = "v") -> DataFrame:
    """The best share of a video's frames (place by place if ``local``), averaged and sharpened by wavelets; values in [0, 1].

    Returns series..., y, x, value.
    """
    best = fusion.lucky_map(px, series, frame, step, half, share, value=value) if local else fusion.lucky_stack(px, series, frame, share, value=value)
    return kernels.frame_map(best, series, lambda x: kernels.wavelet_sharpen(x, gains), "value") if gains else best


# --- alignment -----------------------------------------------------------------------------------


def subject_centre(f: np.ndarray, least_area: int = 2000, open_: int = 3) -> tuple[float, float] | None:
    """(x, y) of the largest area that is more colourful than the background and not dark; None without one.

    Colour holds still while focus runs through a subject; sharpness would not.
    """
    top = f.max(axis=2)
    colourful = (top - f.min(axis=2)) / np.maximum(top, 1e-6)
    ground = np.median(colourful)
    spread = np.median(np.abs(colourful - ground)) * 1.4826
    mask = (colourful > ground + max(0.1, 3 * spread)) & (top > 40 / 255)
    side = (2 * open_ + 1,) * 2
    window = lambda m, v: np.lib.stride_tricks.sliding_window_view(np.pad(m, open_, constant_values=v), side)
    label = kernels.components(window(window(mask, False).all(axis=(2, 3)), False).any(axis=(2, 3)))
    if not label.any():
        return None
    sizes = np.bincount(label[label > 0])
    if sizes.max() < least_area:
        return None
    yy, xx = np.nonzero(label == sizes.argmax())
    return float(xx.mean()), float(yy.mean())


def align_on_subject(frames: DataFrame, series: list[str], frame: str, most_shift: float = 0.25, least_area: int = 2000, open_: int = 3) -> DataFrame:
    """series..., frame, m, state of colour frames (h, w, values of b, g, r): the shift that lays each subject on that of the middle frame.

    state: reference, aligned, no subject, too far (more than ``most_shift`` of the long
    side), or no reference subject (then no frame of the series has a move).
    """
    key = [*series, frame]

    def kernel(row: dict) -> dict:
        found = None if row["values"] is None else subject_centre(row["values"], least_area, open_)
        return {"cx": found[0] if found else None, "cy": found[1] if found else None}

    centres = stored(rows.row_map(frames, [*key, "h", "w"], {"cx": "double", "cy": "double"}, kernel))
    placed = numbered(frames, series, frame).join(centres, key)
    ref = placed.filter("k = middle").select(*series, F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    both = placed.join(ref, series)
    far = F.hypot(F.col("rx") - F.col("cx"), F.col("ry") - F.col("cy")) > most_shift * F.greatest("h", "w")
    state = F.when(F.col("rx").isNull(), "no reference subject").when(F.col("k") == F.col("middle"), "reference").when(F.col("cx").isNull(), "no subject").when(far, "too far").otherwise("aligned")
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(one, zero, F.col("rx") - F.col("cx"), zero, one, F.col("ry") - F.col("cy"), zero, zero, one)
    both = both.withColumn("state", state)
    return both.select(*key, F.when(F.col("state").isin("reference", "aligned"), m).alias("m"), "state")


def align_images(frames: DataFrame, series: list[str], frame: str, mode: str = "direct", motion: str = "euclidean", least: float = 0.3) -> DataFrame:
    """series..., frame, m, cc: grey frames (h, w, values) laid on the middle one of their series, by intensities.

    ``direct`` compares each with the middle one; ``sequential`` with its neighbour
    towards it, and chains the moves: neighbours of a focus series look alike where its
    ends do not.  A pair whose coefficient is below ``least`` counts as unmoved in a
    chain, and gives no move otherwise.
    """
    if mode not in ("direct", "sequential"):
        raise ValueError(f"mode is direct or sequential, not {mode!r}")
    key = [*series, frame]
    all_ = stored(frames.select(*key, "h", "w", "values").join(numbered(frames, series, frame), key))
    to = F.col("middle") if mode == "direct" else F.col("k") - 1
    ref = all_.select(*series, F.col("k").alias("__to"), F.col("values").alias("ref"))
    pairs = all_.withColumn("__to", to).withColumnRenamed("values", "mov").join(ref, [*series, "__to"])
    found = stored(refine.refine(pairs, [*key, "k"], motion).withColumn("m", mx.inverse("m")))  # from a frame's places to the other's
    moves = found.withColumn("m", F.when(F.col("cc") >= least, F.col("m")))
    if mode == "direct":
        return moves.select(*key, "m", "cc")
    chain = all_.select(*key, "k").join(moves.select(*key, F.col("m").alias("back"), "cc"), key, "left")
    return align.align_sequential(chain, series).select(*key, "m", "cc")
