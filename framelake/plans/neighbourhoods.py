"""Queries that run NumPy kernels; their SQL is in ``kernel_sql``."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import combine, kernels
from ..sources import tables
from .frames import FRAME, query, rounded
from .kernel_sql import SQL


def _unit_pixels(spark, d):
    return tables.pixels(spark, d).withColumn("v", (F.col("v") + 1.0) / 2.0)


def _per_frame(name: str, kernel):
    @query(name, SQL.get(name))
    def run(spark, d):
        return rounded(kernels.frame_map(_unit_pixels(spark, d), FRAME, kernel), "value")


_per_frame("unsharp_mask", lambda x: kernels.unsharp(x, 60.0, 1.0))
_per_frame("local_contrast", lambda x: kernels.unsharp(x, 30.0, 3.0))
_per_frame("gaussian_blur", lambda x: kernels.blur(x, 1.0))
_per_frame("wavelet_sharpen", lambda x: kernels.wavelet_sharpen(x))
_per_frame("wavelet_denoise", lambda x: kernels.wavelet_sharpen(x, (1.0, 1.0, 1.0), 1.0))
_per_frame("bilateral_denoise", lambda x: kernels.bilateral(x))
_per_frame("guided_refine", lambda x: kernels.guided(x, (x > x.mean()).astype(float)))
_per_frame("deconvolve", lambda x: kernels.richardson_lucy(x, 0.8, 8))
_per_frame("pyramid_energy", lambda x: np.abs(kernels.pyramid(x, 1)[0]))
_per_frame("affine_resample", lambda x: kernels.affine(x, np.array([[0.9, -0.1, 0.5], [0.1, 0.9, 0.2]])))


def _surface(x: np.ndarray) -> np.ndarray:
    """The frame without a smooth surface through its 2x2 tiles' low quartiles; the surface's median stays.

    Tiles clearly above a quadratic trend hold objects and don't count: three rounds,
    2.5 MAD.  Where too few are left, a blur of the frame's 5x5 medians is the surface.
    """
    points, values = [], []
    for ty in range(0, x.shape[0] - 1, 2):
        for tx in range(0, x.shape[1] - 1, 2):
            points.append((ty + 0.5, tx + 0.5))
            values.append(np.percentile(x[ty : ty + 2, tx : tx + 2], 25))
    points, values = np.array(points), np.array(values)
    v, u = (points / x.shape).T
    trend = np.stack((np.ones_like(u), u, v, u * u, u * v, v * v), axis=1)
    keep = np.ones(len(values), dtype=bool)
    for _ in range(3):
        if keep.sum() < 6:
            break
        rest = values - trend @ np.linalg.lstsq(trend[keep], values[keep], rcond=None)[0]
        keep = rest <= 2.5 * (np.median(np.abs(rest - np.median(rest))) * 1.4826 + 1e-6)
    if keep.sum() >= max(8, x.shape[1] // 2):
        at = np.stack(np.mgrid[0 : x.shape[0], 0 : x.shape[1]], axis=-1).reshape(-1, 2).astype(float)
        surface = kernels.thin_plate(points[keep], values[keep], at, 1.0).reshape(x.shape)
    else:
        near = np.lib.stride_tricks.sliding_window_view(np.pad(x, 2, mode="edge"), (5, 5))
        surface = kernels.blur(np.median(near, axis=(2, 3)), max(8.0, min(x.shape) * 0.04))
    return np.clip(x - surface + np.median(surface), 0, 1)


_per_frame("background_extract", _surface)


def _merged(name: str, merge):
    @query(name, SQL.get(name))
    def run(spark, d):
        return rounded(merge(_unit_pixels(spark, d), ["series_id"], "seq"), "v")


_merged("pyramid_merge", kernels.pyramid_merge_series)
_merged("wavelet_merge", kernels.wavelet_merge_series)
_merged("envelope_merge", kernels.envelope_merge_series)
_merged("tree_merge", lambda px, series, frame: kernels.series_map(px, series, frame, lambda s: kernels.tree_merge(s, np.maximum)))


@query("drizzle_stack", SQL["drizzle_stack"])
def drizzle_stack(spark, d):
    """Each frame on a grid twice as fine, shifted by its number; then flux by weight as a plain aggregate."""
    px = _unit_pixels(spark, d).withColumns({"dy": (F.col("seq") % 3 - 1) * 0.25, "dx": (F.col("seq") % 5 - 2) * 0.125})

    def run(key, pdf):
        import pandas as pd

        image = np.zeros((8, 8))
        image[pdf["y"], pdf["x"]] = pdf["v"]
        out = kernels.drizzle(image[None], [(pdf["dy"].iloc[0], pdf["dx"].iloc[0])], 2, 0.7)
        yy, xx = np.nonzero(out)
        return pd.DataFrame({"series_id": int(key[0]), "y": yy, "x": xx, "value": out[yy, xx]})

    out = px.groupBy(*FRAME).applyInPandas(run, "series_id bigint, y bigint, x bigint, value double")
    return rounded(combine.average(out, ["series_id", "y", "x"], "value"), "value")


@query("global_shift", SQL["global_shift"])
def global_shift(spark, d):
    """Phase correlation of each frame with the first one of its series."""
    px = _unit_pixels(spark, d)
    first = px.groupBy("series_id").agg(F.min("seq").alias("seq"))
    ref = px.join(first, FRAME).select("series_id", "y", "x", F.col("v").alias("rv"))

    def run(key, pdf):
        import pandas as pd

        a, b = np.zeros((8, 8)), np.zeros((8, 8))
        a[pdf["y"], pdf["x"]], b[pdf["y"], pdf["x"]] = pdf["rv"], pdf["v"]
        dy, dx = kernels.phase_shift(a, b)
        return pd.DataFrame({"series_id": [int(key[0])], "seq": [int(key[1])], "dy": [dy], "dx": [dx]})

    return px.join(ref, ["series_id", "y", "x"]).groupBy("series_id", "seq").applyInPandas(run, "series_id bigint, seq bigint, dy bigint, dx bigint")


@query("star_centroids", SQL["star_centroids"])
def star_centroids(spark, d):
    def run(key, pdf):
        import pandas as pd

        image = np.zeros((8, 8))
        image[pdf["y"], pdf["x"]] = pdf["v"]
        found = kernels.stars(image, 20, 1.5)
        return pd.DataFrame([(int(key[0]), int(key[1]), k, *s) for k, s in enumerate(found)], columns=["series_id", "seq", "id", "x", "y", "area"])

    found = _unit_pixels(spark, d).groupBy("series_id", "seq").applyInPandas(run, "series_id bigint, seq bigint, id bigint, x double, y double, area bigint")
    return rounded(found, "x", "y")


@query("crop_to_overlap", SQL["crop_to_overlap"])
def crop_to_overlap(spark, d):
    """The largest rectangle of pixels that are valid in all frames, per series."""
    valid = tables.pixels(spark, d).groupBy("series_id", "y", "x").agg(F.bool_and(F.col("v") > -0.3).alias("ok"))

    def run(key, pdf):
        import pandas as pd

        mask = np.zeros((8, 8), dtype=bool)
        mask[pdf["y"], pdf["x"]] = pdf["ok"]
        return pd.DataFrame([(int(key[0]), *map(int, kernels.largest_rectangle(mask)))], columns=["series_id", "y", "x", "h", "w"])

    return valid.groupBy("series_id").applyInPandas(run, "series_id bigint, y bigint, x bigint, h bigint, w bigint")


def frame_points(values, shift: float = 0.0) -> np.ndarray:
    """A frame's points: its pixels' values as coordinates."""
    k = np.arange(len(values))
    return np.stack((k * 37 % 101 + np.asarray(values, dtype=float) * 4 + shift, k * 53 % 97 - shift), axis=1)


def similarities(pairs, kept: str | None = None, head: str | None = None):
    """Similarity from each mov's points, moved by 7.5, to those of ref (series_id, ref, mov, rv, mv): triangle votes, one-to-one pairs, sample consensus.

    ``kept`` (bigint) is a column that stays.  With ``head`` (boolean: ref is the frame
    that all others seek), a pair may be left out if both its frames were found to reach
    that one, by ``kept`` points or more: pairs with it win, so no best spanning tree has the other.
    """
    more = [kept] if kept else []

    def run(batches):
        import pandas as pd

        reached = deque(maxlen=2)  # the last frames found so; pairs come in the order of mov
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if head and not r[head] and all((r["series_id"], r[c]) in reached for c in ("ref", "mov")):
                    continue
                ref, mov = frame_points(r["rv"]), frame_points(r["mv"], 7.5)
                i, j = kernels.match_triangles(ref, mov)
                m, good = kernels.ransac(mov[j], ref[i], 1.0)
                m = None if m is None else m.round(6)
                if head and r[head] and r["mov"] != r["ref"] and m is not None and good.sum() >= r[kept] and abs(np.linalg.det(m[:, :2])) >= 1e-9:
                    reached.append((r["series_id"], r["mov"]))
                rows.append((r["series_id"], r["ref"], r["mov"], *([np.nan] * 6 if m is None else m.ravel().tolist()), int(good.sum()), *(r[c] for c in more)))
            yield pd.DataFrame(rows, columns=["series_id", "ref", "mov", "a", "b", "tx", "c", "d", "ty", "inliers", *more])

    # A pair costs much more than its few bytes tell: dealt anew, so that these are not joined into one task.
    # In the order of frames, so that a frame's triangles, which are kept for the next few pairs, are found once.
    tasks = 4 * pairs.sparkSession.sparkContext.defaultParallelism
    order = ["series_id", "mov", *([F.col(head).desc()] if head else []), "ref"]
    pairs = pairs.select("series_id", "ref", "mov", "rv", "mv", *more, *([head] if head else [])).repartitionByRange(tasks, "series_id", "mov").sortWithinPartitions(*order)
    made = "series_id bigint, ref bigint, mov bigint, a double, b double, tx double, c double, d double, ty double, inliers bigint"
    return pairs.mapInPandas(run, made + "".join(f", {c} bigint" for c in more))


@query("robust_registration")
def robust_registration(spark, d):
    """Each frame to the one before it in its series."""
    order = Window.partitionBy("label").orderBy("vec_id")
    e = tables.table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("series_id"), F.lag("vec_id").over(order).alias("ref"), F.col("vec_id").alias("mov"), F.lag("embedding").over(order).alias("rv"), F.col("embedding").alias("mv"))
    return similarities(e.filter("ref IS NOT NULL"))
