"""Stars of frames that come as array rows: tables of stars, the shape of a point, frames without stars, stacks with points.

Detection, cut-outs and fills look at one frame; what is combined over frames are
short sums (a cut-out per frame, or a value per pixel), added up before they are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as mx
from . import kernels, rows

#: Blobs larger than this are nebulae, not stars.
MOST_AREA = 600
#: Least and most width by height of a star's box.
ROUND = (0.3, 3.3)
#: Pixels of a frame's background mesh, each way.
MESH = 32


def background(x: np.ndarray, mesh: int = MESH) -> np.ndarray:
    """Medians of a mesh of tiles, joined linearly."""
    edges = [np.linspace(0, n, max(1, n // mesh) + 1).astype(int) for n in x.shape]
    tiles = np.array([[np.median(x[a:b, c:d]) for c, d in zip(edges[1], edges[1][1:])] for a, b in zip(edges[0], edges[0][1:])])
    mid = [(e[:-1] + e[1:] - 1) / 2 for e in edges]
    down = np.stack([np.interp(np.arange(x.shape[0]), mid[0], c) for c in tiles.T], axis=1)
    return np.stack([np.interp(np.arange(x.shape[1]), mid[1], r) for r in down])


def detect(x: np.ndarray, factor: float = 5.0, most_area: int = MOST_AREA, least_area: int = 1) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Stars by falling flux (x, y, flux, peak, area, fwhm, elongation), and the mask of their pixels.

    A star is a connected blob more than ``factor`` MADs above the background, neither
    too large nor too long.  Width and elongation come from its second moments, the
    brightness above background being the weight.
    """
    rest = x - background(x)
    mid = np.median(rest)
    rest = rest - mid
    label = kernels.components(rest > factor * max(np.median(np.abs(rest)) * 1.4826, 1e-6))
    yy, xx = np.nonzero(label)
    names, at = np.unique(label[yy, xx], return_inverse=True)
    n = len(names)
    w = rest[yy, xx]
    total = lambda v: np.bincount(at, v, n)
    area, flux = np.bincount(at, minlength=n), total(w)
    cx, cy = total(w * xx) / np.maximum(flux, 1e-12), total(w * yy) / np.maximum(flux, 1e-12)
    dx, dy = xx - cx[at], yy - cy[at]
    a, b, c = (total(w * q) / np.maximum(flux, 1e-12) for q in (dx * dx, dx * dy, dy * dy))
    root = np.sqrt(((a - c) / 2) ** 2 + b * b)
    major, minor = np.maximum((a + c) / 2 + root, 1e-3), np.maximum((a + c) / 2 - root, 1e-3)
    low, high = np.full((2, n), 1 << 30), np.full((2, n), -1)
    peak = np.zeros(n)
    for k, place in enumerate((yy, xx)):
        np.minimum.at(low[k], at, place)
        np.maximum.at(high[k], at, place)
    np.maximum.at(peak, at, x[yy, xx])
    h, wide = high - low + 1
    good = (area >= least_area) & (area <= most_area) & (wide >= ROUND[0] * h) & (wide <= ROUND[1] * h) if n else np.zeros(0, dtype=bool)
    order = np.flatnonzero(good)[np.lexsort((cy[good], cx[good], -flux[good]))]
    found = {"x": cx, "y": cy, "flux": flux, "peak": peak, "area": area, "fwhm": 2.3548 * np.sqrt((major + minor) / 2), "elongation": np.sqrt(major / minor)}
    mask = np.zeros(x.shape, dtype=bool)
    if n:
        mask[yy[good[at]], xx[good[at]]] = True
    return {k: v[order] for k, v in found.items()}, mask


def star_table(frames: DataFrame, keep: list[str], factor: float = 5.0, least_area: int = 3) -> DataFrame:
    """A row per star of each frame (keep..., h, w, values): keep..., id (0 is the brightest), x, y, flux, peak, area, fwhm, elongation.

    Frames without stars, or without values, have no rows.
    """
    names = ["x", "y", "flux", "peak", "area", "fwhm", "elongation"]

    def kernel(row: dict) -> dict:
        found = detect(row["values"], factor, least_area=least_area)[0] if row["values"] is not None else {}
        return {k: np.asarray(found.get(k, np.zeros(0)), dtype=float) for k in names}

    lists = rows.row_map(frames, keep, {k: "array<double>" for k in names}, kernel)
    one = lists.select(*keep, F.posexplode(F.arrays_zip(*names)).alias("id", "s"))
    return one.select(*keep, F.col("id").cast("bigint").alias("id"), *[F.col(f"s.{k}").cast("bigint" if k == "area" else "double").alias(k) for k in names])


def frame_quality(frames: DataFrame, keep: list[str], factor: float = 5.0) -> DataFrame:
    """keep..., stars, fwhm, elongation (medians; 99 and 9 without stars) and background (the median value) of every frame."""

    def kernel(row: dict) -> dict:
        if row["values"] is None:
            return {"stars": 0, "fwhm": 99.0, "elongation": 9.0, "background": None}
        found = detect(row["values"], factor, least_area=3)[0]
        n = len(found["x"])
        return {"stars": n, "fwhm": float(np.median(found["fwhm"])) if n else 99.0, "elongation": float(np.median(found["elongation"])) if n else 9.0, "background": float(np.median(row["values"]))}

    return rows.row_map(frames, keep, {"stars": "bigint", "fwhm": "double", "elongation": "double", "background": "double"}, kernel)


def cut_out(x: np.ndarray, cx: float, cy: float, size: int) -> np.ndarray | None:
    """size x size pixels around a place between pixels (bilinear); None at the edge."""
    half = size // 2
    if not (half + 1 <= cx < x.shape[1] - half - 1 and half + 1 <= cy < x.shape[0] - half - 1):
        return None
    ix, iy = int(np.floor(cx)), int(np.floor(cy))
    fx, fy = cx - ix, cy - iy
    p = x[iy - half : iy + half + 2, ix - half : ix + half + 2]
    across = p[:, :-1] * (1 - fx) + p[:, 1:] * fx
    return across[:-1] * (1 - fy) + across[1:] * fy


def point_shape(frames: DataFrame, series: list[str], size: int = 21, most: int = 80, least: int = 8) -> DataFrame:
    """series..., y, x, value: the mean shape of a series' stars, size x size, of sum 1; and stars, their number.

    ``size`` is odd.  Per frame the brightest ``most`` stars that do not saturate (peaks
    of 5 to 90 % of the frame's) are cut out around their centres, freed of the local
    median and brought to sum 1; a frame hands on the sum of its cut-outs.  A series
    with fewer than ``least`` stars gets a Gaussian of a sixth of the size.
    """

    def kernel(row: dict) -> dict:
        total, n = np.zeros((size, size)), 0
        x = row["values"]
        if x is not None and x.size:
            found, top = detect(x, least_area=3)[0], x.max()
            for cx, cy, peak in zip(found["x"], found["y"], found["peak"]):
                p = cut_out(x, cx, cy, size) if 0.05 * top < peak < 0.9 * top and n < most else None
                if p is not None:
                    p = np.clip(p - np.median(p), 0, None)
                    if p.sum() > 1e-6:
                        total, n = total + p / p.sum(), n + 1
        return {"cut": total, "n": n}

    cuts = rows.row_map(frames, series, {"cut": "array<double>", "n": "bigint"}, kernel)
    sums = cuts.select(*series, "n", F.posexplode("cut").alias("at", "v")).groupBy(*series, "at").agg(F.sum("v").alias("v"), F.sum("n").alias("stars"))
    half, sigma = size // 2, size / 6.0
    bell = [np.exp(-((k - half) ** 2) / (2 * sigma**2)) for k in range(size)]
    scale = sum(bell) ** 2
    place = {"y": F.expr(f"CAST(at DIV {size} AS INT)"), "x": F.expr(f"CAST(at % {size} AS INT)")}
    plain = F.exp(-(F.pow(F.col("y") - half, F.lit(2.0)) + F.pow(F.col("x") - half, F.lit(2.0))) / (2 * sigma**2)) / scale
    value = F.when(F.col("stars") >= least, F.col("v") / F.col("stars")).otherwise(plain)
    return sums.withColumns(place).select(*series, "y", "x", value.alias("value"), "stars")


def filled(x: np.ndarray, hole: np.ndarray, rounds: int = 8) -> np.ndarray:
    """``x`` with its holes filled from around them: means of what is known at ever coarser scales, then a few steps of diffusion."""
    if not hole.any() or hole.all():
        return x.copy()
    levels = [(np.where(hole, 0.0, x), (~hole).astype(float))]
    while min(levels[-1][0].shape) > 2 and (levels[-1][1] < 0.05).any():
        levels.append(tuple(kernels.halve(v) for v in levels[-1]))
    value, weight = levels[-1]
    known = np.average(x[~hole])
    guess = np.where(weight > 1e-3, value / np.maximum(weight, 1e-3), known)
    for value, weight in reversed(levels[:-1]):
        w = np.clip(weight, 0, 1)
        guess = np.where(w > 0.05, value / np.maximum(weight, 0.05) * np.minimum(1, w) + kernels.double(guess, value.shape) * (1 - np.minimum(1, w)), kernels.double(guess, value.shape))
    out = np.where(hole, guess, x)
    for _ in range(rounds):
        p = np.pad(out, 1, mode="edge")
        out = np.where(hole, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, x)
    return out


def without_stars(x: np.ndarray, factor: float = 5.0, most_area: int = MOST_AREA, grow: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The frame with its stars filled in, and the mask (stars and ``grow`` pixels of halo around them)."""
    mask = detect(x, factor, most_area)[1]
    for _ in range(grow):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return filled(x, mask), mask


def remove_stars(frames: DataFrame, keep: list[str], factor: float = 5.0, most_area: int = MOST_AREA, grow: int = 2) -> DataFrame:
    """keep..., h, w, values (without stars) and mask (1 where a star was) of every frame; a frame without values stays without."""

    def kernel(row: dict) -> dict:
        if row["values"] is None:
            return {"values": None, "mask": None}
        out, mask = without_stars(row["values"], factor, most_area, grow)
        return {"values": out, "mask": mask.astype(float)}

    return rows.row_map(frames, [*dict.fromkeys([*keep, "h", "w"])], {"values": "array<double>", "mask": "array<double>"}, kernel)


def moved_frames(frames: DataFrame, series: list[str], frame: str, moves: DataFrame) -> DataFrame:
    """series..., frame, h, w, moved: each frame (series..., frame, h, w, values) laid onto its reference by ``moves`` (series..., frame, m).

    Bilinear; not a number where the frame has nothing.  Frames without a move, or
    without values, are left out.
    """
    both = frames.join(moves.select(*series, frame, mx.inverse("m").alias("__back")), [*series, frame], "left").filter("__back IS NOT NULL AND values IS NOT NULL")

    def kernel(row: dict) -> dict:
        x, m = row["values"], np.array(row["__back"]).reshape(3, 3)[:2]
        return {"moved": np.where(kernels.affine(np.ones(x.shape), m) > 0.999, kernels.affine(x, m), np.nan)}

    return rows.row_map(both, [*series, frame, "h", "w", "__back"], {"moved": "array<double>"}, kernel).drop("__back")


def remapped(x: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Values at places (sx, sy), bilinear; not a number outside."""
    inside = (sx >= 0) & (sy >= 0) & (sx <= x.shape[1] - 1) & (sy <= x.shape[0] - 1)
    ix, iy = np.clip(np.floor(sx).astype(int), 0, max(0, x.shape[1] - 2)), np.clip(np.floor(sy).astype(int), 0, max(0, x.shape[0] - 2))
    fx, fy = sx - ix, sy - iy
    jx, jy = np.minimum(ix + 1, x.shape[1] - 1), np.minimum(iy + 1, x.shape[0] - 1)
    above, below = x[iy, ix] * (1 - fx) + x[iy, jx] * fx, x[jy, ix] * (1 - fx) + x[jy, jx] * fx
    return np.where(inside, above * (1 - fy) + below * fy, np.nan)


def bend(x: np.ndarray, ref: np.ndarray, factor: float = 5.0, within: float = 6.0, least: int = 12, smallest: float = 0.5, mesh: int = 48) -> tuple[np.ndarray, int, float]:
    """``x`` bent by a thin-plate spline so that its stars fall on the reference's (n x 2): (frame, pairs, median distance before).

    Every reference star takes the nearest star ``within`` pixels.  With fewer than
    ``least`` pairs, or when they lie within ``smallest`` pixels in the median, the frame
    stays as it is.  The spline is evaluated on a mesh and joined linearly: it is smooth.
    """
    found = detect(np.nan_to_num(x, nan=float(np.nanmedian(x)) if np.isfinite(x).any() else 0.0), factor, least_area=3)[0]
    own = np.stack((found["x"], found["y"]), axis=1)
    if len(own) < least or len(ref) < least:
        return x, 0, 0.0
    apart = np.hypot(*(ref[:, None] - own[None]).transpose(2, 0, 1))
    near, at = apart.min(axis=1), apart.argmin(axis=1)
    pairs = np.flatnonzero(near < within)
    if len(pairs) < least or np.median(near[pairs]) < smallest:
        return x, len(pairs), float(np.median(near[pairs])) if len(pairs) else 0.0
    xs, ys = (np.linspace(0, n - 1, min(mesh, n)) for n in (x.shape[1], x.shape[0]))
    points = np.stack(np.meshgrid(xs, ys), axis=2).reshape(-1, 2)
    shift = [kernels.thin_plate(ref[pairs], own[at[pairs], c] - ref[pairs, c], points, 1.0).reshape(len(ys), len(xs)) for c in (0, 1)]
    yy, xx = np.mgrid[0 : x.shape[0], 0 : x.shape[1]].astype(float)

    def whole(grid: np.ndarray) -> np.ndarray:
        down = np.stack([np.interp(np.arange(x.shape[0]), ys, c) for c in grid.T], axis=1)
        return np.stack([np.interp(np.arange(x.shape[1]), xs, r) for r in down])

    return remapped(x, xx + whole(shift[0]), yy + whole(shift[1])), len(pairs), float(np.median(near[pairs]))


def bent_frames(moved: DataFrame, series: list[str], frame: str, reference: DataFrame, column: str = "moved", most: int = 150, factor: float = 5.0) -> DataFrame:
    """series..., frame, h, w, ``column``, pairs, apart: moved frames, bent by what is left between their stars and the reference's.

    ``reference``: a row per star of each series' reference (series..., id, x, y), the brightest
    ``most`` of which count: a list that is bounded, and joined by series.
    """
    lists = reference.filter(F.col("id") < most).groupBy(*series).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "x", "y"))), lambda s: F.array(s["x"], s["y"]))).alias("__ref"))
    both = moved.join(lists, series, "left")

    def kernel(row: dict) -> dict:
        x = row[column]
        if x is None:
            return {column: None, "pairs": 0, "apart": 0.0}
        out, pairs, apart = bend(x, np.array(row["__ref"] or [], dtype=float).reshape(-1, 2), factor)
        return {column: out, "pairs": pairs, "apart": apart}

    keep = [*series, frame, "h", "w"]
    both = both.withColumnRenamed(column, "__in")
    made = {column: "array<double>", "pairs": "bigint", "apart": "double"}
    return rows.row_map(both, [*keep, "__ref"], made, lambda r: kernel({**r, column: r["__in"]}), ("__in",)).drop("__ref")


def point_stars(frames: DataFrame, series: list[str], frame: str, moves: DataFrame, horizon: float | None = None, feather: float = 8.0) -> DataFrame:
    """series..., y, x, value: stars as points above a ground that stands still.

    ``frames``: series..., frame, h, w, values.  ``moves``: series..., frame, m (3x3, from
    the frame's places to the reference's; null where none is safe).  The sky is the mean
    of the moved frames, without those that have no move; the ground is the plain mean
    of all.  They meet at row ``horizon`` over ``feather`` rows; without one, all is sky.
    Places that no moved frame covers are taken from the ground.
    """
    moved = moved_frames(frames, series, frame, moves)
    sky = rows.pixels(moved, series, ["sky"], "moved").filter("NOT isnan(sky)").groupBy(*series, "y", "x").agg(F.avg("sky").alias("sky"))
    ground = rows.pixels(frames.filter("values IS NOT NULL"), series, ["ground"]).groupBy(*series, "y", "x").agg(F.avg("ground").alias("ground"))
    share = F.lit(1.0) if horizon is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.lit(float(horizon)) - F.col("y")) / feather))
    mixed = F.col("sky") * share + F.col("ground") * (1.0 - share)
    return ground.join(sky, [*series, "y", "x"], "left").select(*series, "y", "x", F.coalesce(mixed, F.col("ground")).alias("value"))
