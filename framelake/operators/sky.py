"""Catalogues on frames: which stars of a catalogue a frame shows, where, and what its own stars are called."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from . import match


def on_frames(catalogue: DataFrame, frames: DataFrame, keep: list[str], radius: float) -> DataFrame:
    """Stars of ``catalogue`` (ra, dec in degrees, and more) on ``frames`` (keep..., h, w, and sky.CARDS): all columns of the catalogue, keep..., x, y.

    ``radius`` is the largest distance in degrees (below 90) from a frame's reference
    place to one of its corners.  Both sides get cells of unit vectors, a frame those
    around its own, so they meet in an equi-join without seams in right ascension or at
    the poles.  Places that are null, or frames without a projection, match nothing.
    """
    size = max(2 * math.sin(math.radians(min(radius, 89.0)) / 2), 1e-6)
    place, centre = sky.direction(F.col("ra"), F.col("dec")), sky.direction(F.col("crval1"), F.col("crval2"))
    stars, views = catalogue, frames.select(*keep, "h", "w", *sky.CARDS)
    on = []
    for k in range(3):
        stars = stars.withColumn(f"__s{k}", F.floor(place[k] / size))
        cell = F.floor(centre[k] / size)
        views = views.withColumn(f"__v{k}", F.explode(F.array(cell - 1, cell, cell + 1)))
        on.append(F.col(f"__s{k}") == F.col(f"__v{k}"))
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"))
    both = stars.join(views, on).withColumns({"x": x, "y": y})
    inside = (F.col("x") >= -0.5) & (F.col("y") >= -0.5) & (F.col("x") < F.col("w") - 0.5) & (F.col("y") < F.col("h") - 0.5)
    return both.filter(inside).select(*catalogue.columns, *keep, "x", "y")


def named_stars(shown: DataFrame, stars: DataFrame, keep: list[str], name: str, within: float = 3.0) -> DataFrame:
    """Frames' own stars (keep..., id, x, y, and more) with the nearest catalogue star ``within`` pixels: the stars' columns, ``name``, distance.

    ``shown`` is the result of ``on_frames``.  Stars with no partner are left out; of
    equal distances the smaller name wins.
    """
    mine = stars.select(*[F.col(k).alias(f"__{k}") for k in keep], F.struct(*stars.columns).alias("__star"), F.col("id").alias("__id"), F.col("x").alias("__mx"), F.col("y").alias("__my"))
    theirs = shown.select(*keep, name, F.col("x").alias("__tx"), F.col("y").alias("__ty"))
    pairs = match.range_join(mine, theirs, [("__mx", "__tx"), ("__my", "__ty")], within, keys=[(f"__{k}", k) for k in keep])
    pairs = pairs.withColumn("distance", F.hypot(F.col("__mx") - F.col("__tx"), F.col("__my") - F.col("__ty"))).filter(F.col("distance") < within)
    best = match.nearest(pairs, [*(f"__{k}" for k in keep), "__id"], "distance", name)
    return best.select("__star.*", name, "distance")


def colour_gains(named: DataFrame, series: list[str], expected: str, least: int = 10, low: float = 0.4, high: float = 2.5) -> DataFrame:
    """series..., channel, gain, n: the median by which a channel's fluxes (columns channel, flux, id of a frame's star) miss the catalogue's (``expected``), against green.

    A channel with fewer than ``least`` stars has no gain.
    """
    ratio = named.filter("flux > 0").groupBy(*series, "channel").agg(F.median(F.col(expected) / F.col("flux")).alias("ratio"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    green = ratio.filter("channel = 'g'").select(*series, F.col("ratio").alias("green"))
    return ratio.join(green, series).select(*series, "channel", F.least(F.lit(high), F.greatest(F.lit(low), F.col("ratio") / F.col("green"))).alias("gain"), "n")
