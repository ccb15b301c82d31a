"""Queries from sensor data to colour, radiance, trails and sub-pixel moves; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, radiance, refine, rows, sensor, stars, trails
from ..sources import tables
from . import kernel_sql as k
from .alignment import CELLS, cells
from .frames import FRAME, PX, query, rounded

_COLOUR = "substr(p, CAST({t}.y % 2 * 2 + {t}.x % 2 + 1 AS INT), 1)"
#: Each of the four patterns tried on each frame (dm: a row per pixel and channel), and its score per series.
MOSAIC = f"""{k.UNIT}, pt AS (SELECT * FROM (VALUES (0, 'RGGB'), (1, 'BGGR'), (2, 'GRBG'), (3, 'GBRG')) t(o, p)), cl AS (SELECT unnest(['B', 'G', 'R']) AS c),
 dm AS MATERIALIZED (SELECT o, p, c, a.series_id, a.seq, a.y, a.x, CASE WHEN {_COLOUR.format(t="a")} = c THEN a.v ELSE avg(n.v) FILTER (WHERE {_COLOUR.format(t="n")} = c) END AS v
  FROM u a JOIN u n ON n.series_id = a.series_id AND n.seq = a.seq AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1, pt, cl GROUP BY o, p, c, a.series_id, a.seq, a.y, a.x, a.v),
 cr AS MATERIALIZED (SELECT *, v - avg(v) OVER (PARTITION BY o, series_id, seq, y, x) AS h FROM dm),
 lp AS (SELECT a.o, a.p, a.c, a.series_id, a.seq, a.y, a.x, abs(sum(n.h) - 4 * a.h) AS l FROM cr a, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx), cr n
  WHERE n.o = a.o AND n.c = a.c AND n.series_id = a.series_id AND n.seq = a.seq AND n.y = {k.mirror("a.y + dy", 8)} AND n.x = {k.mirror("a.x + dx", 8)} GROUP BY a.o, a.p, a.c, a.series_id, a.seq, a.y, a.x, a.h),
 sf AS (SELECT o, p, series_id, seq, avg(l) AS s FROM lp GROUP BY ALL), ss AS (SELECT o, p, series_id, sum(s) AS score FROM sf GROUP BY ALL),
 sb AS (SELECT *, score <= min(score) OVER (PARTITION BY series_id) * (1 + 1e-9) AS least FROM ss), sp AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY least DESC, o) = 1 AS chosen FROM sb)"""


@query("cfa_pattern", f"WITH {MOSAIC} SELECT series_id, p AS pattern, round(score, 6) + 0.0 AS score, chosen FROM sp")
def cfa_pattern(spark, d):
    """Scores of the four colour patterns over all frames of a series, read as mosaics."""
    return rounded(sensor.pattern_scores(tables.array_frames(spark, d), ["series_id"]), "score")


@query(
    "debayer",
    f"WITH {MOSAIC} SELECT series_id, seq, y, x, " + ", ".join(f"round(max(v) FILTER (c = '{c}'), 6) + 0.0 AS {c.lower()}" for c in "BGR") + " FROM dm JOIN sp USING (series_id, o) WHERE chosen GROUP BY ALL",
)
def debayer(spark, d):
    """Every frame, read as a mosaic, in colour by the pattern of its series."""
    colour = sensor.debayered(tables.array_frames(spark, d), ["series_id"], "seq")
    return rounded(rows.pixels(colour, FRAME, ["b", "g", "r"]), "b", "g", "r")


LINES = f"""{PX}, ct AS (SELECT series_id, seq, median(v) + 1.0 * (stddev_pop(v) + 1e-6) AS c FROM px GROUP BY ALL), br AS (SELECT px.* FROM px JOIN ct USING (series_id, seq) WHERE v > c),
 vo AS (SELECT series_id, seq, y, x, a AS angle, y * cos(radians(a)) - x * sin(radians(a)) AS along, CAST(floor(x * cos(radians(a)) + y * sin(radians(a)) + 0.5 + 1e-9) AS BIGINT) AS rho FROM br, range(180) t(a)),
 ln AS (SELECT *, count(*) OVER (PARTITION BY series_id, seq, angle, rho) AS votes, along - lag(along) OVER w AS gap FROM vo WINDOW w AS (PARTITION BY series_id, seq, angle, rho ORDER BY along, y, x)),
 pc AS (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, seq, angle, rho ORDER BY along, y, x) AS piece FROM ln WHERE votes >= 4),
 sg AS (SELECT series_id, seq, angle, rho, votes, max(along) - min(along) AS length FROM pc GROUP BY series_id, seq, angle, rho, votes, piece)"""


@query("trail_lines", f"WITH {LINES} SELECT series_id, seq, angle, rho, votes, round(length, 6) + 0.0 AS length FROM sg WHERE length >= 4 - 1e-9")
def trail_lines(spark, d):
    """Lines of four bright pixels or more with gaps up to 2, over half of the frame."""
    bright = trails.bright_pixels(tables.pixels(spark, d), FRAME, 1.0)
    return rounded(trails.lines(bright, FRAME, 4, 4.0, 2.0), "length")


@query("detect_trails", f"WITH {LINES}, tr AS (SELECT DISTINCT series_id, seq FROM sg WHERE length >= 0.7 * 8 - 1e-9) SELECT DISTINCT px.series_id, px.seq, tr.seq IS NOT NULL AS trail FROM px LEFT JOIN tr USING (series_id, seq)")
def detect_trails(spark, d):
    return rounded(trails.detect_trails(tables.pixels(spark, d), FRAME, 1.0, 4, 0.7, 2.0))


def _exposures(spark, d):
    """Pixels in 32 levels; exposures of one, two or three units by frame."""
    level = F.least(F.floor((F.col("v") + 1.0) / 2.0 * 32), F.lit(31)).cast("int")
    return tables.pixels(spark, d).select("series_id", "y", "x", F.greatest(level, F.lit(0)).alias("z"), (1.0 + F.col("seq") % 3).alias("t"))


EXPOSURES = f"{PX}, ex AS (SELECT series_id, y, x, greatest(least(CAST(floor((v + 1) / 2 * 32) AS INT), 31), 0) AS z, 1.0 + seq % 3 AS t FROM px)"


@query(
    "response_equations",
    f"""WITH {EXPOSURES}, bl AS (SELECT series_id, y, x, z, sum(pow(least(z, 31 - z) + 1, 2)) AS d, sum(pow(least(z, 31 - z) + 1, 2) * ln(t)) AS dt FROM ex GROUP BY ALL),
 bp AS (SELECT series_id, y, x, sum(d) AS s, sum(dt) AS q FROM bl GROUP BY ALL),
 ce AS (SELECT a.series_id, a.z, b.z AS z2, (CASE WHEN a.z = b.z THEN a.d ELSE 0 END) - a.d * b.d / s AS a FROM bl a JOIN bl b USING (series_id, y, x) JOIN bp USING (series_id, y, x)
  UNION ALL SELECT bl.series_id, z, -1, dt - d * q / s FROM bl JOIN bp USING (series_id, y, x))
 SELECT series_id, CAST(z AS BIGINT) AS z, CAST(z2 AS BIGINT) AS z2, round(sum(a), 6) + 0.0 AS a FROM ce GROUP BY ALL""",
)
def response_equations(spark, d):
    """The normal equations of each series' response curve, over all pixels and frames."""
    return rounded(radiance.normal_equations(_exposures(spark, d), ["series_id"], ["y", "x"], 32), "a")


@query("response_curve")
def response_curve(spark, d):
    """The curve that solves ``response_equations``; the tests hold it against the full system and known curves."""
    return rounded(radiance.response_curve(_exposures(spark, d), ["series_id"], ["y", "x"], 32), "g")


@query("radiance_response")
def radiance_response(spark, d):
    """Radiance by the recovered curve (``radiance_merge`` takes a linear one)."""
    px = _exposures(spark, d)
    curve = radiance.response_curve(px, ["series_id"], ["y", "x"], 32)
    return rounded(radiance.radiance(px, curve, ["series_id"], ["y", "x"], 32), "value")


def _to_first(spark, d):
    """Every frame beside the first one of its series, as arrays."""
    frames = tables.array_frames(spark, d)
    first = frames.groupBy("series_id").agg(F.min_by("values", "seq").alias("ref"))
    return frames.join(first, "series_id").withColumnRenamed("values", "mov")


@query("ecc_refine")
def ecc_refine(spark, d):
    """Sub-pixel move of each frame to the first one of its series; moves and coefficients are tested on frames that are known to have moved."""
    out = cells(refine.refine(_to_first(spark, d), FRAME, "translation"))
    return rounded(out.select(*FRAME, *CELLS, "cc"), *CELLS, "cc")


@query("align_pairs")
def align_pairs(spark, d):
    """Every frame laid onto the first one of its series."""
    out = refine.align_pairs(_to_first(spark, d), FRAME, "translation")
    return rounded(rows.pixels(out, [*FRAME, "cc"], ["value"]), "cc", "value")


@query("star_table")
def star_table(spark, d):
    """Every frame's stars above its background, with widths and elongations; tested on skies that are known."""
    found = stars.star_table(tables.array_frames(spark, d), FRAME, 1.5, 2)
    return rounded(found, "x", "y", "flux", "peak", "fwhm", "elongation")


@query("point_shape")
def point_shape(spark, d):
    """Mean shape of the stars of each series, 3 x 3."""
    return rounded(stars.point_shape(tables.array_frames(spark, d), ["series_id"], 3), "value")


@query("remove_stars")
def remove_stars(spark, d):
    """Every frame with its bright blobs filled from around them."""
    out = stars.remove_stars(tables.array_frames(spark, d), FRAME, 2.0, 12, 0)
    return rounded(rows.pixels(out, FRAME, ["value"]), "value")


@query("point_stars")
def point_stars(spark, d):
    """The upper half of each series stacked along its chained moves, the lower half as it stands."""
    steps = align.moment_steps(align.frame_moments(tables.pixels(spark, d).withColumn("v", (F.col("v") + 1.0) / 2.0), FRAME), ["series_id"], ["seq"])
    moves = align.align_sequential(steps, ["series_id"])
    out = stars.point_stars(tables.array_frames(spark, d), ["series_id"], "seq", moves.withColumn("m", F.when(F.col("failed") == 0, F.col("m"))), 4.0, 2.0)
    return rounded(out, "value")
