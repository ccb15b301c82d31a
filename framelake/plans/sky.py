"""Queries on world coordinates: nations as frames on the sky, customers as a catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky as projection
from ..operators import sky
from ..sources import tables
from .frames import query, rounded

VIEWS = """fr AS (SELECT CAST(n_nationkey AS BIGINT) AS frame, 900 AS h, 1200 AS w, n_nationkey * 14.4 AS crval1, (n_nationkey * 37) % 179 - 89.0 AS crval2, 600.5 AS crpix1, 450.5 AS crpix2,
  -0.02 * cos(radians(n_nationkey * 15)) AS cd11, 0.02 * sin(radians(n_nationkey * 15)) AS cd12, 0.02 * sin(radians(n_nationkey * 15)) AS cd21, 0.02 * cos(radians(n_nationkey * 15)) AS cd22 FROM nation),
 ca AS (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 7.3) % 360 AS ra, (c_custkey * 3.1) % 180 - 90 AS dec FROM customer)"""


def _frames(spark, d):
    turn = F.radians(F.col("n_nationkey") * 15)
    flat = [(-0.02 * F.cos(turn)).alias("cd11"), (0.02 * F.sin(turn)).alias("cd12"), (0.02 * F.sin(turn)).alias("cd21"), (0.02 * F.cos(turn)).alias("cd22")]
    n = tables.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("frame"), F.lit(900).alias("h"), F.lit(1200).alias("w"), (F.col("n_nationkey") * 14.4).alias("crval1"), (F.col("n_nationkey") * 37 % 179 - 89.0).alias("crval2"), F.lit(600.5).alias("crpix1"), F.lit(450.5).alias("crpix2"), *flat)


def _catalogue(spark, d):
    return tables.table(spark, d, "customer").selectExpr("CAST(c_custkey AS BIGINT) id", "(c_custkey * 7.3D) % 360 ra", "(c_custkey * 3.1D) % 180 - 90 dec")


@query(
    "catalogue_pixels",
    f"""WITH {VIEWS}, pr AS (SELECT *, sin(radians(crval2)) * sin(radians(dec)) + cos(radians(crval2)) * cos(radians(dec)) * cos(radians(ra - crval1)) AS depth FROM fr, ca),
 pl AS (SELECT *, degrees(cos(radians(dec)) * sin(radians(ra - crval1)) / depth) AS xi, degrees((cos(radians(crval2)) * sin(radians(dec)) - sin(radians(crval2)) * cos(radians(dec)) * cos(radians(ra - crval1))) / depth) AS eta FROM pr WHERE depth > 1e-9),
 px AS (SELECT id, frame, h, w, (cd22 * xi - cd12 * eta) / (cd11 * cd22 - cd12 * cd21) + crpix1 - 1 AS x, (cd11 * eta - cd21 * xi) / (cd11 * cd22 - cd12 * cd21) + crpix2 - 1 AS y FROM pl)
 SELECT id, frame, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM px WHERE x >= -0.5 AND y >= -0.5 AND x < w - 0.5 AND y < h - 0.5""",
)
def catalogue_pixels(spark, d):
    """Where the stars of a catalogue stand on each frame that shows them."""
    shown = sky.on_frames(_catalogue(spark, d), _frames(spark, d), ["frame"], 16.0)
    return rounded(shown.select("id", "frame", "x", "y"), "x", "y")


@query(
    "pixel_sky",
    f"""WITH {VIEWS}, pt AS (SELECT *, x0 * 150.0 AS x, y0 * 150.0 AS y FROM fr, range(9) a(x0), range(7) b(y0)),
 pl AS (SELECT *, radians(cd11 * (x + 1 - crpix1) + cd12 * (y + 1 - crpix2)) AS xi, radians(cd21 * (x + 1 - crpix1) + cd22 * (y + 1 - crpix2)) AS eta FROM pt),
 sk AS (SELECT frame, x, y, crval1 + degrees(atan2(xi, cos(radians(crval2)) - eta * sin(radians(crval2)))) AS ra, degrees(atan2(sin(radians(crval2)) + eta * cos(radians(crval2)), sqrt(xi * xi + pow(cos(radians(crval2)) - eta * sin(radians(crval2)), 2)))) AS dec FROM pl)
 SELECT frame, x, y, round(ra - 360 * floor(ra / 360), 6) + 0.0 AS ra, round(dec, 6) + 0.0 AS dec FROM sk""",
)
def pixel_sky(spark, d):
    """The sky at a mesh of pixels of every frame."""
    mesh = _frames(spark, d).withColumn("x", F.explode(F.array(*[F.lit(150.0 * k) for k in range(9)]))).withColumn("y", F.explode(F.array(*[F.lit(150.0 * k) for k in range(7)])))
    ra, dec = projection.to_sky(F.col("x"), F.col("y"))
    return rounded(mesh.select("frame", "x", "y", ra.alias("ra"), dec.alias("dec")), "ra", "dec")
