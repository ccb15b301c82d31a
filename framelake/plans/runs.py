"""Queries that are whole runs: several operators as one plan.

Their SQL is that of the operators they are composed of, put into one another.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipelines
from ..sources import tables
from . import fusion  # noqa: F401  its SQL must be registered first
from . import kernel_sql as k
from .frames import BLURRY, PX, SQL, TILES, query, rounded

SERIES = ["series_id"]


def _unit(spark, d):
    return tables.pixels(spark, d).withColumn("v", (F.col("v") + 1.0) / 2.0)


def _instead(name: str, source: str) -> str:
    """A query's SQL over other frames ``u``."""
    return SQL[name].replace(k.UNIT, source)


@query("run_focus", _instead("consistent_merge", f"{TILES}, {BLURRY}, u AS MATERIALIZED (SELECT series_id, seq, y, x, (v + 1) / 2 AS v FROM px ANTI JOIN bl USING (series_id, seq))").replace("AS v FROM o", "AS value FROM o"))
def run_focus(spark, d):
    """Without blurred frames, merged so that choices hold across scales."""
    return rounded(pipelines.focus(_unit(spark, d), SERIES, "seq")[0], "value")


@query(
    "run_lucky",
    k._wavelet((2.0, 1.6, 1.3), 0.0).replace(k.UNIT, "lm AS (" + SQL["lucky_map"].replace("round(sum(w * v) / sum(w), 6) + 0.0", "sum(w * v) / sum(w)") + "), u AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, value AS v FROM lm)").replace("SELECT series_id, seq, y, x, round", "SELECT series_id, y, x, round"),
)
def run_lucky(spark, d):
    """Patches of the best frames, blended and sharpened by wavelets."""
    return rounded(pipelines.lucky(_unit(spark, d), SERIES, "seq"), "value")


@query(
    "run_long_exposure",
    f"""WITH {PX}, fr AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY series_id) // 2 AS mid FROM (SELECT DISTINCT series_id, seq FROM px)),
 wh AS (SELECT series_id, y, x, 0.4 * avg(v) + 0.6 * max(v) AS w FROM px GROUP BY ALL), om AS (SELECT px.* FROM px JOIN fr USING (series_id, seq) WHERE k = mid)
 SELECT series_id, y, x, round(0.75 * w + 0.25 * v, 6) + 0.0 AS value FROM wh JOIN om USING (series_id, y, x)""",
)
def run_long_exposure(spark, d):
    """Lights of all frames above their mean, three quarters of it above the middle frame."""
    return rounded(pipelines.long_exposure(tables.pixels(spark, d), SERIES, "seq", "bright", 0.75), "value")


@query("run_exposures")
def run_exposures(spark, d):
    """Exposure fusion, with the best exposed frame where something moved; its parts have SQL, the whole is tested on exposures that are known."""
    return rounded(pipelines.exposures(tables.colour_frames(spark, d), SERIES, "seq"), "b", "g", "r")


@query("run_astro")
def run_astro(spark, d):
    """What becomes of each frame on its way to one image of stars; tested on skies that are known."""
    fate = pipelines.astro(tables.array_frames(spark, d), SERIES, "seq", factor=1.5, least_votes=6)[1]
    return fate.withColumn("reasons", F.array_join("reasons", "|"))
