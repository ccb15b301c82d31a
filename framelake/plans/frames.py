"""Queries over frames, series and points: (name, DataFrame builder, SQL).

Builders and SQL are written separately; results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, match, score, select, sequence
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PIXEL = ["series_id", "y", "x"]
FRAME = ["series_id", "seq"]

PX = """px AS (SELECT CAST(label AS BIGINT) AS series_id, vec_id AS seq, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, CAST(embedding[i] AS DOUBLE) AS v
 FROM embeddings, range(1, 65) t(i))"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers as bigint; the named columns rounded, without a negative zero."""
    out = []
    for name, kind in df.dtypes:
        if name in columns:
            out.append((F.round(name, 6) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def coarse(df: DataFrame) -> DataFrame:
    """Means of prices to four places, moved off the ties that whole cents make."""
    return df.withColumn("value", F.round(F.col("value") + 1e-7, 4))


# --- combination -----------------------------------------------------------------------------


def _combined(method: str, **options):
    return lambda spark, d: rounded(combine.combine(tables.pixels(spark, d), PIXEL, method, **options), "value")


BAND = "avg(v) - 2.5 * stddev_pop(v) AS lo, avg(v) + 2.5 * stddev_pop(v) AS hi"
for _name, _value in {"average": "avg(v)", "median": "median(v)", "max": "greatest(max(v), 0.0)", "sum": "sum(v)"}.items():
    query(f"stack_{_name}", f"WITH {PX} SELECT series_id, y, x, round({_value}, 6) + 0.0 AS value FROM px GROUP BY series_id, y, x")(_combined(_name))

query(
    "stack_sigma",
    f"""WITH {PX}, b1 AS (SELECT series_id, y, x, {BAND} FROM px GROUP BY ALL),
 b2 AS (SELECT px.series_id, px.y, px.x, {BAND} FROM px JOIN b1 USING (series_id, y, x) WHERE v BETWEEN lo AND hi GROUP BY ALL)
 SELECT px.series_id, px.y, px.x, round(avg(v), 6) + 0.0 AS value FROM px JOIN b2 USING (series_id, y, x) WHERE v BETWEEN lo AND hi GROUP BY ALL""",
)(_combined("sigma"))
query(
    "stack_winsor",
    f"""WITH {PX}, b AS (SELECT series_id, y, x, {BAND} FROM px GROUP BY ALL)
 SELECT px.series_id, px.y, px.x, round(avg(least(greatest(v, lo), hi)), 6) + 0.0 AS value FROM px JOIN b USING (series_id, y, x) GROUP BY ALL""",
)(_combined("winsor"))

_FIT = """f{k} AS (SELECT *, sum(w) OVER e AS sw0 FROM {prev} WINDOW e AS (PARTITION BY series_id, y, x)),
 g{k} AS (SELECT *, greatest(sw0, 1.0) AS sw FROM f{k}),
 h{k} AS (SELECT *, sum(v * w) OVER e / sw AS ym FROM g{k} WINDOW e AS (PARTITION BY series_id, y, x)),
 i{k} AS (SELECT *, v - (sum(dx * (v - ym) * w) OVER e / xv * dx + ym) AS rest FROM h{k} WINDOW e AS (PARTITION BY series_id, y, x)),
 j{k} AS (SELECT series_id, y, x, v, dx, xv, CASE WHEN abs(rest) <= {kappa} * (sqrt(sum(rest * rest * w) OVER e / sw) + 1e-9) THEN 1.0 ELSE 0.0 END AS w FROM i{k} WINDOW e AS (PARTITION BY series_id, y, x))"""


def _fit_sql(source: str, keys: str, kappa: float = 2.5) -> str:
    text = f"""r0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id, y, x ORDER BY v) AS DOUBLE) - 1.0 AS rank FROM {source}),
 r1 AS (SELECT *, rank - avg(rank) OVER (PARTITION BY series_id, y, x) AS dx FROM r0),
 r2 AS (SELECT series_id, y, x, v, dx, sum(dx * dx) OVER (PARTITION BY series_id, y, x) + 1e-9 AS xv, 1.0::DOUBLE AS w FROM r1),
 {_FIT.format(k=1, prev="r2", kappa=kappa)}, {_FIT.format(k=2, prev="j1", kappa=kappa)}
 SELECT {keys}, round(sum(v * w) / greatest(sum(w), 1.0), 6) + 0.0 AS value FROM j2 GROUP BY ALL"""
    return text


query("stack_linearfit", f"WITH {PX}, {_fit_sql('px', 'series_id, y, x')}")(_combined("linearfit"))

NORMAL = f"""{PX}, fm AS (SELECT series_id, seq, median(v) AS m FROM px GROUP BY ALL), sm AS (SELECT series_id, median(m) AS a FROM fm GROUP BY ALL),
 nx AS (SELECT px.series_id, px.seq, px.y, px.x, v + (a - m) AS v FROM px JOIN fm USING (series_id, seq) JOIN sm USING (series_id))"""


@query("stack_normalized", f"WITH {NORMAL} SELECT series_id, y, x, round(avg(v), 6) + 0.0 AS value FROM nx GROUP BY ALL")
def stack_normalized(spark, d):
    return rounded(combine.average(combine.normalize(tables.pixels(spark, d), ["series_id"], ["seq"]), PIXEL), "value")


SIGMA = """cut AS (SELECT series_id, seq, quantile_cont(v, 0.8) AS c FROM px GROUP BY ALL),
 low AS (SELECT px.series_id, px.seq, v FROM px JOIN cut USING (series_id, seq) WHERE v <= c),
 lm AS (SELECT series_id, seq, median(v) AS m FROM low GROUP BY ALL),
 sg AS (SELECT low.series_id, low.seq, greatest(median(abs(v - m)) * 1.4826, 1e-5) AS sigma FROM low JOIN lm USING (series_id, seq) GROUP BY ALL)"""


@query("background_sigma", f"WITH {PX}, {SIGMA} SELECT series_id, seq, round(sigma, 6) + 0.0 AS sigma FROM sg")
def background_sigma(spark, d):
    return rounded(combine.background_sigma(tables.pixels(spark, d), FRAME), "sigma")


@query(
    "stack_weighted",
    f"""WITH {PX}, {SIGMA}, w AS (SELECT series_id, seq, (1 / (sigma * sigma)) * count(*) OVER s / sum(1 / (sigma * sigma)) OVER s AS weight FROM sg WINDOW s AS (PARTITION BY series_id))
 SELECT px.series_id, px.y, px.x, round(sum(v * weight) / greatest(sum(weight), 1e-6), 6) + 0.0 AS value FROM px JOIN w USING (series_id, seq) GROUP BY ALL""",
)
def stack_weighted(spark, d):
    px = tables.pixels(spark, d)
    weights = combine.noise_weights(px, ["series_id"], ["seq"])
    return rounded(combine.average(px.join(weights, FRAME), PIXEL, weight="weight"), "value")


@query(
    "comet_decay",
    f"""WITH {PX}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, y, x ORDER BY seq) AS k, count(*) OVER (PARTITION BY series_id, y, x) AS n FROM px)
 SELECT series_id, y, x, round(max(v * pow(0.9, CAST(n - k AS DOUBLE))), 6) + 0.0 AS value FROM r GROUP BY ALL""",
)
def comet_decay(spark, d):
    e = tables.table(spark, d, "embeddings")
    from pyspark.sql import Window

    order = e.select(F.col("label").alias("series_id"), F.col("vec_id").alias("seq"))
    order = order.withColumns({"k": F.row_number().over(Window.partitionBy("series_id").orderBy("seq")), "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    return rounded(combine.comet(tables.pixels(spark, d).join(order, FRAME), PIXEL, "k", "n"), "value")


@query(
    "bright_percentile",
    f"""WITH {PX}, s AS (SELECT series_id, y, x, sum(v) AS s FROM px GROUP BY ALL), t AS (SELECT series_id, quantile_cont(s, 0.9995) AS top FROM s GROUP BY ALL)
 SELECT s.series_id, y, x, round(least(greatest(s / greatest(top, 1e-6), 0.0), 1.0), 6) + 0.0 AS value FROM s JOIN t USING (series_id)""",
)
def bright_percentile(spark, d):
    return rounded(combine.bright(tables.pixels(spark, d), ["series_id"], ["y", "x"]), "value")


@query("bin_image", f"WITH {PX} SELECT series_id, seq, y // 3 AS y, x // 3 AS x, round(avg(v), 6) + 0.0 AS value FROM px WHERE y < 6 AND x < 6 GROUP BY ALL")
def bin_image(spark, d):
    return rounded(combine.bin_image(tables.pixels(spark, d), FRAME, 8, 8, 3), "value")


@query(
    "calibrate",
    f"""WITH {PX}, dk AS (SELECT y, x, median(v) AS dark FROM px WHERE series_id = 0 GROUP BY ALL), fl AS (SELECT y, x, median(v + 1) AS flat FROM px WHERE series_id = 1 GROUP BY ALL),
 g AS (SELECT y, x, greatest(flat / (SELECT avg(flat) FROM fl), 0.2) AS gain FROM fl)
 SELECT series_id, seq, y, x, round(greatest((v - dark) / gain, 0.0), 6) + 0.0 AS value FROM px JOIN dk USING (y, x) JOIN g USING (y, x) WHERE series_id = 2""",
)
def calibrate(spark, d):
    px = tables.pixels(spark, d)
    dark = combine.median(px.filter("series_id = 0"), ["y", "x"])
    flat = combine.median(px.filter("series_id = 1").withColumn("v", F.col("v") + 1.0), ["y", "x"])
    return rounded(combine.calibrate(px.filter("series_id = 2"), dark, flat, ["y", "x"]).select("series_id", "seq", "y", "x", "value"), "value")


PRICE_KEYS = "l_partkey AS series_id"


@query(
    "part_sigma",
    """WITH p AS (SELECT l_partkey AS series_id, l_extendedprice AS v FROM lineitem), b AS (SELECT series_id, avg(v) - 1.5 * stddev_pop(v) AS lo, avg(v) + 1.5 * stddev_pop(v) AS hi FROM p GROUP BY ALL)
 SELECT p.series_id, round(avg(v) + 1e-7, 4) AS value FROM p JOIN b USING (series_id) WHERE v BETWEEN lo AND hi GROUP BY ALL""",
)
def part_sigma(spark, d):
    return coarse(combine.sigma_clip(tables.prices(spark, d).select("series_id", "v"), ["series_id"], kappa=1.5, iterations=1))


@query(
    "part_winsor",
    """WITH p AS (SELECT l_partkey AS series_id, l_extendedprice AS v FROM lineitem), b AS (SELECT series_id, avg(v) - 1.5 * stddev_pop(v) AS lo, avg(v) + 1.5 * stddev_pop(v) AS hi FROM p GROUP BY ALL)
 SELECT p.series_id, round(avg(least(greatest(v, lo), hi)) + 1e-7, 4) AS value FROM p JOIN b USING (series_id) GROUP BY ALL""",
)
def part_winsor(spark, d):
    return coarse(combine.winsorize(tables.prices(spark, d).select("series_id", "v"), ["series_id"], kappa=1.5))


@query("part_median", "SELECT l_partkey AS series_id, round(median(l_extendedprice), 6) + 0.0 AS value FROM lineitem GROUP BY ALL")
def part_median(spark, d):
    return rounded(combine.median(tables.prices(spark, d).select("series_id", "v"), ["series_id"]), "value")


# --- order of a series -----------------------------------------------------------------------

SCORES = "s AS (SELECT user_id AS series_id, ts, event_id AS seq, value AS v, event_type, props FROM events)"
ORDER = "PARTITION BY series_id ORDER BY ts, seq"


@query(
    "cull_local_dip",
    f"""WITH {SCORES}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM s WINDOW w AS ({ORDER})),
 r AS (SELECT series_id, seq, CASE WHEN v < 5.0 THEN 'flat' WHEN a IS NOT NULL AND b IS NOT NULL AND least(a, b) > 0 AND v < 0.4 * least(a, b) THEN 'dip' END AS reason FROM n)
 SELECT series_id, seq, reason, reason IS NULL AS keep FROM r""",
)
def cull_local_dip(spark, d):
    return sequence.local_dip(tables.scores(spark, d), ["series_id"], ["ts", "seq"], floor=5.0).select("series_id", "seq", "reason", "keep")


@query(
    "split_brackets_auto",
    f"""WITH {SCORES}, g AS (SELECT *, max(CASE WHEN v IS NULL OR v <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id) AS bad, lag(v) OVER ({ORDER}) AS before FROM s),
 f AS (SELECT *, CASE WHEN bad = 0 AND v < 0.5 * before THEN 1 ELSE 0 END AS start FROM g),
 b AS (SELECT *, CAST(sum(start) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bracket FROM f),
 c AS (SELECT *, count(*) OVER (PARTITION BY series_id, bracket) AS size FROM b) SELECT series_id, seq, bracket, size FROM c WHERE size >= 2""",
)
def split_brackets_auto(spark, d):
    return sequence.brackets_auto(tables.scores(spark, d), ["series_id"], ["ts", "seq"]).select("series_id", "seq", "bracket", "size")


@query(
    "split_brackets_fixed",
    f"""WITH {SCORES}, b AS (SELECT series_id, seq, (row_number() OVER ({ORDER}) - 1) // 3 AS bracket FROM s),
 c AS (SELECT *, count(*) OVER (PARTITION BY series_id, bracket) AS size FROM b) SELECT * FROM c WHERE size >= 2""",
)
def split_brackets_fixed(spark, d):
    return sequence.brackets_fixed(tables.scores(spark, d), ["series_id"], ["ts", "seq"], 3).select("series_id", "seq", "bracket", "size")


@query(
    "moving_mean",
    f"""WITH {SCORES}, r AS (SELECT series_id, seq, v, row_number() OVER ({ORDER}) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s),
 k AS (SELECT *, greatest(1, n // 8) AS k FROM r), t AS (SELECT k.series_id, k.seq, unnest(range(i - k, i + k + 1)) AS j, n FROM k),
 u AS (SELECT series_id, seq, least(greatest(j, 1), n) AS j FROM t)
 SELECT u.series_id, u.seq, round(avg(r.v), 6) + 0.0 AS smooth FROM u JOIN r ON r.series_id = u.series_id AND r.i = u.j GROUP BY ALL""",
)
def moving_mean(spark, d):
    return rounded(sequence.centred_mean(tables.scores(spark, d), ["series_id"], ["ts", "seq"]).select("series_id", "seq", "smooth"), "smooth")


@query(
    "monotone_trend",
    f"""WITH {SCORES}, e AS (SELECT series_id, seq, v, ts, first_value(v) OVER f AS a, last_value(v) OVER f AS b FROM s WINDOW f AS ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
 SELECT series_id, seq, round(CASE WHEN b >= a THEN max(v) OVER w ELSE min(v) OVER w END, 6) + 0.0 AS trend FROM e WINDOW w AS ({ORDER} ROWS UNBOUNDED PRECEDING)""",
)
def monotone_trend(spark, d):
    return rounded(sequence.monotone(tables.scores(spark, d), ["series_id"], ["ts", "seq"]).select("series_id", "seq", "trend"), "trend")


@query(
    "interpolate_gaps",
    f"""WITH {SCORES}, k AS (SELECT series_id, seq, CAST(seq AS DOUBLE) AS t, CASE WHEN event_type <> 'click' THEN v END AS v FROM s),
 n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
  first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1 FROM k
  WINDOW b AS (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT series_id, seq, round(coalesce(v0 + (t - t0) / nullif(t1 - t0, 0.0) * (v1 - v0), v0, v1), 6) + 0.0 AS filled FROM n""",
)
def interpolate_gaps(spark, d):
    s = tables.scores(spark, d).select("series_id", "seq", F.when(F.col("event_type") != "click", F.col("v")).alias("v"))
    return rounded(sequence.interpolate_gaps(s, ["series_id"], "seq").select("series_id", "seq", "filled"), "filled")


@query(
    "representative_frame",
    f"WITH {SCORES}, r AS (SELECT series_id, seq, row_number() OVER ({ORDER}) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, seq FROM r WHERE r = n // 2 + 1",
)
def representative_frame(spark, d):
    return sequence.middle(tables.scores(spark, d), ["series_id"], ["ts", "seq"]).select("series_id", "seq")


# --- selection ---------------------------------------------------------------------------------


@query(
    "top_share_local",
    f"""WITH {SCORES}, r AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY v DESC, seq) AS place, count(*) OVER (PARTITION BY series_id) AS n FROM s)
 SELECT series_id, seq, place FROM r WHERE place <= greatest(3, CAST(floor(n * 0.3) AS BIGINT))""",
)
def top_share_local(spark, d):
    return rounded(select.top_share(tables.scores(spark, d), ["series_id"], "v", "seq", 0.3, 3).select("series_id", "seq", "place"))


@query("top_share_global", "SELECT event_id AS seq FROM events QUALIFY row_number() OVER (ORDER BY value DESC, event_id) <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM events)")
def top_share_global(spark, d):
    return select.best_share(tables.scores(spark, d), "v", "seq", 0.1).select("seq")


@query(
    "even_sample",
    f"""WITH {SCORES}, r AS (SELECT series_id, seq, row_number() OVER ({ORDER}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s),
 m AS (SELECT series_id, any_value(n) AS n, least(8, any_value(n)) AS m FROM r GROUP BY ALL),
 p AS (SELECT series_id, n, m, unnest(range(0, m)) AS k FROM m), q AS (SELECT DISTINCT series_id, CASE WHEN m = 1 THEN 0 ELSE (k * (n - 1)) // (m - 1) END AS i FROM p)
 SELECT r.series_id, r.seq FROM r JOIN q USING (series_id, i)""",
)
def even_sample(spark, d):
    return select.even_sample(tables.scores(spark, d), ["series_id"], ["ts", "seq"], 8).select("series_id", "seq")


@query(
    "every_step",
    f"WITH {SCORES}, r AS (SELECT series_id, seq, row_number() OVER ({ORDER}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, seq FROM r WHERE i % greatest(1, n // 10) = 0",
)
def every_step(spark, d):
    return select.every(tables.scores(spark, d), ["series_id"], ["ts", "seq"], 10).select("series_id", "seq")


@query(
    "select_subs",
    """WITH f AS (SELECT l_suppkey AS series_id, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS fwhm, l_quantity AS stars, l_tax * 100 AS bg, 1.5 + l_discount * 4 AS ecc, l_returnflag = 'R' AND l_linestatus = 'F' AS trail FROM lineitem),
 m AS (SELECT series_id, median(fwhm) AS mf, median(stars) AS ms, median(bg) AS mb FROM f GROUP BY ALL),
 r AS (SELECT series_id, o, n, concat_ws('|', CASE WHEN trail THEN 'trail' END, CASE WHEN fwhm > 1.5 * mf THEN 'blurred' END, CASE WHEN ecc > 1.7 THEN 'elongated' END,
  CASE WHEN stars < 0.5 * ms THEN 'few stars' END, CASE WHEN bg > 1.6 * mb THEN 'bright sky' END) AS reasons FROM f JOIN m USING (series_id))
 SELECT series_id, reasons, count(*) AS frames, bool_and(reasons = '') AS keep FROM r GROUP BY ALL""",
)
def select_subs(spark, d):
    f = tables.table(spark, d, "lineitem").selectExpr(
        "l_suppkey series_id", "l_extendedprice fwhm", "l_quantity stars", "l_tax * 100 bg", "1.5D + l_discount * 4 ecc", "l_returnflag = 'R' AND l_linestatus = 'F' trail"
    )
    out = select.select_subs(f, ["series_id"]).withColumn("reasons", F.array_join("reasons", "|"))
    return out.groupBy("series_id", "reasons").agg(F.count(F.lit(1)).alias("frames"), F.bool_and("keep").alias("keep"))


@query(
    "point_dedup",
    "WITH q AS (SELECT user_id % 100 AS px, event_id % 10 AS py, max(value) AS q FROM events GROUP BY ALL) SELECT px, py, round(q, 6) + 0.0 AS q FROM q WHERE q >= 0.12 * (SELECT max(q) FROM q)",
)
def point_dedup(spark, d):
    e = tables.table(spark, d, "events").selectExpr("user_id % 100 px", "event_id % 10 py", "value")
    return rounded(select.distinct_points(e, ["px", "py"], "value"), "q")


@query("session_union", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def session_union(spark, d):
    one = tables.table(spark, d, "lineitem").filter("l_returnflag = 'R'").selectExpr("l_orderkey k")
    return one.unionByName(tables.table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey k"))


# --- scores of tiles and frames ------------------------------------------------------------------

LAP = f"""{PX}, nb AS (SELECT *, lag(v) OVER wy AS u, lead(v) OVER wy AS dn, lag(v) OVER wx AS l, lead(v) OVER wx AS r FROM px
  WINDOW wy AS (PARTITION BY series_id, seq, x ORDER BY y), wx AS (PARTITION BY series_id, seq, y ORDER BY x)),
 lp AS (SELECT series_id, seq, y, x, v, coalesce(u, dn) + coalesce(dn, u) + coalesce(l, r) + coalesce(r, l) - 4 * v AS lap,
  abs(2 * v - coalesce(u, dn) - coalesce(dn, u)) + abs(2 * v - coalesce(l, r) - coalesce(r, l)) AS sml,
  sqrt(pow((coalesce(r, l) - coalesce(l, r)) / 2, 2) + pow((coalesce(dn, u) - coalesce(u, dn)) / 2, 2)) AS grad FROM nb)"""
TILES = f"{LAP}, ti AS (SELECT series_id, seq, (y // 2) * 4 + x // 2 AS tile, var_pop(lap) AS s FROM lp GROUP BY ALL)"
WON = f"""{TILES}, bw AS (SELECT series_id, tile, seq AS winner, s AS peak FROM ti QUALIFY row_number() OVER (PARTITION BY series_id, tile ORDER BY s DESC, seq) = 1),
 ct AS (SELECT series_id, 0.15 * median(peak) AS c FROM bw WHERE peak > 0 GROUP BY ALL), won AS (SELECT bw.* FROM bw JOIN ct USING (series_id) WHERE peak > c)"""
SWEEP = f"{WON}, sw AS (SELECT f.series_id, f.seq, count(won.tile) AS contrib FROM (SELECT DISTINCT series_id, seq FROM ti) f LEFT JOIN won ON won.series_id = f.series_id AND won.winner = f.seq GROUP BY ALL)"
BLURRY = """pk AS (SELECT series_id, seq, max(s) AS peak FROM ti GROUP BY ALL), pm AS (SELECT series_id, median(peak) + 1e-9 AS m FROM pk GROUP BY ALL),
 bl AS (SELECT pk.series_id, pk.seq, peak / m AS ratio FROM pk JOIN pm USING (series_id) WHERE peak / m < 0.45)"""
OUT = """ce AS (SELECT series_id, winner AS seq, avg(tile // 4) AS cy, avg(tile % 4) AS cx FROM won GROUP BY ALL),
 od AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS k, cy, cx FROM ce),
 ds AS (SELECT a.series_id, a.seq, sqrt(pow(a.cy - b.cy, 2) + pow(a.cx - b.cx, 2)) AS d FROM od a JOIN od b ON a.series_id = b.series_id AND abs(a.k - b.k) BETWEEN 1 AND 2),
 ol AS (SELECT series_id, seq, median(d) AS jump FROM ds GROUP BY ALL HAVING count(*) >= 2 AND median(d) > 2.2)"""


def _tiles(spark, d):
    return score.tile_sharpness(tables.pixels(spark, d), FRAME, 8, 8, 4)


@query("laplacian", f"WITH {LAP} SELECT series_id, seq, y, x, round(lap, 6) + 0.0 AS lap FROM lp")
def laplacian(spark, d):
    return rounded(score.laplacian(tables.pixels(spark, d), FRAME).drop("v"), "lap")


@query("focus_measure", f"WITH {LAP} SELECT series_id, seq, round(avg(sml), 6) + 0.0 AS sml FROM lp GROUP BY ALL")
def focus_measure(spark, d):
    return rounded(score.focus_measure(tables.pixels(spark, d), FRAME).groupBy(*FRAME).agg(F.avg("sml").alias("sml")), "sml")


@query("gradient_magnitude", f"WITH {LAP} SELECT series_id, seq, round(max(grad), 6) + 0.0 AS grad FROM lp GROUP BY ALL")
def gradient_magnitude(spark, d):
    return rounded(score.gradient(tables.pixels(spark, d), FRAME).groupBy(*FRAME).agg(F.max("grad").alias("grad")), "grad")


NEAR = "FROM px a JOIN px b ON a.series_id = b.series_id AND a.seq = b.seq AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


@query("dilate_max", f"WITH {PX}, m AS (SELECT a.series_id, a.seq, a.y, a.x, max(b.v) AS e {NEAR} GROUP BY ALL) SELECT series_id, y, x, round(max(e), 6) + 0.0 AS value FROM m GROUP BY ALL")
def dilate_max(spark, d):
    return rounded(combine.combine(score.extreme(tables.pixels(spark, d), FRAME), PIXEL, "max", "extreme"), "value")


@query("erode_min", f"WITH {PX} SELECT a.series_id, a.seq, a.y, a.x, round(min(b.v), 6) + 0.0 AS extreme {NEAR} GROUP BY ALL")
def erode_min(spark, d):
    return rounded(score.extreme(tables.pixels(spark, d), FRAME, largest=False).drop("v"), "extreme")


@query("box_mean", f"WITH {PX} SELECT a.series_id, a.seq, a.y, a.x, round(avg(b.v), 6) + 0.0 AS box {NEAR} GROUP BY ALL")
def box_mean(spark, d):
    return rounded(score.box_mean(tables.pixels(spark, d), FRAME).drop("v"), "box")


@query("tile_sharpness", f"WITH {TILES} SELECT series_id, seq, tile, round(s, 6) + 0.0 AS s FROM ti")
def tile_sharpness(spark, d):
    return rounded(_tiles(spark, d), "s")


@query("peak_sharpness", f"WITH {TILES} SELECT series_id, seq, round(quantile_cont(s, 0.95), 6) + 0.0 AS peak_sharp, round(avg(s), 6) + 0.0 AS mean_sharp FROM ti GROUP BY ALL")
def peak_sharpness(spark, d):
    return rounded(score.peak_sharpness(_tiles(spark, d), FRAME), "peak_sharp", "mean_sharp")


@query("detect_blurry", f"WITH {TILES}, {BLURRY} SELECT series_id, seq, round(ratio, 6) + 0.0 AS ratio FROM bl")
def detect_blurry(spark, d):
    return rounded(score.detect_blurry(_tiles(spark, d), ["series_id"], "seq"), "ratio")


@query("focus_sweep", f"WITH {SWEEP} SELECT * FROM sw")
def focus_sweep(spark, d):
    return rounded(score.focus_sweep(_tiles(spark, d), ["series_id"], "seq"))


@query("sweep_range", f"WITH {SWEEP} SELECT series_id, min(seq) AS first, max(seq) AS last, count(*) AS contributing, CAST(sum(contrib) AS BIGINT) AS tiles FROM sw WHERE contrib > 0 GROUP BY ALL")
def sweep_range(spark, d):
    return rounded(score.sweep_range(score.focus_sweep(_tiles(spark, d), ["series_id"], "seq"), ["series_id"], "seq"))


@query("redundant_frames", f"WITH {SWEEP} SELECT series_id, seq FROM sw WHERE contrib = 0")
def redundant_frames(spark, d):
    tiles = _tiles(spark, d)
    won = score.tile_winners(tiles, ["series_id"], "seq")
    return rounded(tiles.select("series_id", "seq").distinct().join(won.select("series_id", F.col("winner").alias("seq")), FRAME, "left_anti"))


@query(
    "focus_coverage",
    f"""WITH {WON}, tp AS (SELECT series_id, tile, max(s) AS peak FROM ti GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY peak DESC, tile) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM tp WHERE peak > 0),
 rf AS (SELECT series_id, median(peak) AS ref FROM rk WHERE r <= greatest(1, n // 4) GROUP BY ALL), cv AS (SELECT won.series_id, avg(CASE WHEN peak >= 0.25 * ref THEN 1.0 ELSE 0.0 END) AS c FROM won JOIN rf USING (series_id) GROUP BY ALL)
 SELECT series_id, round(c, 6) + 0.0 AS coverage, c >= 0.92 AS complete FROM cv""",
)
def focus_coverage(spark, d):
    return rounded(score.coverage(_tiles(spark, d), ["series_id"], "seq"), "coverage")


@query(
    "series_status",
    f"""WITH {SWEEP}, {BLURRY}, {OUT} SELECT sw.series_id, sw.seq, contrib, CASE WHEN ratio IS NOT NULL THEN 'blurry' WHEN jump IS NOT NULL THEN 'outlier' WHEN contrib > 0 THEN 'good' ELSE 'redundant' END AS status
 FROM sw LEFT JOIN bl USING (series_id, seq) LEFT JOIN ol USING (series_id, seq)""",
)
def series_status(spark, d):
    return rounded(score.series_status(_tiles(spark, d), ["series_id"], "seq", 4))


DISAGREE = f"""{PX}, dv AS (SELECT series_id, y, x, stddev_pop(v) AS d FROM px GROUP BY ALL), dt AS (SELECT series_id, max(d) AS t FROM dv GROUP BY ALL),
 da AS (SELECT dv.series_id, y, x, d / greatest(t, 1e-6) AS disagreement FROM dv JOIN dt USING (series_id))"""


@query("disagreement", f"WITH {DISAGREE} SELECT series_id, y, x, round(disagreement, 6) + 0.0 AS disagreement FROM da")
def disagreement(spark, d):
    return rounded(score.disagreement(tables.pixels(spark, d), ["series_id"]), "disagreement")


@query("ghost_area", f"WITH {DISAGREE} SELECT series_id, round(avg(CASE WHEN disagreement > 0.9 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS ghost_share FROM da GROUP BY ALL")
def ghost_area(spark, d):
    return rounded(score.ghost_area(score.disagreement(tables.pixels(spark, d), ["series_id"]), ["series_id"], 0.9), "ghost_share")


@query(
    "cosmetic_pixels",
    f"""WITH {PX}, md AS (SELECT a.series_id, a.seq, a.y, a.x, a.v, median(b.v) AS med {NEAR} GROUP BY ALL), sd AS (SELECT series_id, seq, stddev_pop(v - med) AS sd FROM md GROUP BY ALL)
 SELECT md.series_id, md.seq, y, x, round(CASE WHEN abs(v - med) > 2.5 * sd THEN med ELSE v END, 6) + 0.0 AS value, abs(v - med) > 2.5 * sd AS replaced FROM md JOIN sd USING (series_id, seq)""",
)
def cosmetic_pixels(spark, d):
    return rounded(score.cosmetic(tables.pixels(spark, d), FRAME, strength=2.5), "value")


@query(
    "depth_weighted",
    f"""WITH {LAP}, tp AS (SELECT series_id, y, x, max(sml) AS t FROM lp GROUP BY ALL), w AS (SELECT lp.series_id, lp.y, lp.x, v, pow(sml / (t + 1e-6), 8.0) AS w FROM lp JOIN tp USING (series_id, y, x))
 SELECT series_id, y, x, round(sum(w * v) / (sum(w) + 1e-6), 6) + 0.0 AS value FROM w GROUP BY ALL""",
)
def depth_weighted(spark, d):
    return rounded(score.depth_weighted(tables.pixels(spark, d), ["series_id"], "seq"), "value")


@query("winner_value", f"WITH {LAP} SELECT series_id, y, x, seq AS winner, round(v, 6) + 0.0 AS value FROM lp QUALIFY row_number() OVER (PARTITION BY series_id, y, x ORDER BY sml DESC, seq) = 1")
def winner_value(spark, d):
    return rounded(score.winner_value(tables.pixels(spark, d), ["series_id"], "seq"), "value")


CENTRE = f"""{PX}, cc AS (SELECT series_id, seq, avg(v) + 0.5 * stddev_pop(v) AS c FROM px GROUP BY ALL),
 ce AS (SELECT px.series_id, px.seq, avg(y) AS cy, avg(x) AS cx, count(*) AS n FROM px JOIN cc USING (series_id, seq) WHERE v > c GROUP BY ALL HAVING count(*) >= 5)"""


@query("disk_centroid", f"WITH {CENTRE} SELECT series_id, seq, round(cy, 6) + 0.0 AS cy, round(cx, 6) + 0.0 AS cx, n FROM ce")
def disk_centroid(spark, d):
    return rounded(score.centroid(tables.pixels(spark, d), FRAME), "cy", "cx")


@query("motion_span", f"WITH {CENTRE} SELECT series_id, round(CASE WHEN count(*) >= 3 THEN sqrt(pow(max(cx) - min(cx), 2) + pow(max(cy) - min(cy), 2)) END, 6) + 0.0 AS span FROM ce GROUP BY ALL")
def motion_span(spark, d):
    return rounded(score.motion_span(score.centroid(tables.pixels(spark, d), FRAME), ["series_id"]), "span")


@query(
    "sky_horizon",
    f"""WITH {PX}, sp AS (SELECT series_id, y, x, stddev_pop(v) AS sd FROM px GROUP BY ALL), m AS (SELECT series_id, median(sd) AS m FROM sp GROUP BY ALL),
 a AS (SELECT series_id, median(abs(sd - m)) AS mad FROM sp JOIN m USING (series_id) GROUP BY ALL),
 r AS (SELECT sp.series_id, y, avg(CASE WHEN sd > m + mad THEN 1.0 ELSE 0.0 END) AS share FROM sp JOIN m USING (series_id) JOIN a USING (series_id) GROUP BY ALL),
 c AS (SELECT series_id, y, avg(share) OVER (PARTITION BY series_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS mean FROM r), t AS (SELECT series_id, max(mean) AS t FROM c GROUP BY ALL)
 SELECT series_id, max(CASE WHEN mean >= 0.5 * t THEN y END) AS horizon FROM c JOIN t USING (series_id) GROUP BY ALL""",
)
def sky_horizon(spark, d):
    return rounded(score.sky_profile(tables.pixels(spark, d), ["series_id"]))


@query("validity_intersection", f"WITH {PX}, v AS (SELECT series_id, y, x, bool_and(v > -0.28) AS valid FROM px GROUP BY ALL) SELECT * FROM v")
def validity_intersection(spark, d):
    return rounded(tables.pixels(spark, d).groupBy(*PIXEL).agg(F.bool_and(F.col("v") > -0.28).alias("valid")))


@query(
    "histogram",
    f"WITH {PX}, b AS (SELECT series_id, least(31, greatest(0, CAST(floor((v + 1) / 2 * 32) AS BIGINT))) AS bucket FROM px) SELECT series_id, bucket, count(*) AS pixels FROM b GROUP BY ALL",
)
def histogram(spark, d):
    bucket = F.least(F.lit(31), F.greatest(F.lit(0), F.floor((F.col("v") + 1) / 2 * 32))).cast("bigint")
    return rounded(tables.pixels(spark, d).groupBy("series_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pixels")))


# --- matching ------------------------------------------------------------------------------------


@query(
    "duplicate_distance",
    f"""WITH {PX}, p AS (SELECT series_id, seq AS a, y, x, v, lag(seq) OVER w AS b, lag(v) OVER w AS bv FROM px WINDOW w AS (PARTITION BY series_id, y, x ORDER BY seq))
 SELECT series_id, a, b, round(1 - count(*) * covar_pop(v, bv) / (sqrt(count(*) * var_pop(v)) * sqrt(count(*) * var_pop(bv)) + 1e-6), 6) + 0.0 AS distance FROM p WHERE b IS NOT NULL GROUP BY ALL""",
)
def duplicate_distance(spark, d):
    return rounded(match.duplicate_distance(tables.pixels(spark, d), ["series_id"], "seq", ["y", "x"]), "distance")


def _points(spark, d, label: int, shift: float = 0.0):
    """64 points of a frame: its pixels' values as coordinates."""
    e = tables.table(spark, d, "embeddings").filter(F.col("label") == label).orderBy("vec_id").limit(1)
    p = e.select(F.posexplode("embedding").alias("id", "v"))
    return p.select("id", (F.col("id") * 37 % 101 + F.col("v").cast("double") * 4 + shift).alias("x"), (F.col("id") * 53 % 97 - shift).cast("double").alias("y"))


POINTS = """pa AS (SELECT i - 1 AS id, ((i - 1) * 37) % 101 + CAST(embedding[i] AS DOUBLE) * 4 AS x, CAST(((i - 1) * 53) % 97 AS DOUBLE) AS y FROM (SELECT * FROM embeddings WHERE label = 0 ORDER BY vec_id LIMIT 1), range(1, 65) t(i)),
 pb AS (SELECT i - 1 AS id, ((i - 1) * 37) % 101 + CAST(embedding[i] AS DOUBLE) * 4 + 7.5 AS x, ((i - 1) * 53) % 97 - 7.5 AS y FROM (SELECT * FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 1), range(1, 65) t(i))"""


@query(
    "offset_vote",
    f"""WITH {POINTS}, o AS (SELECT pa.x - pb.x AS dx, pa.y - pb.y AS dy FROM pa, pb),
 v AS (SELECT a.dx, a.dy, count(*) AS votes, avg(b.dx) AS mx, avg(b.dy) AS my FROM o a JOIN o b ON abs(a.dx - b.dx) < 2.5 AND abs(a.dy - b.dy) < 2.5 GROUP BY a.dx, a.dy ORDER BY votes DESC, a.dx, a.dy LIMIT 1)
 SELECT round(mx, 6) + 0.0 AS dx, round(my, 6) + 0.0 AS dy, votes FROM v WHERE votes >= 8""",
)
def offset_vote(spark, d):
    return rounded(match.offset_vote(_points(spark, d, 0), _points(spark, d, 1, 7.5)), "dx", "dy")


@query(
    "nearest_neighbour",
    f"""WITH {POINTS}, p AS (SELECT pa.id AS a, pb.id AS b, sqrt(pow(pa.x - (pb.x - 7.5), 2) + pow(pa.y - (pb.y + 7.5), 2)) AS d FROM pa JOIN pb ON abs(pa.x - (pb.x - 7.5)) < 4 AND abs(pa.y - (pb.y + 7.5)) < 4)
 SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(d, 6) + 0.0 AS distance FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1""",
)
def nearest_neighbour(spark, d):
    a = _points(spark, d, 0).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = _points(spark, d, 1, 7.5).select(F.col("id").alias("b"), (F.col("x") - 7.5).alias("bx"), (F.col("y") + 7.5).alias("by"))
    pairs = match.range_join(a, b, [("ax", "bx"), ("ay", "by")], 4.0).withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    return rounded(match.nearest(pairs, ["a"], "distance", "b").select("a", "b", "distance"), "distance")


def _vectors(spark, d, label: int, q: str, v: str):
    return tables.table(spark, d, "embeddings").filter(F.col("label") == label).select(F.col("vec_id").alias(q), F.col("embedding").alias(v))


KNN = """k AS (SELECT a.vec_id AS q, b.vec_id AS i, sqrt(list_sum(list_transform(range(1, 65), lambda n : pow(CAST(a.embedding[n] AS DOUBLE) - CAST(b.embedding[n] AS DOUBLE), 2)))) AS d FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS n FROM k), n2 AS (SELECT q, max(CASE WHEN n = 1 THEN i END) AS best, max(CASE WHEN n = 1 THEN d END) AS d1, max(CASE WHEN n = 2 THEN d END) AS d2 FROM r WHERE n <= 2 GROUP BY q)"""


@query("ratio_match", f"WITH {KNN} SELECT q, best, round(d1, 6) + 0.0 AS d1, round(d2, 6) + 0.0 AS d2 FROM n2 WHERE d1 < 0.9 * d2")
def ratio_match(spark, d):
    return rounded(match.ratio_match(_vectors(spark, d, 0, "q", "qv"), _vectors(spark, d, 1, "i", "iv"), 0.9), "d1", "d2")


@query(
    "mutual_match",
    f"""WITH {KNN}, back AS (SELECT i, arg_min(q, d) AS q FROM (SELECT * FROM k ORDER BY d, q) GROUP BY i)
 SELECT n2.q AS a, n2.best AS b, round(d1, 6) + 0.0 AS d1 FROM n2 JOIN back ON back.i = n2.best AND back.q = n2.q""",
)
def mutual_match(spark, d):
    return rounded(match.mutual_match(_vectors(spark, d, 0, "q", "qv"), _vectors(spark, d, 1, "q", "qv")), "d1")


@query(
    "cone_search",
    """WITH c AS (SELECT c_custkey AS id, (c_custkey * 7.3) % 360 AS ra, (c_custkey * 3.1) % 180 - 90 AS dec, c_acctbal AS mag FROM customer),
 s AS (SELECT *, degrees(2 * asin(sqrt(pow(sin(radians(dec - 20) / 2), 2) + cos(radians(dec)) * cos(radians(20)) * pow(sin(radians(ra - 100) / 2), 2)))) AS sep FROM c WHERE dec BETWEEN -10 AND 50)
 SELECT id, round(sep, 6) + 0.0 AS separation FROM s WHERE sep <= 30 ORDER BY mag LIMIT 800""",
)
def cone_search(spark, d):
    c = tables.table(spark, d, "customer").selectExpr("c_custkey id", "(c_custkey * 7.3D) % 360 ra", "(c_custkey * 3.1D) % 180 - 90 dec", "c_acctbal mag")
    return rounded(match.cone_search(c, 100.0, 20.0, 30.0, "mag").select("id", "separation"), "separation")


@query(
    "channel_gains",
    """WITH m AS (SELECT p_brand AS channel, l_extendedprice / l_quantity AS measured, p_retailprice AS expected FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT channel, round(least(greatest(median(expected / measured), 0.4), 2.5), 6) + 0.0 AS gain, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 10""",
)
def channel_gains(spark, d):
    l, p = tables.table(spark, d, "lineitem"), tables.table(spark, d, "part")
    m = l.join(p, l["l_partkey"] == p["p_partkey"]).selectExpr("p_brand channel", "l_extendedprice / l_quantity measured", "p_retailprice expected")
    return rounded(match.channel_gains(m), "gain")


EDGES = "e AS (SELECT n_nationkey AS i, (n_nationkey * 2 + 1) % 25 AS j, 1.0 + n_regionkey / 10.0 AS factor FROM nation WHERE n_nationkey <> (n_nationkey * 2 + 1) % 25)"


@query(
    "pair_graph",
    f"""WITH RECURSIVE {EDGES}, b AS (SELECT * FROM e UNION ALL SELECT j, i, 1 / factor FROM e),
 w AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT CAST(b.j AS BIGINT), depth + 1 FROM w JOIN b ON b.i = w.node WHERE depth < 12),
 s AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT node, CAST(depth AS BIGINT) AS depth FROM s""",
)
def pair_graph(spark, d):
    e = tables.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) i", "CAST((n_nationkey * 2 + 1) % 25 AS BIGINT) j", "1.0D + n_regionkey / 10.0D factor").filter("i <> j")
    return rounded(match.pair_graph(e).select("node", "depth"))


@query(
    "pair_products",
    f"""WITH RECURSIVE {EDGES}, b AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(factor AS DOUBLE) AS factor FROM e UNION ALL SELECT j, i, 1 / CAST(factor AS DOUBLE) FROM e),
 w AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT b.j, depth + 1 FROM w JOIN b ON b.i = w.node WHERE depth < 25),
 s AS (SELECT node, min(depth) AS depth FROM w GROUP BY node),
 p AS (SELECT t.node, t.depth, f.node AS above, b.factor FROM s t JOIN b ON b.j = t.node JOIN s f ON f.node = b.i AND f.depth = t.depth - 1 QUALIFY row_number() OVER (PARTITION BY t.node ORDER BY f.node, b.factor) = 1),
 r AS (SELECT CAST(0 AS BIGINT) AS node, 1.0::DOUBLE AS factor UNION ALL SELECT p.node, r.factor * p.factor FROM r JOIN p ON p.above = r.node)
 SELECT node, CAST(depth AS BIGINT) AS depth, round(factor, 6) + 0.0 AS factor FROM r JOIN s USING (node)""",
)
def pair_products(spark, d):
    """The products that ``pair_graph`` computes along its shortest paths."""
    e = tables.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) i", "CAST((n_nationkey * 2 + 1) % 25 AS BIGINT) j", "1.0D + n_regionkey / 10.0D factor").filter("i <> j")
    return rounded(match.pair_graph(e).select("node", "depth", "factor"), "factor")


TRI = """tri AS (SELECT {p} AS f, a.id AS a, b.id AS b, c.id AS c, list_sort([sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), sqrt(pow(b.x - c.x, 2) + pow(b.y - c.y, 2)), sqrt(pow(a.x - c.x, 2) + pow(a.y - c.y, 2))]) AS s
 FROM {t} a JOIN {t} b ON a.id < b.id JOIN {t} c ON b.id < c.id WHERE c.id < 10)"""


@query(
    "triangle_votes",
    f"""WITH {POINTS}, ta AS (WITH {TRI.format(p=0, t="pa")} SELECT a, b, c, s[1] / s[3] AS r1, s[2] / s[3] AS r2 FROM tri), tb AS (WITH {TRI.format(p=1, t="pb")} SELECT a, b, c, s[1] / s[3] AS r1, s[2] / s[3] AS r2 FROM tri),
 m AS (SELECT ta.a AS ra, ta.b AS rb, ta.c AS rc, tb.a AS ma, tb.b AS mb, tb.c AS mc FROM ta JOIN tb ON abs(ta.r1 - tb.r1) < 0.02 AND abs(ta.r2 - tb.r2) < 0.02),
 u AS (SELECT unnest([ra, ra, ra, rb, rb, rb, rc, rc, rc]) AS ref, unnest([ma, mb, mc, ma, mb, mc, ma, mb, mc]) AS mov FROM m) SELECT CAST(ref AS BIGINT) AS ref, CAST(mov AS BIGINT) AS mov, count(*) AS votes FROM u GROUP BY ALL""",
)
def triangle_votes(spark, d):
    ref = match.triangles(_points(spark, d, 0).withColumn("f", F.lit(0)), ["f"], 10)
    mov = match.triangles(_points(spark, d, 1, 7.5).withColumn("f", F.lit(1)), ["f"], 10)
    return rounded(match.triangle_votes(ref, mov))


@query("stack_optimizer")
def stack_optimizer(spark, d):
    """Greedy set cover per series: no SQL; the tests hold it against a plain loop."""
    return select.greedy_cover(_tiles(spark, d))
