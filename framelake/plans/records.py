"""Queries over records: metadata, groups, reports, exposures, overlays: (name, DataFrame builder, SQL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colour, curves
from ..operators import combine, score, sequence
from ..sources import images, tables
from .frames import DISAGREE, FRAME, LAP, ORDER, PX, SCORES, WON, _tiles, query, rounded
from .tones import BGR, _channels, _out, _unit


@query("fits_hints", "SELECT event_id AS id, round(coalesce(try_cast(json_extract_string(props, '$.RA') AS DOUBLE), try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0), 6) AS ra FROM events")
def fits_hints(spark, d):
    first = F.coalesce(*[F.get_json_object("props", f"$.{k}").try_cast("double") for k in ("RA", "k")], F.lit(0.0))
    return tables.table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(first, 6).alias("ra"))


@query("capture_date", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y:%m:%d') END, CASE WHEN o_orderstatus = 'O' THEN 'modified ' || o_custkey END, 'unknown') AS taken FROM orders")
def capture_date(spark, d):
    original = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy:MM:dd"))
    other = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("modified "), F.col("o_custkey").cast("string")))
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(original, other, F.lit("unknown")).alias("taken"))


@query("data_url", "SELECT item_id AS id, 'data:text/plain;base64,' || to_base64(encode(text)) AS url FROM benchmark")
def data_url(spark, d):
    url = F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""))
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), url.alias("url"))


@query("export_presets", f"SELECT p_partkey AS id, name, CASE WHEN side = 0 OR p_size * 100 <= side THEN p_size * 100 ELSE side END AS long_side FROM part, (VALUES {', '.join(f'({k!r}, {v[0]})' for k, v in images.PRESETS.items())}) t(name, side)")
def export_presets(spark, d):
    presets = spark.createDataFrame([(k, v[0]) for k, v in images.PRESETS.items()], "name string, side int")
    sized = tables.table(spark, d, "part").crossJoin(F.broadcast(presets))  # five rows
    side = F.when((F.col("side") == 0) | (F.col("p_size") * 100 <= F.col("side")), F.col("p_size") * 100).otherwise(F.col("side"))
    return sized.select(F.col("p_partkey").alias("id"), "name", side.cast("int").alias("long_side"))


@query("hybrid_groups", f"WITH {SCORES}, r AS (SELECT series_id, seq, row_number() OVER ({ORDER}) - 1 AS i FROM s) SELECT series_id, i // 12 AS block, count(*) AS frames, min(seq) AS first FROM r GROUP BY ALL")
def hybrid_groups(spark, d):
    w = Window.partitionBy("series_id").orderBy("ts", "seq")
    r = tables.scores(spark, d).withColumn("block", F.floor((F.row_number().over(w) - 1) / 12))
    return r.groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("frames"), F.min("seq").alias("first"))


@query("calibration_lookup", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'darks' WHEN s_suppkey % 4 IN (1, 2) THEN 'flat' END AS folder FROM supplier")
def calibration_lookup(spark, d):
    """The first known name among a frame folder's siblings, by priority."""
    names = spark.createDataFrame([("dark", 0), ("darks", 1), ("flat", 2), ("flats", 3)], "name string, priority int")
    siblings = F.expr("CASE s_suppkey % 4 WHEN 0 THEN array('Flats', 'Darks') WHEN 1 THEN array('flat') WHEN 2 THEN array('lights', 'FLAT') ELSE array('lights') END")
    s = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(siblings).alias("sibling"))
    found = s.join(F.broadcast(names), F.lower("sibling") == F.col("name"), "left")
    return found.groupBy("id").agg(F.min_by("name", "priority").alias("folder"))


@query("options_merge", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '7' ELSE '12' END AS sharpen, c_mktsegment AS mode FROM customer")
def options_merge(spark, d):
    base = F.create_map(F.lit("sharpen"), F.lit("12"), F.lit("mode"), F.lit("macro"))
    given = F.map_filter(F.create_map(F.lit("sharpen"), F.when(F.col("c_custkey") % 3 == 0, "7"), F.lit("mode"), F.col("c_mktsegment")), lambda k, v: v.isNotNull())
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k))), F.map_entries(given)))
    c = tables.table(spark, d, "customer").withColumn("o", merged)
    return c.select(F.col("c_custkey").alias("id"), F.element_at("o", "sharpen").alias("sharpen"), F.element_at("o", "mode").alias("mode"))


@query("sharpest_kept", f"WITH {LAP}, ti AS (SELECT series_id, seq, var_pop(lap) AS s FROM lp GROUP BY ALL) SELECT series_id, arg_max(seq, (s, -seq)) AS seq FROM ti WHERE seq % 3 <> 0 GROUP BY ALL")
def sharpest_kept(spark, d):
    lap = score.laplacian(tables.pixels(spark, d), FRAME).groupBy(*FRAME).agg(F.var_pop("lap").alias("s"))
    return rounded(lap.filter("seq % 3 <> 0").groupBy("series_id").agg(F.max_by("seq", F.struct("s", -F.col("seq"))).alias("seq")))


@query("gather_sources", f"WITH {SCORES} SELECT series_id, seq FROM s WHERE event_type <> 'error' QUALIFY row_number() OVER ({ORDER}) <= 16")
def gather_sources(spark, d):
    w = Window.partitionBy("series_id").orderBy("ts", "seq")
    kept = tables.scores(spark, d).filter("event_type <> 'error'").withColumn("r", F.row_number().over(w))
    return kept.filter("r <= 16").select("series_id", "seq")


@query("local_quality", f"WITH {PX}, n AS (SELECT series_id, seq, abs(v - lag(v) OVER (PARTITION BY series_id, seq, y ORDER BY x)) AS dx, abs(v - lag(v) OVER (PARTITION BY series_id, seq, x ORDER BY y)) AS dy FROM px) SELECT series_id, seq, round(least(avg(dx), avg(dy)), 6) + 0.0 AS quality FROM n GROUP BY ALL")
def local_quality(spark, d):
    across, down = Window.partitionBy(*FRAME, "y").orderBy("x"), Window.partitionBy(*FRAME, "x").orderBy("y")
    n = tables.pixels(spark, d).select(*FRAME, F.abs(F.col("v") - F.lag("v").over(across)).alias("dx"), F.abs(F.col("v") - F.lag("v").over(down)).alias("dy"))
    return rounded(n.groupBy(*FRAME).agg(F.least(F.avg("dx"), F.avg("dy")).alias("quality")), "quality")


@query("sharpness_score", f"WITH {LAP} SELECT series_id, seq, round(var_pop(lap) / pow(avg(v) + 2, 2), 6) + 0.0 AS score FROM lp GROUP BY ALL")
def sharpness_score(spark, d):
    lap = score.laplacian(tables.pixels(spark, d), FRAME)
    return rounded(lap.groupBy(*FRAME).agg((F.var_pop("lap") / F.pow(F.avg("v") + 2.0, F.lit(2.0))).alias("score")), "score")


@query("pixel_edits", f"WITH {BGR}, e AS (SELECT series_id, seq, p, {_unit('b * pow(2, 0.2) * (1 - 0.09)')} AS b, {_unit('g * pow(2, 0.2)')} AS g, {_unit('r * pow(2, 0.2) * (1 + 0.09)')} AS r FROM ch),\n c AS (SELECT series_id, seq, p, {', '.join(_unit(f'({x} - 0.5) * 1.1 + 0.5') + f' AS {x}' for x in 'bgr')} FROM e), l AS (SELECT *, (b + g + r) / 3 AS l FROM c) SELECT {_out(*[_unit(f'l + ({x} - l) * 1.25') for x in 'bgr'])} FROM l")
def pixel_edits(spark, d):
    return _channels(tables.colours(spark, d), colour.edit(F.col("b"), F.col("g"), F.col("r"), 20.0, 30.0, 10.0, 25.0))


@query("ghost_overlay", f"WITH {DISAGREE}, a AS (SELECT *, 0.6 * least(greatest((disagreement - 0.8) / 0.2, 0.0), 1.0) AS a FROM da) SELECT series_id, y, x, round(0.5 * (1 - a) + a, 6) + 0.0 AS red FROM a")
def ghost_overlay(spark, d):
    alpha = 0.6 * curves.clip((F.col("disagreement") - 0.8) / 0.2)
    da = score.disagreement(tables.pixels(spark, d), ["series_id"])
    return rounded(da.select("series_id", "y", "x", curves.masked(F.lit(0.5), F.lit(1.0), alpha).alias("red")), "red")


@query("focus_map", f"WITH {WON}, tp AS (SELECT series_id, tile, max(s) AS peak FROM ti GROUP BY ALL), q AS (SELECT series_id, quantile_cont(peak, 0.95) + 1e-6 AS q FROM tp GROUP BY ALL) SELECT won.series_id, tile, winner, round({_unit('(peak / q - 0.1) / 0.4')}, 6) + 0.0 AS confidence FROM won JOIN q USING (series_id)")
def focus_map(spark, d):
    tiles = _tiles(spark, d)
    top = tiles.groupBy("series_id", "tile").agg(F.max("s").alias("peak")).groupBy("series_id").agg((F.expr("percentile(peak, 0.95D)") + 1e-6).alias("q"))
    won = score.tile_winners(tiles, ["series_id"], "seq").join(top, "series_id")
    return rounded(won.select("series_id", "tile", "winner", curves.clip((F.col("peak") / F.col("q") - 0.1) / 0.4).alias("confidence")), "confidence")


@query("breathing_scale", f"WITH {SCORES}, e AS (SELECT series_id, seq, ts, v, first_value(v) OVER f AS a, last_value(v) OVER f AS b, nth_value(v, 1) OVER f AS ref FROM s WINDOW f AS ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),\n t AS (SELECT series_id, seq, ref, CASE WHEN b >= a THEN max(v) OVER w ELSE min(v) OVER w END AS t FROM e WINDOW w AS ({ORDER} ROWS UNBOUNDED PRECEDING)) SELECT series_id, seq, round(t / (ref + 1), 6) + 0.0 AS scale FROM t")
def breathing_scale(spark, d):
    w = Window.partitionBy("series_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = tables.scores(spark, d).withColumn("ref", F.first("v").over(w))
    t = sequence.monotone(s, ["series_id"], ["ts", "seq"])
    return rounded(t.select("series_id", "seq", (F.col("trend") / (F.col("ref") + 1)).alias("scale")), "scale")


@query("well_exposedness", f"WITH {PX}, w AS (SELECT series_id, y, x, (v + 1) / 2 AS v, exp(-pow((v + 1) / 2 - 0.5, 2) / 0.08) AS w FROM px) SELECT series_id, y, x, round(sum(w * v) / greatest(sum(w), 1e-6), 6) + 0.0 AS value FROM w GROUP BY ALL")
def well_exposedness(spark, d):
    px = tables.pixels(spark, d).withColumn("v", (F.col("v") + 1.0) / 2.0)
    px = px.withColumn("w", F.exp(-F.pow(F.col("v") - 0.5, F.lit(2.0)) / 0.08))
    return rounded(combine.average(px, ["series_id", "y", "x"], weight="w"), "value")


@query("radiance_merge", f"WITH {PX}, w AS (SELECT series_id, y, x, (v + 1) / 2 AS v, 1.0 + seq % 3 AS t FROM px), u AS (SELECT *, 1 - abs(2 * v - 1) + 1e-3 AS w FROM w) SELECT series_id, y, x, round(exp(sum(w * (ln(v + 1e-6) - ln(t))) / sum(w)), 6) + 0.0 AS value FROM u GROUP BY ALL")
def radiance_merge(spark, d):
    """Weighted mean of log values over log exposures, linear response."""
    px = tables.pixels(spark, d).withColumns({"u": (F.col("v") + 1.0) / 2.0, "t": 1.0 + F.col("seq") % 3})
    weight = 1.0 - F.abs(2.0 * F.col("u") - 1.0) + 1e-3
    px = px.withColumns({"w": weight, "l": F.log(F.col("u") + 1e-6) - F.log("t")})
    return rounded(px.groupBy("series_id", "y", "x").agg(F.exp(F.sum(F.col("w") * F.col("l")) / F.sum("w")).alias("value")), "value")


@query("two_level_stack", f"WITH {PX}, p AS (SELECT series_id, seq % 4 AS pos, y, x, CASE WHEN count(*) < 8 THEN avg(v) ELSE median(v) END AS v FROM px GROUP BY ALL) SELECT series_id, y, x, round(max(v), 6) + 0.0 AS value FROM p GROUP BY ALL")
def two_level_stack(spark, d):
    """Per position a robust mean (a plain one under eight frames), then the lightest position."""
    px = tables.pixels(spark, d).withColumn("pos", F.col("seq") % 4)
    one = px.groupBy("series_id", "pos", "y", "x").agg(F.when(F.count(F.lit(1)) < 8, F.avg("v")).otherwise(F.median("v")).alias("v"))
    return rounded(one.groupBy("series_id", "y", "x").agg(F.max("v").alias("value")), "value")


@query("overlay_strength", f"WITH {PX}, a AS (SELECT series_id, y, x, avg(v) AS m, max(v) AS t FROM px GROUP BY ALL) SELECT series_id, y, x, round(m * 0.4 + t * 0.6, 6) + 0.0 AS value FROM a")
def overlay_strength(spark, d):
    a = tables.pixels(spark, d).groupBy("series_id", "y", "x").agg(F.avg("v").alias("m"), F.max("v").alias("t"))
    return rounded(a.select("series_id", "y", "x", curves.masked(F.col("m"), F.col("t"), F.lit(0.6)).alias("value")), "value")


@query("hue_bands", f"WITH {BGR}, h AS (SELECT series_id, CASE WHEN greatest(b, g, r) = r THEN 'r' WHEN greatest(b, g, r) = g THEN 'g' ELSE 'b' END AS lead FROM ch) SELECT series_id, lead, count(*) AS pixels FROM h GROUP BY ALL")
def hue_bands(spark, d):
    h = colour.hue(F.col("b"), F.col("g"), F.col("r")) * 360.0
    top = F.greatest("b", "g", "r")
    lead = F.when(top == F.col("r"), "r").when(top == F.col("g"), "g").otherwise("b")
    c = tables.colours(spark, d).withColumns({"hue": h, "lead": lead}).filter("hue >= 0")
    return rounded(c.groupBy("series_id", "lead").agg(F.count(F.lit(1)).alias("pixels")))


@query("star_shape", f"WITH {PX}, c AS (SELECT series_id, seq, median(v) + stddev_pop(v) AS c FROM px GROUP BY ALL), s AS (SELECT px.series_id, px.seq, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c, count(*) AS n FROM px JOIN c USING (series_id, seq) WHERE v > c.c GROUP BY ALL HAVING count(*) >= 3),\n e AS (SELECT *, (a + b) / 2 + sqrt(greatest(pow((a - b) / 2, 2) + c * c, 0)) AS l1, greatest((a + b) / 2 - sqrt(greatest(pow((a - b) / 2, 2) + c * c, 0)), 1e-6) AS l2 FROM s) SELECT series_id, seq, n, round(2.3548 * sqrt((l1 + l2) / 2), 6) + 0.0 AS fwhm, round(least(sqrt(l1 / l2), 100.0), 4) + 0.0 AS elongation FROM e")
def star_shape(spark, d):
    """Width and elongation of a frame's bright pixels by the eigenvalues of their covariance."""
    px = tables.pixels(spark, d)
    cut = px.groupBy(*FRAME).agg((F.median("v") + F.stddev_pop("v")).alias("cut"))
    s = px.join(cut, FRAME).filter("v > cut").groupBy(*FRAME).agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    root = F.sqrt(F.greatest(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"), F.lit(0.0)))
    s = s.withColumns({"l1": (F.col("a") + F.col("b")) / 2 + root, "l2": F.greatest((F.col("a") + F.col("b")) / 2 - root, F.lit(1e-6))})
    out = s.select(*FRAME, "n", (2.3548 * F.sqrt((F.col("l1") + F.col("l2")) / 2)).alias("fwhm"), (F.round(F.least(F.sqrt(F.col("l1") / F.col("l2")), F.lit(100.0)), 4) + 0.0).alias("elongation"))
    return rounded(out, "fwhm")
