"""Queries of fusion, deghosting, lucky imaging and verdicts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine, fusion
from ..sources import tables
from . import kernel_sql as k
from .frames import FRAME, PX, query, rounded

SERIES = ["series_id"]
SECOND = k.weights("l2", k.taps([(-1, "1"), (0, "-2"), (1, "1")]))
SLOPE = k.weights("l1", k.taps([(-1, "-0.5"), (1, "0.5")]))
BYTES = f"{PX}, p8 AS MATERIALIZED (SELECT series_id, seq, y, x, (v + 1) / 2 * 255 AS v FROM px)"
COLOUR = """cf AS MATERIALIZED (SELECT CAST(label AS BIGINT) AS series_id, vec_id AS seq, (i - 1) // 8 AS y, (i - 1) % 8 AS x, (CAST(embedding[i] AS DOUBLE) + 1) / 2 AS b,
  (CAST(embedding[i % 64 + 1] AS DOUBLE) + 1) / 2 AS g, (CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) + 1) / 2 AS r FROM embeddings, range(1, 65) t(i))"""


def _unit(spark, d):
    return tables.pixels(spark, d).withColumn("v", (F.col("v") + 1.0) / 2.0)


def _bytes(spark, d):
    return tables.pixels(spark, d).withColumn("v", (F.col("v") + 1.0) / 2.0 * 255.0)


def _lap(name: str, source: str) -> str:
    return ",\n ".join((k.along(f"{name}_y", source, "l2", "y"), k.along(f"{name}_x", source, "l2", "x"), k.pixelwise(name, "a.v + b.v", f"{name}_y", f"{name}_x")))


def _sml(name: str, source: str) -> str:
    return ",\n ".join((k.along(f"{name}_y", source, "l2", "y"), k.along(f"{name}_x", source, "l2", "x"), k.pixelwise(name, "abs(a.v) + abs(b.v)", f"{name}_y", f"{name}_x")))


def _grad(name: str, source: str) -> str:
    return ",\n ".join((k.along(f"{name}_y", source, "l1", "y"), k.along(f"{name}_x", source, "l1", "x"), k.pixelwise(name, "sqrt(a.v * a.v + b.v * b.v)", f"{name}_y", f"{name}_x")))


def _square(name: str, source: str, pick: str, radius: int) -> str:
    """An aggregate over the square around each pixel, inside the frame."""
    return f"{name} AS MATERIALIZED (SELECT a.series_id, a.seq, a.y, a.x, {pick}(b.v) AS v FROM {source} a JOIN {source} b ON a.series_id = b.series_id AND a.seq = b.seq AND abs(a.y - b.y) <= {radius} AND abs(a.x - b.x) <= {radius} GROUP BY ALL)"


def _voted(energy: str) -> str:
    return f"""iw AS MATERIALIZED (SELECT series_id, y, x, arg_max(seq, (v, -seq)) AS seq FROM {energy} GROUP BY series_id, y, x),
 vw AS MATERIALIZED (SELECT c.series_id, c.y, c.x, list_sort(list(i.seq))[13] AS seq FROM iw c, (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx)) o, iw i
  WHERE i.series_id = c.series_id AND i.y = least(greatest(c.y + dy, 0), 7) AND i.x = least(greatest(c.x + dx, 0), 7) GROUP BY ALL),
 rs AS (SELECT series_id, y, x, seq AS winner, v AS value FROM u JOIN vw USING (series_id, seq, y, x))"""


def _apart(source: str) -> str:
    return f"""dv AS (SELECT series_id, y, x, stddev_pop(v) AS d FROM {source} GROUP BY ALL), dt AS (SELECT series_id, max(d) AS t FROM dv GROUP BY ALL),
 da AS (SELECT dv.series_id, y, x, d / greatest(t, 1e-6) AS disagreement FROM dv JOIN dt USING (series_id))"""


@query("focus_average", k.statement(k.UNIT, SECOND, _sml("fm", "u"), _square("bx", "fm", "avg", 4), last="SELECT series_id, y, x, round(sum((bx.v + 1e-6) * u.v) / sum(bx.v + 1e-6), 6) + 0.0 AS value FROM bx JOIN u USING (series_id, seq, y, x) GROUP BY ALL"))
def focus_average(spark, d):
    return rounded(fusion.focus_average(_unit(spark, d), SERIES, "seq"), "value")


@query("color_reassign", k.statement(k.UNIT, SECOND, _sml("fm", "u"), _voted("fm"), last="SELECT series_id, y, x, winner, round(value, 6) + 0.0 AS value FROM rs"))
def color_reassign(spark, d):
    return rounded(fusion.reassign(_unit(spark, d), SERIES, "seq"), "value")


@query(
    "deghost_sharpest",
    k.statement(
        k.UNIT, SECOND, _sml("fm", "u"), _square("bx", "fm", "avg", 3), _voted("bx"), _apart("u"),
        "mg AS (SELECT series_id, y, x, avg(v) AS m FROM u GROUP BY ALL)",
        f"o AS (SELECT series_id, y, x, m, value, {k.clip('(disagreement - 0.35) / 0.65')} AS w FROM mg JOIN rs USING (series_id, y, x) JOIN da USING (series_id, y, x))",
        last="SELECT series_id, y, x, round(m * (1 - w) + value * w, 6) + 0.0 AS value FROM o",
    ),
)
def deghost_sharpest(spark, d):
    px = _unit(spark, d)
    return rounded(fusion.deghost_sharpest(px, combine.average(px, ["series_id", "y", "x"]), SERIES, "seq"), "value")


@query(
    "consistent_merge",
    k.statement(
        k.UNIT, *k.pyramid(), k.weights("bx8", k.box(2), 8), k.weights("bx4", k.box(2), 4),
        k.pixelwise("a0", "abs(a.v)", "p0"), k.pixelwise("a1", "abs(a.v)", "p1"), k.apply("n0", "a0", "bx8"), k.apply("n1", "a1", "bx4"),
        *[f"w{b} AS MATERIALIZED (SELECT series_id, y, x, arg_max(seq, (v, -seq)) AS f, max(v) AS e FROM n{b} GROUP BY series_id, y, x)" for b in (0, 1)],
        "t0 AS (SELECT w.series_id, w.y, w.x, CASE WHEN w.e > n.v * 1.25 + 1e-6 THEN w.f ELSE q.f END AS f FROM w0 w JOIN w1 q ON q.series_id = w.series_id AND q.y = w.y // 2 AND q.x = w.x // 2 JOIN n0 n ON n.series_id = w.series_id AND n.seq = q.f AND n.y = w.y AND n.x = w.x)",
        "m0 AS MATERIALIZED (SELECT p.series_id, 0 AS seq, p.y, p.x, p.v FROM p0 p JOIN t0 t ON t.series_id = p.series_id AND t.f = p.seq AND t.y = p.y AND t.x = p.x)",
        "m1 AS MATERIALIZED (SELECT p.series_id, 0 AS seq, p.y, p.x, p.v FROM p1 p JOIN w1 t ON t.series_id = p.series_id AND t.f = p.seq AND t.y = p.y AND t.x = p.x)",
        "m2 AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, avg(v) AS v FROM h2 GROUP BY series_id, y, x)", *k.collapse("o"),
        last="SELECT series_id, y, x, round(v, 6) + 0.0 AS v FROM o",
    ),
)
def consistent_merge(spark, d):
    return rounded(fusion.consistent_merge(_unit(spark, d), SERIES, "seq"), "v")


WEIGHTS = k.statement(
    COLOUR, SECOND, "gr AS MATERIALIZED (SELECT series_id, seq, y, x, 0.114 * b + 0.587 * g + 0.299 * r AS v FROM cf)", _lap("lp", "gr"),
    """rw AS MATERIALIZED (SELECT series_id, seq, y, x, abs(v) * sqrt((pow(b - (b + g + r) / 3, 2) + pow(g - (b + g + r) / 3, 2) + pow(r - (b + g + r) / 3, 2)) / 3)
  * exp(-(pow(b - 0.5, 2) + pow(g - 0.5, 2) + pow(r - 0.5, 2)) / 0.08) + 1e-12 AS w FROM cf JOIN lp USING (series_id, seq, y, x))""",
    "wt AS MATERIALIZED (SELECT series_id, seq, y, x, w / sum(w) OVER (PARTITION BY series_id, y, x) AS v FROM rw)", last="",
).rstrip()


@query("exposure_weights", f"{WEIGHTS}\nSELECT series_id, seq, y, x, round(v, 6) + 0.0 AS weight FROM wt")
def exposure_weights(spark, d):
    return rounded(fusion.exposure_weights(tables.colour_frames(spark, d), SERIES, "seq").drop("b", "g", "r"), "weight")


def _fused() -> str:
    ctes = ["pl AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT series_id, seq * 3 + {c} AS seq, y, x, {n} AS v FROM cf" for c, n in enumerate("bgr")) + ")", *k.pyramid("pl")]
    ctes += [k.apply("wt1", "wt", "hv8"), k.apply("wt2", "wt1", "hv4")]
    for b, (band, share) in enumerate((("p0", "wt"), ("p1", "wt1"), ("h2", "wt2"))):
        ctes.append(f"m{b} AS MATERIALIZED (SELECT p.series_id, p.seq % 3 AS seq, p.y, p.x, sum(p.v * w.v) AS v FROM {band} p JOIN {share} w ON w.series_id = p.series_id AND w.seq = p.seq // 3 AND w.y = p.y AND w.x = p.x GROUP BY ALL)")
    ctes += k.collapse("o")
    return WEIGHTS + ",\n " + ",\n ".join(ctes) + f"\nSELECT series_id, seq AS c, y, x, round({k.clip('v')}, 6) + 0.0 AS value FROM o"


@query("exposure_fusion", _fused())
def exposure_fusion(spark, d):
    return rounded(fusion.exposure_fusion(fusion.exposure_weights(tables.colour_frames(spark, d), SERIES, "seq"), SERIES, "seq"), "value")


@query(
    "deghost_exposures",
    k.statement(
        BYTES, SLOPE,
        "wl AS (SELECT series_id, seq, count(*) FILTER (v > 13 AND v < 242) AS n FROM p8 GROUP BY ALL)",
        "rf AS (SELECT series_id, arg_max(seq, (n, -seq)) AS ref FROM wl GROUP BY ALL)",
        "md AS (SELECT series_id, seq, median(v + 1e-3) AS m FROM p8 GROUP BY ALL)",
        "gn AS (SELECT md.series_id, md.seq, CASE WHEN md.seq = ref THEN NULL ELSE t.m / md.m END AS gain FROM md JOIN rf USING (series_id) JOIN md t ON t.series_id = md.series_id AND t.seq = ref)",
        "mt AS MATERIALIZED (SELECT series_id, seq, y, x, CASE WHEN gain IS NULL THEN v + 1e-3 ELSE least(greatest((v + 1e-3) * gain, 0), 255) END AS v FROM p8 JOIN gn USING (series_id, seq))",
        _grad("gd", "mt"),
        "dv AS MATERIALIZED (SELECT g.series_id, g.seq, g.y, g.x, abs(g.v - b.v) AS d FROM gd g JOIN rf USING (series_id) JOIN gd b ON b.series_id = g.series_id AND b.seq = ref AND b.y = g.y AND b.x = g.x WHERE g.seq <> ref)",
        "mm AS (SELECT series_id, seq, median(d) AS m FROM dv GROUP BY ALL)",
        "ct AS (SELECT series_id, seq, any_value(m) + 4 * (median(abs(d - m)) * 1.4826 + 1e-6) AS c FROM dv JOIN mm USING (series_id, seq) GROUP BY ALL)",
        "mv AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, max(CASE WHEN d > c THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM dv JOIN ct USING (series_id, seq) GROUP BY series_id, y, x)",
        _square("m1", "mv", "max", 2), _square("m2", "m1", "min", 2), _square("m3", "m2", "min", 1), _square("m4", "m3", "max", 1),
        k.weights("g4", k.gauss(4.0, 12)), k.apply("so", "m4", "g4"),
        "fu AS (SELECT series_id, y, x, avg(v) AS f FROM p8 GROUP BY ALL)",
        "rp AS (SELECT series_id, y, x, v AS r FROM p8 JOIN rf ON rf.series_id = p8.series_id AND ref = seq)",
        last="SELECT series_id, y, x, round(least(greatest(f * (1 - v) + r * v, 0), 255), 6) + 0.0 AS value FROM fu JOIN so USING (series_id, y, x) JOIN rp USING (series_id, y, x)",
    ).replace("SELECT series_id, y, x, v AS r FROM p8 JOIN", "SELECT p8.series_id, y, x, v AS r FROM p8 JOIN"),
)
def deghost_exposures(spark, d):
    px = _bytes(spark, d)
    return rounded(fusion.deghost_exposures(px, combine.average(px, ["series_id", "y", "x"]), SERIES, "seq"), "value")


@query(
    "lucky_stack",
    k.statement(
        k.UNIT, SECOND, _lap("lp", "u"),
        "q AS (SELECT series_id, seq, var_pop(lp.v) / pow(avg(u.v) + 1, 2) AS q FROM lp JOIN u USING (series_id, seq, y, x) GROUP BY ALL)",
        "kp AS (SELECT series_id, seq FROM q QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY q DESC, seq) <= greatest(1, floor(count(*) OVER (PARTITION BY series_id) * 0.3::DOUBLE)))",
        last="SELECT series_id, y, x, round(avg(v), 6) + 0.0 AS value FROM u JOIN kp USING (series_id, seq) GROUP BY ALL",
    ),
)
def lucky_stack(spark, d):
    return rounded(fusion.lucky_stack(_unit(spark, d), SERIES, "seq"), "value")


@query(
    "lucky_map",
    k.statement(
        k.UNIT,
        "c AS MATERIALIZED (SELECT series_id, seq, py, px, y, x, v FROM u, (VALUES (2), (4), (6)) a(py), (VALUES (2), (4), (6)) b(px) WHERE y >= py - 2 AND y < py + 2 AND x >= px - 2 AND x < px + 2)",
        "gx AS (SELECT a.series_id, a.seq, a.py, a.px, avg(abs(a.v - b.v)) AS g FROM c a JOIN c b ON a.series_id = b.series_id AND a.seq = b.seq AND a.py = b.py AND a.px = b.px AND a.y = b.y AND a.x = b.x + 1 GROUP BY ALL)",
        "gy AS (SELECT a.series_id, a.seq, a.py, a.px, avg(abs(a.v - b.v)) AS h FROM c a JOIN c b ON a.series_id = b.series_id AND a.seq = b.seq AND a.py = b.py AND a.px = b.px AND a.x = b.x AND a.y = b.y + 1 GROUP BY ALL)",
        "kp AS (SELECT series_id, seq, py, px FROM gx JOIN gy USING (series_id, seq, py, px) QUALIFY row_number() OVER (PARTITION BY series_id, py, px ORDER BY least(g, h) DESC, seq) <= greatest(1, floor(count(*) OVER (PARTITION BY series_id, py, px) * 0.3::DOUBLE)))",
        "m AS (SELECT series_id, py, px, y, x, avg(v) AS v, (0.5 - 0.5 * cos(2 * pi() * (y - py + 2.5) / 4)) * (0.5 - 0.5 * cos(2 * pi() * (x - px + 2.5) / 4)) AS w FROM c JOIN kp USING (series_id, seq, py, px) GROUP BY series_id, py, px, y, x)",
        last="SELECT series_id, y, x, round(sum(w * v) / sum(w), 6) + 0.0 AS value FROM m GROUP BY ALL",
    ),
)
def lucky_map(spark, d):
    return rounded(fusion.lucky_map(_unit(spark, d), SERIES, "seq"), "value")


@query(
    "stack_score",
    k.statement(
        BYTES, SECOND, SLOPE, "av AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, avg(v) AS v FROM p8 GROUP BY series_id, y, x)",
        _lap("lp", "av"), _grad("gd", "av"), k.weights("g2", k.gauss(2.0, 6)), k.apply("so", "av", "g2"), _apart("p8"),
        "sh AS (SELECT series_id, var_pop(v) AS sharpness FROM lp GROUP BY ALL)",
        "ha AS (SELECT series_id, avg(greatest(av.v - so.v, 0)) AS halo FROM av JOIN so USING (series_id, seq, y, x) JOIN gd USING (series_id, seq, y, x) WHERE gd.v > 1.5 GROUP BY ALL)",
        "cu AS (SELECT series_id, avg(disagreement) + 4 * stddev_pop(disagreement) AS c FROM da GROUP BY ALL)",
        "ar AS (SELECT series_id, avg(CASE WHEN disagreement > c THEN 1.0 ELSE 0.0 END) AS area FROM da JOIN cu USING (series_id) GROUP BY ALL)",
        "n AS (SELECT series_id, count(DISTINCT seq) AS n FROM p8 GROUP BY ALL)",
        "al AS (SELECT series_id, sharpness, coalesce(halo, 0) AS halo, CASE WHEN n >= 3 THEN area ELSE 0 END AS area FROM sh LEFT JOIN ha USING (series_id) JOIN ar USING (series_id) JOIN n USING (series_id))",
        last="""SELECT series_id, CAST(100 - CASE WHEN halo > 6 THEN 12 ELSE 0 END - CASE WHEN sharpness < 50 THEN 12 ELSE 0 END - CASE WHEN area > 0.002 THEN 15 ELSE 0 END AS BIGINT) AS score,
 round(sharpness, 6) + 0.0 AS sharpness, round(halo, 6) + 0.0 AS halo, round(100 * area, 6) + 0.0 AS ghost_area_pct,
 concat_ws(',', CASE WHEN halo > 6 THEN 'halos' END, CASE WHEN sharpness < 50 THEN 'soft' END, CASE WHEN area > 0.002 THEN 'ghosts' END) AS findings FROM al""",
    ),
)
def stack_score(spark, d):
    px = _bytes(spark, d)
    mean = combine.average(px, ["series_id", "y", "x"]).withColumnRenamed("value", "v")
    return rounded(fusion.stack_score(mean, px, SERIES, "seq", edge=1.5), "sharpness", "halo", "ghost_area_pct")


def _suggested() -> str:
    sample = f"""{BYTES}, fr AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT DISTINCT series_id, seq FROM p8)),
 sa AS (SELECT DISTINCT fr.series_id, fr.seq FROM fr, range(8) r(j) WHERE j < least(8, n) AND i = CASE WHEN n = 1 THEN 0 ELSE j * (n - 1) // (least(8, n) - 1) END),
 u AS MATERIALIZED (SELECT p8.* FROM p8 JOIN sa USING (series_id, seq))"""
    shift, last = k.SQL["global_shift"].removeprefix(f"WITH {k.UNIT},\n ").rsplit("\nSELECT ", 1)
    rest = [
        "pp AS (SELECT series_id, y, x, avg(v) AS m, max(v) AS top FROM u GROUP BY ALL)",
        "mo AS (SELECT series_id, y, x, abs(v - m) AS d, m, top FROM u JOIN pp USING (series_id, y, x))",
        "cu AS (SELECT series_id, avg(d) + 2 * stddev_pop(d) + 1e-6 AS c FROM mo GROUP BY ALL)",
        "sp AS (SELECT series_id, y, x, any_value(m) AS m, any_value(top) AS top, max(d) > any_value(c) AS moving FROM mo JOIN cu USING (series_id) GROUP BY series_id, y, x)",
        "st AS (SELECT series_id, avg(CASE WHEN moving THEN 1.0 ELSE 0.0 END) AS mf, avg(m) / 255 AS mb, coalesce(avg(CASE WHEN moving THEN top - m END), 0) AS bm FROM sp GROUP BY ALL)",
        f"sf AS (SELECT series_id, max(sqrt(dy * dy + dx * dx)) / 8 AS s FROM (SELECT {last}) GROUP BY ALL)",
    ]
    mode = "CASE WHEN mb < 0.28 AND bm > 18 THEN 'trails' WHEN mf > 0.02 AND mf < 0.25 THEN 'declutter' WHEN mb < 0.22 THEN 'bright' ELSE 'smooth' END"
    align = "CASE WHEN s > 0.10 THEN 'feature' WHEN s > 0.01 THEN 'shift' ELSE 'none' END"
    return k.statement(sample, shift, *rest, last=f"SELECT series_id, {mode} AS mode, {align} AS align, round(mf, 6) + 0.0 AS moving_frac, round(mb, 6) + 0.0 AS mean_bright, round(s, 6) + 0.0 AS shift_frac FROM st JOIN sf USING (series_id)")


@query("suggest_mode", _suggested())
def suggest_mode(spark, d):
    return rounded(fusion.suggest_mode(_bytes(spark, d), SERIES, "seq"), "moving_frac", "mean_bright", "shift_frac")


@query(
    "local_normalize",
    k.statement(
        k.UNIT, k.weights("g2", k.gauss(2.0, 6)), k.apply("so", "u", "g2"), "fi AS (SELECT series_id, min(seq) AS first FROM u GROUP BY ALL)",
        last="SELECT u.series_id, u.seq, u.y, u.x, round(u.v + r.v - so.v, 6) + 0.0 AS value FROM u JOIN so USING (series_id, seq, y, x) JOIN fi USING (series_id) JOIN so r ON r.series_id = u.series_id AND r.seq = first AND r.y = u.y AND r.x = u.x",
    ),
)
def local_normalize(spark, d):
    return rounded(fusion.local_normalize(_unit(spark, d), SERIES, "seq"), "value")
