"""Queries over colours, curves, masks, optics and metadata: (name, DataFrame builder, SQL)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import colour, curves, meta
from ..sources import tables
from .frames import PX, query, rounded

BGR = """ch AS (SELECT CAST(label AS BIGINT) AS series_id, vec_id AS seq, CAST(i AS BIGINT) AS p, (CAST(embedding[3 * i + 1] AS DOUBLE) + 1.0) / 2.0 AS b,
 (CAST(embedding[3 * i + 2] AS DOUBLE) + 1.0) / 2.0 AS g, (CAST(embedding[3 * i + 3] AS DOUBLE) + 1.0) / 2.0 AS r FROM embeddings, range(0, 21) t(i))"""
KEYS = ["series_id", "seq", "p"]
UNIT = "least(greatest({}, 0.0), 1.0)"


def _unit(x: str) -> str:
    return UNIT.format(x)


def _out(*columns: str) -> str:
    return "series_id, seq, p, " + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in zip(("b", "g", "r"), columns))


def _channels(df, columns):
    return rounded(df.select(*KEYS, *[c.alias(n) for n, c in zip("bgr", columns)]), "b", "g", "r")


def _bgr():
    return F.col("b"), F.col("g"), F.col("r")


def _curve(name: str, expression, sql: str):
    """A query of one number per colour pixel."""

    @query(name, f"WITH {BGR} SELECT series_id, seq, p, round({sql}, 6) + 0.0 AS value FROM ch")
    def run(spark, d):
        return rounded(tables.colours(spark, d).select(*KEYS, expression().alias("value")), "value")


def _smooth(e0: str, e1: str, x: str) -> str:
    t = _unit(f"(({x}) - ({e0})) / (({e1}) - ({e0}) + 1e-12)")
    return f"(({t}) * ({t}) * (3 - 2 * ({t})))"


_curve("smoothstep", lambda: curves.smoothstep(0.2, 0.8, F.col("g")), _smooth("0.2", "0.8", "g"))
_curve("gray", lambda: colour.gray(*_bgr()), "(b + g + r) / 3.0")
_curve("to_8bit", lambda: curves.to_8bit(F.floor(F.col("g") * 65535)).cast("double"), "floor(floor(g * 65535) / 256)")
_curve("filmic_curve", lambda: curves.filmic(F.col("g"), latitude=0.5), f"least(greatest(1.0 / (1.0 + exp(-{2.0 / (1 - 0.45)!r} * (log2(greatest(g, 1e-8) / 0.18) / 3.0))), 0.0), 1.0)")
_curve("gamma_srgb", lambda: curves.gamma_encode(F.col("g")), "CASE WHEN g <= 0.0031308 THEN g * 12.92 ELSE 1.055 * pow(g, 1 / 2.4) - 0.055 END")
_curve("gamma_rec709", lambda: curves.gamma_encode(F.col("g"), "rec709"), "CASE WHEN g < 0.018 THEN g * 4.5 ELSE 1.099 * pow(g, 0.45) - 0.099 END")
_curve("gamma_power", lambda: curves.gamma_encode(F.col("g"), 2.2), "pow(g, 1 / 2.2)")
_curve("screen_blend", lambda: curves.screen(F.col("b"), F.col("r"), 0.8, 0.6), f"1 - (1 - {_unit('b * 0.8')}) * (1 - {_unit('r * 0.6')})")
_curve("masked_blend", lambda: curves.masked(F.col("b"), F.col("r"), F.when(F.col("p") % 2 == 0, F.col("g")), F.lit(0.25)), "b * (1 - CASE WHEN p % 2 = 0 THEN g ELSE 0.25 END) + r * CASE WHEN p % 2 = 0 THEN g ELSE 0.25 END")
_curve("mask_luminance", lambda: colour.parametric_mask(*_bgr(), "luminance", 0.45, 0.55, 0.1), _unit(f"{_smooth('0.35', '0.45', '0.0722 * b + 0.7152 * g + 0.2126 * r')} * (1 - {_smooth('0.55', '0.65', '0.0722 * b + 0.7152 * g + 0.2126 * r')})"))
_SAT = "(greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r)"
_curve("mask_saturation", lambda: colour.parametric_mask(*_bgr(), "saturation", 0.1, 0.2, 0.1), _unit(f"{_smooth('0.0', '0.1', _SAT)} * (1 - {_smooth('0.2', '0.3', _SAT)})"))
_HUE = """(CASE WHEN greatest(b, g, r) = least(b, g, r) THEN 0 WHEN greatest(b, g, r) = r THEN (((g - b) / (greatest(b, g, r) - least(b, g, r)) / 6) + CASE WHEN g < b THEN 1 ELSE 0 END)
 WHEN greatest(b, g, r) = g THEN (2 + (b - r) / (greatest(b, g, r) - least(b, g, r))) / 6 ELSE (4 + (r - g) / (greatest(b, g, r) - least(b, g, r))) / 6 END)"""
_curve("hue", lambda: colour.hue(*_bgr()), _HUE)
_BANDS = ", ".join(f"({k}, '{n}', {c}.0)" for k, (n, c) in enumerate(colour.HUE_BANDS.items()))


@query(
    "hue_band_pixels",
    f"""WITH {BGR}, hu AS (SELECT series_id, seq, p, greatest(b, g, r) - least(b, g, r) AS span, {_HUE} * 360 AS h FROM ch),
 nb AS (SELECT series_id, band, span FROM hu, (VALUES {_BANDS}) t(o, band, c) QUALIFY row_number() OVER (PARTITION BY series_id, seq, p ORDER BY round(least(abs(h - c), 360 - abs(h - c)), 9), o) = 1)
 SELECT series_id, band, count(*) AS pixels, round(avg(span), 6) + 0.0 AS chroma FROM nb WHERE span > 0 GROUP BY ALL""",
)
def hue_band_pixels(spark, d):
    """Pixels and mean chroma of each of the eight hue bands, per series; grey pixels have no band."""
    c = tables.colours(spark, d)
    span = F.greatest("b", "g", "r") - F.least("b", "g", "r")
    out = c.select("series_id", span.alias("span"), colour.hue_band(colour.hue(*_bgr())).alias("band")).filter("span > 0")
    return rounded(out.groupBy("series_id", "band").agg(F.count(F.lit(1)).alias("pixels"), F.avg("span").alias("chroma")), "chroma")


_curve("mask_hue", lambda: colour.parametric_mask(*_bgr(), "hue", 0.9, 0.1, 0.1), _unit("1 - " + _smooth("0.1", "0.2", f"least(abs({_HUE} - 0.0), 1 - abs({_HUE} - 0.0))")))
_curve("mask_gradient", lambda: colour.gradient_mask(F.col("p") % 7, F.floor(F.col("p") / 7), 3, 7, 3.0, 1.0, 30.0, 0.5), _smooth(repr(-0.25 * math.hypot(3, 7)), repr(0.25 * math.hypot(3, 7)), "(p % 7 - 3) * cos(radians(30)) + (p // 7 - 1) * sin(radians(30))"))
_curve("mask_radial", lambda: colour.radial_mask(F.col("p") % 7, F.floor(F.col("p") / 7), 3.0, 1.0, 3.0, 1.5, 0.4), "1 - " + _smooth("0.6", "1.0", "sqrt(pow((p % 7 - 3) / 3.0, 2) + pow((p // 7 - 1) / 1.5, 2))"))
_curve("green_cast", lambda: colour.remove_green(*_bgr(), 0.8), "g * 0.2 + least(g, (b + r) * 0.5) * 0.8")
_LUT = curves.pchip([(0.0, 0.0), (0.3, 0.2), (0.7, 0.85), (1.0, 1.0)], 64)
_curve("tone_curve_lut", lambda: curves.lookup(F.array(*[F.lit(x) for x in _LUT]), F.col("g"), 64), f"[{', '.join(map(repr, _LUT))}][CAST(floor(g * 63) AS BIGINT) + 1]")


def _matrix_sql(m, names=("r", "g", "b")) -> list[str]:
    return [" + ".join(f"({m[i][k]!r}) * {names[k]}" for k in range(3)) for i in range(3)]


def _matrix_query(name: str, builder, m):
    sql = _matrix_sql(m)

    @query(name, f"WITH {BGR} SELECT {_out(sql[2], sql[1], sql[0])} FROM ch")
    def run(spark, d):
        df = tables.colours(spark, d)
        red, green, blue = builder([F.col("r"), F.col("g"), F.col("b")])
        return _channels(df, (blue, green, red))


CAMERA = [[1.2, -0.3, -0.1], [-0.2, 1.1, 0.1], [0.05, -0.2, 0.9]]
_matrix_query("xyz_to_rec2020", colour.xyz_to_working, colour.inverse(colour.RGB_TO_XYZ["rec2020"]))
_matrix_query("xyz_to_prophoto", lambda c: colour.xyz_to_working(c, "prophoto"), colour.multiply(colour.inverse(colour.RGB_TO_XYZ["prophoto"]), colour.D65_TO_D50))
_matrix_query("camera_to_rec2020", lambda c: colour.camera_to_working(c, CAMERA), colour.multiply(colour.inverse(colour.RGB_TO_XYZ["rec2020"]), colour.inverse(CAMERA)))
_matrix_query("rec2020_to_srgb", colour.working_to_srgb, colour.multiply(colour.inverse(colour.RGB_TO_XYZ["srgb"]), colour.RGB_TO_XYZ["rec2020"]))


@query(
    "filmic_tonemap",
    f"""WITH {BGR}, l AS (SELECT *, greatest(0.0722 * b * 4 + 0.7152 * g * 4 + 0.2126 * r * 4, 1e-8) AS l FROM ch),
 o AS (SELECT *, least(greatest(1.0 / (1.0 + exp(-{2.0 / (1 - 0.6 * 0.9)!r} * (log2(l / 0.18) / 3.0))), 0.0), 1.0) AS o FROM l), s AS (SELECT series_id, seq, p, b * 4 * (o / l) AS b, g * 4 * (o / l) AS g, r * 4 * (o / l) AS r FROM o),
 m AS (SELECT *, greatest(b, g, r) AS m FROM s) SELECT {_out(*[_unit(f"CASE WHEN m > 1 THEN {c} / m ELSE {c} END") for c in "bgr"])} FROM m""",
)
def filmic_tonemap(spark, d):
    return _channels(tables.colours(spark, d), curves.filmic_rgb(*[c * 4.0 for c in _bgr()]))


@query("saturation_boost", f"WITH {BGR}, l AS (SELECT *, (b + g + r) / 3 AS l FROM ch) SELECT {_out(*[_unit(f'l + ({c} - l) * 1.3') for c in 'bgr'])} FROM l")
def saturation_boost(spark, d):
    return _channels(tables.colours(spark, d), colour.saturate(list(_bgr()), 1.3))


LINES = f"""{BGR}, q AS (SELECT series_id, quantile_cont(r, 0.3) AS qr, quantile_cont(b, 0.3) AS qb FROM ch GROUP BY ALL),
 z AS (SELECT ch.*, greatest(r - qr, 0.0) AS h0, greatest(b - qb, 0.0) AS o0 FROM ch JOIN q USING (series_id)), y AS (SELECT *, greatest(h0 - 0.2 * o0, 0.0) AS h1, greatest(o0 - 0.2 * h0, 0.0) AS o1 FROM z),
 t AS (SELECT series_id, quantile_cont(h1, 0.999) AS th, quantile_cont(o1, 0.999) AS tq FROM y GROUP BY ALL),
 n AS (SELECT y.series_id, seq, p, {_unit("h1 / greatest(th, 1e-6)")} AS ha, {_unit("o1 / greatest(tq, 1e-6)")} AS oiii FROM y JOIN t USING (series_id))"""
_PRODUCT = "greatest(ha * oiii, 1e-6)"
_GREEN = {
    "hoo": "oiii",
    "sho": _unit("0.8 * ha + 0.2 * oiii"),
    "foraxx": _unit(f"pow({_PRODUCT}, 1 - {_PRODUCT}) * ha + (1 - pow({_PRODUCT}, 1 - {_PRODUCT})) * oiii"),
    "bicolor": "greatest(oiii, 0.5 * ha)",
}


def _palette(name: str):
    @query(f"palette_{name}", f"WITH {LINES} SELECT {_out('oiii', _GREEN[name], 'ha')} FROM n")
    def run(spark, d):
        return _channels(colour.two_lines(tables.colours(spark, d), ["series_id"]), colour.palette(name, F.col("ha"), F.col("oiii")))


for _name in _GREEN:
    _palette(_name)

LOW = "q AS (SELECT series_id, quantile_cont(b, {q}) AS qb, quantile_cont(g, {q}) AS qg, quantile_cont(r, {q}) AS qr FROM {t} GROUP BY ALL)"


@query(
    "color_balance",
    f"""WITH {BGR}, {LOW.format(q=0.3, t="ch")}, z AS (SELECT ch.series_id, seq, p, {", ".join(f"greatest({c} - (q{c} - least(qb, qg, qr) * 0.1), 0.0) AS {c}" for c in "bgr")} FROM ch JOIN q USING (series_id)),
 h AS (SELECT series_id, quantile_cont(b, 0.995) AS qb, quantile_cont(g, 0.995) AS qg, quantile_cont(r, 0.995) AS qr FROM z GROUP BY ALL),
 s AS (SELECT z.series_id, seq, p, {", ".join(f"{c} * least(greatest((qb + qg + qr) / 3 / greatest(q{c}, 1e-6), 0.4), 2.5) AS {c}" for c in "bgr")} FROM z JOIN h USING (series_id)) SELECT {_out("b", "g", "r")} FROM s""",
)
def color_balance(spark, d):
    return _channels(colour.color_balance(tables.colours(spark, d), ["series_id"]), _bgr())


@query(
    "neutralize_background",
    f"""WITH {BGR}, {LOW.format(q=0.25, t="ch")}, s AS (SELECT ch.series_id, seq, p, {", ".join(f"greatest({c} - (q{c} - least(qb, qg, qr)), 0.0) AS {c}" for c in "bgr")} FROM ch JOIN q USING (series_id)) SELECT {_out("b", "g", "r")} FROM s""",
)
def neutralize_background(spark, d):
    return _channels(colour.neutralize(tables.colours(spark, d), ["series_id"]), _bgr())


_GAIN = "(1 + 0.6 * (least(greatest(CASE WHEN n > 50 THEN sqrt((mb + mg + mr) / 3 / m{c} * ((hb + hg + hr) / 3 / h{c})) ELSE (mb + mg + mr) / 3 / m{c} END, 0.7), 1.4) - 1))"


@query(
    "auto_white_balance",
    f"""WITH {BGR}, l AS (SELECT *, 0.114 * b + 0.587 * g + 0.299 * r AS l FROM ch), m AS (SELECT series_id, quantile_cont(l, 0.95) AS c, {", ".join(f"avg({c}) + 1e-6 AS m{c}" for c in "bgr")} FROM l GROUP BY ALL),
 h AS (SELECT l.series_id, count(*) AS n, {", ".join(f"avg({c}) + 1e-6 AS h{c}" for c in "bgr")} FROM l JOIN m USING (series_id) WHERE l >= c GROUP BY ALL)
 SELECT {_out(*[_unit(f"{c} * {_GAIN.format(c=c)}") for c in "bgr"])} FROM l JOIN m USING (series_id) JOIN h USING (series_id)""",
)
def auto_white_balance(spark, d):
    return _channels(colour.white_balance(tables.colours(spark, d), ["series_id"]), _bgr())


GRAY = f"{BGR}, gr AS (SELECT *, (b + g + r) / 3 AS v FROM ch), me AS (SELECT series_id, median(v) AS med FROM gr GROUP BY ALL), ma AS (SELECT gr.series_id, median(abs(v - med)) * 1.4826 AS mad FROM gr JOIN me USING (series_id) GROUP BY ALL)"


def _gray_stats(spark, d):
    g = tables.colours(spark, d).select(*KEYS, colour.gray(*_bgr()).alias("v"))
    g = g.join(g.groupBy("series_id").agg(F.median("v").alias("med")), "series_id")
    return g.join(g.groupBy("series_id").agg((F.median(F.abs(F.col("v") - F.col("med"))) * 1.4826).alias("mad")), "series_id")


@query(
    "mtf_stretch",
    f"""WITH {GRAY}, c AS (SELECT gr.series_id, seq, p, v, med, least(greatest(med - 2.8 * (mad + 1e-6), 0.0), 0.99) AS c0 FROM gr JOIN me USING (series_id) JOIN ma USING (series_id)),
 x AS (SELECT *, {_unit("(v - c0) / greatest(1e-6, 1 - c0)")} AS x, least(greatest((med - c0) / greatest(1e-6, 1 - c0), 1e-4), 0.9999) AS mn FROM c),
 k AS (SELECT *, least(greatest(mn * (0.25 - 1) / (0.5 * mn - 0.25 - mn), 1e-3), 0.999) AS m FROM x)
 SELECT series_id, seq, p, round({_unit("CASE WHEN abs((2 * m - 1) * x - m) < 1e-9 THEN x ELSE (m - 1) * x / ((2 * m - 1) * x - m) END")}, 6) + 0.0 AS value FROM k""",
)
def mtf_stretch(spark, d):
    g = _gray_stats(spark, d).withColumn("c0", curves.clip(F.col("med") - 2.8 * (F.col("mad") + 1e-6), 0.0, 0.99))
    room = F.greatest(F.lit(1e-6), 1.0 - F.col("c0"))
    m = curves.midtones_for(curves.clip((F.col("med") - F.col("c0")) / room, 1e-4, 0.9999))
    return rounded(g.select(*KEYS, curves.midtones(curves.clip((F.col("v") - F.col("c0")) / room), m).alias("value")), "value")


_ASINH6 = math.asinh(6.0)


@query(
    "asinh_stretch",
    f"""WITH {GRAY}, s AS (SELECT gr.series_id, seq, p, greatest(v - (med + 0.25 * mad), 0.0) AS x FROM gr JOIN me USING (series_id) JOIN ma USING (series_id)), a AS (SELECT series_id, quantile_cont(x, 0.75) + 1e-9 AS a FROM s GROUP BY ALL)
 SELECT s.series_id, seq, p, round({_unit(f"asinh(x / (a * 6.0 / {math.sinh(0.12 * _ASINH6)!r} + 1e-6) * 6.0) / {_ASINH6!r}")}, 6) + 0.0 AS value FROM s JOIN a USING (series_id)""",
)
def asinh_stretch(spark, d):
    s = _gray_stats(spark, d).withColumn("x", F.greatest(F.col("v") - (F.col("med") + 0.25 * F.col("mad")), F.lit(0.0)))
    a = s.groupBy("series_id").agg(F.expr("percentile(x, 0.75D)").alias("a"))
    return rounded(s.join(a, "series_id").select(*KEYS, curves.asinh_stretch(F.col("x") / curves.asinh_norm(F.col("a"))).alias("value")), "value")


def ghs_table(samples: int = 512, intensity: float = 2.5, shape: float = -0.5, pivot: float = 0.18) -> list[float]:
    """Running sum of an everywhere positive stretch, from 0 to 1."""
    steps = [(1.0 + intensity**2 * (i / (samples - 1) - pivot) ** 2) ** shape for i in range(samples)]
    out, total = [], 0.0
    for s in steps:
        total += s
        out.append(total - steps[0])
    return [x / (out[-1] + 1e-12) for x in out]


_GHS = ghs_table(128)


@query(
    "ghs_curve",
    f"""WITH {BGR}, w AS (SELECT i, pow(1 + 6.25 * pow(i / 127.0 - 0.18, 2), -0.5) AS s FROM range(0, 128) t(i)), c AS (SELECT i, sum(s) OVER (ORDER BY i) - first_value(s) OVER (ORDER BY i) AS c FROM w),
 f AS (SELECT CAST(i AS BIGINT) AS i, c / ((SELECT max(c) FROM c) + 1e-12) AS f FROM c), k AS (SELECT series_id, seq, p, g * 127 - floor(g * 127) AS u, CAST(floor(g * 127) AS BIGINT) AS i FROM ch)
 SELECT series_id, seq, p, round(a.f + u * (coalesce(z.f, a.f) - a.f), 6) + 0.0 AS value FROM k JOIN f a ON a.i = k.i LEFT JOIN f z ON z.i = k.i + 1""",
)
def ghs_curve(spark, d):
    lut = F.array(*[F.lit(x) for x in [*_GHS, _GHS[-1]]])
    at = F.col("g") * 127
    low, high = F.element_at(lut, F.floor(at).cast("int") + 1), F.element_at(lut, F.floor(at).cast("int") + 2)
    return rounded(tables.colours(spark, d).select(*KEYS, (low + (at - F.floor(at)) * (high - low)).alias("value")), "value")


# --- optics and metadata ------------------------------------------------------------------------


@query(
    "dof_calc",
    """WITH o AS (SELECT p_partkey AS id, 1.4 + p_size % 10 AS n, 20.0 + p_size * 3 AS f, p_retailprice / 500.0 AS dist FROM part), s AS (SELECT *, dist * 1000 AS s, f * f / (n * 0.029) + f AS h FROM o)
 SELECT id, CASE WHEN s <= f THEN NULL WHEN h > s THEN round(s * (h - f) / (h - s) - s * (h - f) / (h + s - 2 * f), 4) ELSE CAST('inf' AS DOUBLE) END AS dof_mm FROM s""",
)
def dof_calc(spark, d):
    o = tables.table(spark, d, "part").selectExpr("p_partkey id", "1.4D + p_size % 10 n", "20.0D + p_size * 3 f", "p_retailprice / 500.0D dist")
    return o.select("id", F.round(curves.depth_of_field(F.col("n"), F.col("f"), F.col("dist")), 4).alias("dof_mm"))


@query("macro_dof", "SELECT p_partkey AS id, round(2 * (1.4 + p_size % 10) * 0.019 * (1 + p_size / 10.0) / pow(p_size / 10.0, 2), 6) AS dof_mm FROM part WHERE p_size > 0")
def macro_dof(spark, d):
    o = tables.table(spark, d, "part").filter("p_size > 0")
    return o.select(F.col("p_partkey").alias("id"), F.round(curves.macro_depth(1.4 + F.col("p_size") % 10, F.col("p_size") / 10.0, curves.CIRCLES["apsc"]), 6).alias("dof_mm"))


@query("frames_for_depth", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 1 ELSE CAST(ceil(p_retailprice / (p_size % 5)) AS BIGINT) + 1 END AS frames FROM part")
def frames_for_depth(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), curves.frames_for_depth(F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")).alias("frames"))


@query("sensor_from", "SELECT p_partkey AS id, CASE WHEN c >= 1.2 AND c < 1.8 THEN 'apsc' WHEN c >= 1.8 AND c < 2.3 THEN 'mft' ELSE 'fullframe' END AS sensor FROM (SELECT p_partkey, (30 + p_size) / 30.0 AS c FROM part)")
def sensor_from(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), curves.sensor_from(F.lit(30.0), 30.0 + F.col("p_size")).alias("sensor"))


@query(
    "radial_distortion",
    f"""WITH {PX}, r AS (SELECT series_id, seq, y, x, (x - 3.5) / 4 AS dx, (y - 3.5) / 4 AS dy FROM px), s AS (SELECT *, sqrt(dx * dx + dy * dy) + 1e-12 AS q FROM r), k AS (SELECT *, 0.01 * q * q * q - 0.03 * q * q + 0.02 * q + 1.0 AS f FROM s)
 SELECT series_id, seq, y, x, round(3.5 + dx * f * 4, 6) AS sx, round(3.5 + dy * f * 4, 6) AS sy FROM k""",
)
def radial_distortion(spark, d):
    sx, sy = curves.radial_distortion(F.col("x"), F.col("y"), 3.5, 3.5, 4.0, 0.01, -0.03, 0.02)
    return rounded(tables.pixels(spark, d).select("series_id", "seq", "y", "x", sx.alias("sx"), sy.alias("sy")), "sx", "sy")


@query(
    "affine_compose",
    "WITH m AS (SELECT o_orderkey AS id, o_totalprice / 1e5 AS s, o_custkey % 7 AS t FROM orders) SELECT id, round(s * 2 + t * 0.5 + 1e-8, 6) AS a, round(s * 3 - t + 1e-8, 6) AS b, round(s * 5 + t * 1.5 + t + 1e-8, 6) AS c FROM m",
)
def affine_compose(spark, d):
    m = tables.table(spark, d, "orders").selectExpr("o_orderkey id", "o_totalprice / 1e5D s", "CAST(o_custkey % 7 AS DOUBLE) t")
    left = [F.col("s"), F.col("t"), F.col("t"), -F.col("t"), F.col("s"), F.lit(0.0)]
    out = curves.compose_affine(left, [F.lit(x) for x in (2.0, 3.0, 5.0, 0.5, -1.0, 1.5)])
    return rounded(m.select("id", *[(c + 1e-8).alias(n) for c, n in zip(out, "abc")]), "a", "b", "c")


_SUFFIX = "lower(regexp_extract(path, '\\.[^./]+$'))"


@query(
    "file_kinds",
    f"""WITH f AS (SELECT p_partkey AS id, 'series/' || p_partkey || ['.ARW', '.jpg', '.fits', '.MP4', '.txt'][p_partkey % 5 + 1] AS path FROM part)
 SELECT id, CASE WHEN {_SUFFIX} IN ({", ".join(map(repr, meta.RAW_SUFFIXES))}) THEN 'raw' WHEN {_SUFFIX} IN ({", ".join(map(repr, meta.IMAGE_SUFFIXES))}) THEN 'image'
 WHEN {_SUFFIX} IN ({", ".join(map(repr, meta.FITS_SUFFIXES))}) THEN 'fits' WHEN {_SUFFIX} IN ({", ".join(map(repr, meta.VIDEO_SUFFIXES))}) THEN 'video' ELSE 'other' END AS kind FROM f""",
)
def file_kinds(spark, d):
    path = "concat('series/', p_partkey, element_at(array('.ARW', '.jpg', '.fits', '.MP4', '.txt'), CAST(p_partkey % 5 + 1 AS INT)))"
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), meta.kind(F.expr(path)).alias("kind"))


@query(
    "metadata_number",
    "WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size || '/10' WHEN 1 THEN 'f ' || p_size || '.5 mm' ELSE 'none' END AS t FROM part) SELECT id, round(CASE WHEN contains(t, '/') THEN CAST(split_part(t, '/', 1) AS DOUBLE) / 10 WHEN contains(t, 'mm') THEN CAST(regexp_extract(t, '[0-9.]+') AS DOUBLE) END, 6) AS value FROM t",
)
def metadata_number(spark, d):
    t = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '/10') WHEN 1 THEN concat('f ', p_size, '.5 mm') ELSE 'none' END")
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(meta.number(t), 6).alias("value"))


@query("event_properties", "SELECT event_type, round(avg(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY ALL")
def event_properties(spark, d):
    e = tables.table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return e.groupBy("event_type").agg(F.round(F.avg(F.col("k").try_cast("double")), 6).alias("mean_k"), F.count("k").alias("n"))


@query(
    "exposure_times",
    "SELECT user_id AS series_id, CASE WHEN count(value) = count(*) AND min(value) > 0.02 THEN round(median(value), 6) END AS exposure FROM events GROUP BY ALL",
)
def exposure_times(spark, d):
    e = tables.scores(spark, d)
    known = (F.count("v") == F.count(F.lit(1))) & (F.min("v") > 0.02)
    return e.groupBy("series_id").agg(F.when(known, F.round(F.median("v"), 6)).alias("exposure"))


@query(
    "module_guess",
    """WITH u AS (SELECT user_id AS series_id, median(value) / 10 AS expo, max(event_id) % 4000 AS iso, bool_or(event_type = 'error') AS fits FROM events GROUP BY ALL)
 SELECT series_id, CASE WHEN fits AND series_id % 3 = 0 THEN 'astro' WHEN expo >= 1 AND iso >= 1600 THEN 'astro' WHEN expo >= 1.5 THEN 'longexp' ELSE 'macro' END AS module FROM u""",
)
def module_guess(spark, d):
    u = tables.scores(spark, d).groupBy("series_id").agg((F.median("v") / 10).alias("expo"), (F.max("seq") % 4000).alias("iso"), F.bool_or(F.col("event_type") == "error").alias("fits"))
    return u.select("series_id", meta.module_of(F.col("fits") & (F.col("series_id") % 3 == 0), F.lit(False), F.col("expo"), F.col("iso").cast("double")).alias("module"))


@query("sky_names", f"SELECT p_partkey AS id, {' OR '.join(f'''contains(lower(n), '{x}')''' for x in meta.SKY_NAMES)} AS sky FROM (SELECT p_partkey, ['Light_001', 'img_flat', 'DARK_2', 'm31_sub', 'photo'][p_partkey % 5 + 1] AS n FROM part)")
def sky_names(spark, d):
    n = F.expr("element_at(array('Light_001', 'img_flat', 'DARK_2', 'm31_sub', 'photo'), CAST(p_partkey % 5 + 1 AS INT))")
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), meta.has_sky_name(n).alias("sky"))


@query("narrow_band_filter", f"SELECT p_partkey AS id, {' OR '.join(f'''contains(lower(n), '{x}')''' for x in meta.NARROW_BANDS)} AS narrow FROM (SELECT p_partkey, ['L-eXtreme', 'UV/IR', 'Ha+OIII', 'clear'][p_partkey % 4 + 1] AS n FROM part)")
def narrow_band_filter(spark, d):
    n = F.expr("element_at(array('L-eXtreme', 'UV/IR', 'Ha+OIII', 'clear'), CAST(p_partkey % 4 + 1 AS INT))")
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), meta.is_narrow_band(n).alias("narrow"))


@query(
    "version_newer",
    "WITH v AS (SELECT p_partkey AS id, p_partkey % 4 AS a, p_size % 12 AS b, p_partkey % 3 AS c FROM part) SELECT id, (a, b, c) > (1, 9, 2) AS newer FROM v",
)
def version_newer(spark, d):
    v = F.expr("concat('v', p_partkey % 4, '.', p_size % 12, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', p_partkey % 3) END)")
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (meta.version_key(v) > meta.version_key(F.lit("1.9.2"))).alias("newer"))


@query("structure_floor", "SELECT user_id AS series_id, round(least(greatest(median(value) * 0.05 * 100, 8.0), 40.0), 6) AS floor FROM events GROUP BY ALL")
def structure_floor(spark, d):
    return tables.scores(spark, d).groupBy("series_id").agg(F.round(meta.least_structure(F.median("v") * 100), 6).alias("floor"))


@query("translate_labels", "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'Klick' WHEN 'view' THEN 'Ansicht' ELSE event_type END AS label FROM events")
def translate_labels(spark, d):
    return tables.table(spark, d, "events").select(F.col("event_id").alias("id"), meta.translate(F.col("event_type"), {"click": "Klick", "view": "Ansicht"}).alias("label"))


@query("folder_signature", "SELECT p_brand AS folder, md5(string_agg(p_partkey || ':' || p_size, ',' ORDER BY p_partkey)) AS signature FROM part GROUP BY ALL")
def folder_signature(spark, d):
    rows = tables.table(spark, d, "part").groupBy(F.col("p_brand").alias("folder")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("f"))
    return rows.select("folder", F.md5(F.array_join(F.transform("f", lambda x: F.concat(x["p_partkey"].cast("string"), F.lit(":"), x["p_size"].cast("string"))), ",")).alias("signature"))


@query("newest_sibling", "SELECT o_custkey AS folder, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY ALL")
def newest_sibling(spark, d):
    return tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("folder")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("subs_report", "SELECT l_suppkey AS series_id, count(*) || ' frames, ' || sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) || ' dropped' AS report FROM lineitem GROUP BY ALL")
def subs_report(spark, d):
    g = tables.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("series_id")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("d"))
    return g.select("series_id", F.format_string("%d frames, %d dropped", "n", "d").alias("report"))


@query("cache_keys", "SELECT o_orderkey AS id, md5('orders/' || o_orderkey || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS key FROM orders")
def cache_keys(spark, d):
    o = tables.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), meta.cache_key(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("key"))

