"""SQL of the queries that run NumPy kernels, over the 8x8 frames of ``embeddings``.

A linear filter along an axis is a table of weights (i, j, w): output i takes w of
input j.  Mirrored edges, halving and doubling are such tables as well, so a filter
of an image is two joins.  The SQL is written from the definitions, not from the kernels.
"""

from __future__ import annotations

from collections.abc import Iterable

from .frames import PX

IMAGE = "series_id, seq"
UNIT = f"{PX}, u AS MATERIALIZED (SELECT series_id, seq, y, x, (v + 1) / 2 AS v FROM px)"
#: B3 spline taps.
SPLINE = [(-2, "1.0/16"), (-1, "4.0/16"), (0, "6.0/16"), (1, "4.0/16"), (2, "1.0/16")]


def taps(pairs: Iterable[tuple[int, str]]) -> str:
    return "(VALUES " + ", ".join(f"({d}, CAST({w} AS DOUBLE))" for d, w in pairs) + ") t(d, w)"


def gauss(sigma: float, reach: int) -> str:
    bell = f"exp(-0.5 * pow(d / CAST({sigma} AS DOUBLE), 2))"
    return f"(SELECT d, {bell} / sum({bell}) OVER () AS w FROM range(-{reach}, {reach} + 1) r(d)) t"


def box(radius: int) -> str:
    return taps((d, f"1.0/{2 * radius + 1}") for d in range(-radius, radius + 1))


def mirror(at: str, n: int) -> str:
    return f"CASE WHEN abs({at}) < {n} THEN abs({at}) ELSE greatest({2 * (n - 1)} - abs({at}), 0) END"


def weights(name: str, taps: str, n: int = 8, step: int = 1) -> str:
    return f"{name} AS MATERIALIZED (SELECT i, {mirror(f'i + {step} * d', n)} AS j, sum(w) AS w FROM range({n}) r(i), {taps} GROUP BY ALL)"


def halving(name: str, n: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT i, {mirror('2 * i + d', n)} AS j, sum(w) AS w FROM range({n // 2}) r(i), {taps(SPLINE)} GROUP BY ALL)"


def doubling(name: str, n: int) -> str:
    """To n cells: every other one holds an input, the rest nothing; then a filter of twice the weight."""
    return f"{name} AS MATERIALIZED (SELECT i, j // 2 AS j, sum(2 * w) AS w FROM (SELECT i, {mirror('i + d', n)} AS j, w FROM range({n}) r(i), {taps(SPLINE)}) WHERE j % 2 = 0 GROUP BY ALL)"


def apply(name: str, source: str, weights: str) -> str:
    return f"""{name}_y AS MATERIALIZED (SELECT {IMAGE}, k.i AS y, x, sum(k.w * v) AS v FROM {source} JOIN {weights} k ON y = k.j GROUP BY ALL),
 {name} AS MATERIALIZED (SELECT {IMAGE}, y, k.i AS x, sum(k.w * v) AS v FROM {name}_y JOIN {weights} k ON x = k.j GROUP BY ALL)"""


def along(name: str, source: str, weights: str, axis: str) -> str:
    place = "k.i AS y, x" if axis == "y" else "y, k.i AS x"
    return f"{name} AS MATERIALIZED (SELECT {IMAGE}, {place}, sum(k.w * v) AS v FROM {source} JOIN {weights} k ON {axis} = k.j GROUP BY ALL)"


def pixelwise(name: str, expression: str, a: str, b: str | None = None, c: str | None = None) -> str:
    """A pixel-wise expression of images a, b, c (their values as a.v, b.v, c.v)."""
    joins = "".join(f" JOIN {t} {k} USING (series_id, seq, y, x)" for k, t in (("b", b), ("c", c)) if t)
    return f"{name} AS MATERIALIZED (SELECT series_id, seq, y, x, {expression} AS v FROM {a} a{joins})"


def statement(*ctes: str, last: str) -> str:
    return "WITH " + ",\n ".join(ctes) + "\n" + last


def _frames(source: str) -> str:
    return f"SELECT series_id, seq, y, x, round(v, 6) + 0.0 AS value FROM {source}"


def _series(source: str) -> str:
    return f"SELECT series_id, y, x, round(v, 6) + 0.0 AS v FROM {source}"


def clip(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


def _sharpened(amount: float, sigma: float, reach: int) -> str:
    return statement(UNIT, weights("g", gauss(sigma, reach)), apply("s", "u", "g"), pixelwise("o", clip(f"a.v + {amount} * (a.v - b.v)"), "u", "s"), last=_frames("o"))


def _atrous(levels: int) -> list[str]:
    """Bands w0, w1, ... and the rest r{levels}."""
    out, before = [], "u"
    for k in range(levels):
        out += [weights(f"f{k}", taps(SPLINE), step=2**k), apply(f"r{k + 1}", before, f"f{k}"), pixelwise(f"w{k}", "a.v - b.v", before, f"r{k + 1}")]
        before = f"r{k + 1}"
    return out


def _wavelet(gains: tuple[float, float, float], threshold: float) -> str:
    ctes, total = _atrous(3), "r3"
    for k, gain in enumerate(gains):
        ctes.append(f"d{k} AS (SELECT series_id, seq, {threshold} * stddev_pop(v) * pow(0.6, {k}) AS cut FROM w{k} GROUP BY ALL)")
        ctes.append(f"k{k} AS MATERIALIZED (SELECT series_id, seq, y, x, {gain} * sign(v) * greatest(abs(v) - cut, 0.0) AS v FROM w{k} JOIN d{k} USING (series_id, seq))")
        ctes.append(pixelwise(f"t{k}", "a.v + b.v", total, f"k{k}"))
        total = f"t{k}"
    return statement(UNIT, *ctes, pixelwise("o", clip("a.v"), total), last=_frames("o"))


def pyramid(source: str = "u") -> list[str]:
    """Two bands p0 (8x8), p1 (4x4) and the base h2 (2x2)."""
    out, before = [], source
    for k, n in enumerate((8, 4)):
        out += [halving(f"hv{n}", n), doubling(f"db{n}", n), apply(f"h{k + 1}", before, f"hv{n}"), apply(f"e{k}", f"h{k + 1}", f"db{n}"), pixelwise(f"p{k}", "a.v - b.v", before, f"e{k}")]
        before = f"h{k + 1}"
    return out


def _pyramid_merge() -> list[str]:
    """The merged image ``pm``, of frame 0."""
    out = pyramid()
    for k, n in enumerate((8, 4)):
        out += [weights(f"bx{n}", box(1), n), pixelwise(f"a{k}", "abs(a.v)", f"p{k}"), apply(f"n{k}", f"a{k}", f"bx{n}")]
        out.append(f"m{k} AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, arg_max(p.v, (n.v, -p.seq)) AS v FROM p{k} p JOIN n{k} n USING (series_id, seq, y, x) GROUP BY series_id, y, x)")
    out.append("m2 AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, avg(v) AS v FROM h2 GROUP BY series_id, y, x)")
    return out + collapse("pm")


def collapse(name: str) -> list[str]:
    """The image of the bands m0, m1 and the base m2."""
    return [apply("c2", "m2", "db4"), pixelwise("c1", "a.v + b.v", "m1", "c2"), apply("c0", "c1", "db8"), pixelwise(name, "a.v + b.v", "m0", "c0")]


def _envelope() -> str:
    second = weights("l2", taps([(-1, "1"), (0, "-2"), (1, "1")]))
    both = [along(f"l{a}", "u", "l2", a) for a in "yx"]
    return statement(
        UNIT, *_pyramid_merge(), second, *both, pixelwise("al", "abs(a.v + b.v)", "ly", "lx"), weights("g4", gauss(4.0, 12)), apply("sh", "al", "g4"),
        "tp AS (SELECT series_id, y, x, max(v) + 1e-6 AS t FROM sh GROUP BY ALL)",
        "wt AS (SELECT series_id, seq, y, x, u.v AS v, pow(sh.v / t, 8) AS w FROM u JOIN sh USING (series_id, seq, y, x) JOIN tp USING (series_id, y, x))",
        "ev AS MATERIALIZED (SELECT series_id, 0 AS seq, y, x, min(v) - 0.02 AS lo, max(v) + 0.02 AS hi, sum(w * v) / (sum(w) + 1e-6) AS depth FROM wt GROUP BY series_id, y, x)",
        f"kp AS MATERIALIZED (SELECT series_id, seq, y, x, {clip('v')} AS sharp, least(greatest({clip('v')}, lo), hi) AS v, depth FROM pm JOIN ev USING (series_id, seq, y, x))",
        f"ov AS MATERIALIZED (SELECT series_id, seq, y, x, {clip('abs(sharp - v) / (0.02 + 1e-6)')} AS v FROM kp)",
        weights("g2", gauss(2.0, 6)), apply("so", "ov", "g2"),
        last=f"SELECT series_id, y, x, round({clip('kp.v * (1 - so.v) + depth * so.v')}, 6) + 0.0 AS v FROM kp JOIN so USING (series_id, seq, y, x)",
    )


def _wavelet_merge() -> str:
    ctes = _atrous(2)
    around = "(SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx)) o"
    for k in range(2):
        ctes.append(f"i{k} AS MATERIALIZED (SELECT series_id, y, x, arg_max(seq, (abs(v), -seq)) AS seq FROM w{k} GROUP BY series_id, y, x)")
        ctes.append(f"z{k} AS MATERIALIZED (SELECT c.series_id, c.y, c.x, list_sort(list(i.seq))[5] AS seq FROM i{k} c, {around}, i{k} i WHERE i.series_id = c.series_id AND i.y = least(greatest(c.y + dy, 0), 7) AND i.x = least(greatest(c.x + dx, 0), 7) GROUP BY ALL)")
        ctes.append(f"q{k} AS (SELECT series_id, y, x, v FROM w{k} JOIN z{k} USING (series_id, seq, y, x))")
    ctes.append("o AS (SELECT series_id, y, x, sum(v) AS v FROM (SELECT * FROM q0 UNION ALL SELECT * FROM q1 UNION ALL SELECT series_id, y, x, avg(v) FROM r2 GROUP BY ALL) GROUP BY ALL)")
    return statement(UNIT, *ctes, last=_series("o"))


def _guided() -> str:
    ctes = [weights("b", box(2)), "mn AS (SELECT series_id, seq, avg(v) AS m FROM u GROUP BY ALL)", "k AS MATERIALIZED (SELECT series_id, seq, y, x, CASE WHEN v > m THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM u JOIN mn USING (series_id, seq))"]
    ctes += [apply("mg", "u", "b"), apply("mk", "k", "b"), pixelwise("uk", "a.v * b.v", "u", "k"), apply("muk", "uk", "b"), pixelwise("uu", "a.v * a.v", "u"), apply("muu", "uu", "b")]
    ctes += [pixelwise("cov", "a.v - b.v * c.v", "muk", "mg", "mk"), pixelwise("vr", "a.v - b.v * b.v", "muu", "mg"), pixelwise("a", "a.v / (b.v + 1e-3)", "cov", "vr"), pixelwise("off", "b.v - a.v * c.v", "a", "mk", "mg")]
    ctes += [apply("ma", "a", "b"), apply("mo", "off", "b"), pixelwise("o", "a.v * b.v + c.v", "ma", "u", "mo")]
    return statement(UNIT, *ctes, last=_frames("o"))


def _deconvolved(rounds: int = 8) -> str:
    ctes = [weights("g", gauss(0.8, 2)), pixelwise("x0", "greatest(a.v, 1e-6)", "u")]
    for k in range(rounds):
        ctes += [apply(f"b{k}", f"x{k}", "g"), pixelwise(f"q{k}", "a.v / greatest(b.v, 1e-6)", "x0", f"b{k}"), apply(f"c{k}", f"q{k}", "g"), pixelwise(f"x{k + 1}", "a.v * b.v", f"x{k}", f"c{k}")]
    return statement(UNIT, *ctes, pixelwise("o", clip("a.v"), f"x{rounds}"), last=_frames("o"))


BILATERAL = statement(
    UNIT,
    "o AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx))",
    """n AS (SELECT a.series_id, a.seq, a.y, a.x, b.v AS v, exp(-(dy * dy + dx * dx) / (2 * 1.5 * 1.5) - pow(b.v - a.v, 2) / (2 * 0.01)) AS w FROM u a, o, u b
  WHERE b.series_id = a.series_id AND b.seq = a.seq AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7))""",
    last="SELECT series_id, seq, y, x, round(sum(w * v) / sum(w), 6) + 0.0 AS value FROM n GROUP BY ALL",
)

AFFINE = statement(
    UNIT,
    "src AS (SELECT y, x, 0.9::DOUBLE * x + -0.1::DOUBLE * y + 0.5::DOUBLE AS sx, 0.1::DOUBLE * x + 0.9::DOUBLE * y + 0.2::DOUBLE AS sy FROM range(8) a(y), range(8) b(x))",
    "co AS (SELECT y, x, CAST(floor(sy) AS BIGINT) + dy AS ry, CAST(floor(sx) AS BIGINT) + dx AS rx, abs(1 - dy - (sy - floor(sy))) * abs(1 - dx - (sx - floor(sx))) AS w FROM src, range(2) a(dy), range(2) b(dx))",
    "f AS (SELECT DISTINCT series_id, seq FROM u)",
    last="SELECT f.series_id, f.seq, co.y, co.x, round(coalesce(sum(w * v), 0.0), 6) + 0.0 AS value FROM f CROSS JOIN co LEFT JOIN u ON u.series_id = f.series_id AND u.seq = f.seq AND u.y = ry AND u.x = rx GROUP BY ALL",
)

DRIZZLE = statement(
    UNIT,
    "s AS (SELECT *, (seq % 3 - 1) * 0.25 AS sy, (seq % 5 - 2) * 0.125 AS sx FROM u)",
    "d AS (SELECT series_id, gy AS y, gx AS x, v FROM s, range(16) a(gy), range(16) b(gx) WHERE abs((gy + 0.5) / 2 - 0.5 + sy - s.y) <= 0.35 AND abs((gx + 0.5) / 2 - 0.5 + sx - s.x) <= 0.35 AND v <> 0)",
    last="SELECT series_id, y, x, round(avg(v), 6) + 0.0 AS value FROM d GROUP BY ALL",
)

CROP = statement(
    PX,
    "ok AS (SELECT series_id, y, x FROM px GROUP BY ALL HAVING bool_and(v > -0.3))",
    "r AS (SELECT t, l, b, r FROM range(8) a(t), range(8) b(l), range(8) c(b), range(8) d(r) WHERE t <= b AND l <= r)",
    "fits AS (SELECT series_id, t, l, b - t + 1 AS h, r - l + 1 AS w, b, r FROM r JOIN ok ON y BETWEEN t AND b AND x BETWEEN l AND r GROUP BY ALL HAVING count(*) = (b - t + 1) * (r - l + 1))",
    "best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY h * w DESC, b, r, h DESC) = 1)",
    last="SELECT s.series_id, coalesce(t, 0) AS y, coalesce(l, 0) AS x, coalesce(h, 0) AS h, coalesce(w, 0) AS w FROM (SELECT DISTINCT series_id FROM px) s LEFT JOIN best USING (series_id)",
)

STARS = "WITH RECURSIVE " + statement(
    UNIT,
    "md AS (SELECT series_id, seq, median(v) AS m FROM u GROUP BY ALL)",
    "ma AS (SELECT series_id, seq, any_value(m) AS m, any_value(m) + 1.5 * greatest(median(abs(v - m)) * 1.4826, 1e-6) AS cut FROM u JOIN md USING (series_id, seq) GROUP BY ALL)",
    "b AS MATERIALIZED (SELECT series_id, seq, y, x, v - m AS w FROM u JOIN ma USING (series_id, seq) WHERE v > cut)",
    """g AS (SELECT series_id, seq, y, x, y * 8 + x AS root FROM b UNION SELECT b.series_id, b.seq, b.y, b.x, g.root FROM g JOIN b ON b.series_id = g.series_id AND b.seq = g.seq AND abs(b.y - g.y) <= 1 AND abs(b.x - g.x) <= 1)""",
    "l AS (SELECT series_id, seq, y, x, min(root) AS root FROM g GROUP BY ALL)",
    "s AS (SELECT series_id, seq, root, sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y, count(*) AS area FROM l JOIN b USING (series_id, seq, y, x) GROUP BY ALL)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY series_id, seq ORDER BY area DESC, x, y) - 1 AS id FROM s)",
    last="SELECT series_id, seq, id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, area FROM k WHERE id < 20",
).removeprefix("WITH ")

#: Cross-power spectrum of each frame with the first of its series, and the greatest value of its inverse transform.
SHIFT = statement(
    UNIT,
    "a AS (SELECT series_id, min(seq) AS ref FROM u GROUP BY ALL)",
    "w AS MATERIALIZED (SELECT i, j, cos(2 * pi() * i * j / 8) AS c, sin(2 * pi() * i * j / 8) AS s FROM range(8) a(i), range(8) b(j))",
    "ry AS MATERIALIZED (SELECT series_id, seq, w.i AS p, x, sum(v * c) AS re, -sum(v * s) AS im FROM u JOIN w ON y = w.j GROUP BY ALL)",
    "f AS MATERIALIZED (SELECT series_id, seq, p, w.i AS q, sum(re * c + im * s) AS re, sum(im * c - re * s) AS im FROM ry JOIN w ON x = w.j GROUP BY ALL)",
    "cr AS (SELECT m.series_id, m.seq, m.p, m.q, r.re * m.re + r.im * m.im AS re, r.im * m.re - r.re * m.im AS im FROM f m JOIN a USING (series_id) JOIN f r ON r.series_id = m.series_id AND r.seq = a.ref AND r.p = m.p AND r.q = m.q)",
    "n AS MATERIALIZED (SELECT series_id, seq, p, q, re / greatest(sqrt(re * re + im * im), 1e-12) AS re, im / greatest(sqrt(re * re + im * im), 1e-12) AS im FROM cr)",
    "iy AS MATERIALIZED (SELECT series_id, seq, w.i AS y, q, sum(re * c - im * s) AS re, sum(im * c + re * s) AS im FROM n JOIN w ON p = w.j GROUP BY ALL)",
    "o AS (SELECT series_id, seq, y, w.i AS x, sum(re * c - im * s) AS v FROM iy JOIN w ON q = w.j GROUP BY ALL)",
    "t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY series_id, seq ORDER BY v DESC, y, x) = 1)",
    last="SELECT series_id, seq, CASE WHEN y > 4 THEN y - 8 ELSE y END AS dy, CASE WHEN x > 4 THEN x - 8 ELSE x END AS dx FROM t",
)

SQL = {
    "unsharp_mask": _sharpened(0.6, 1.0, 3),
    "local_contrast": _sharpened(0.3, 3.0, 9),
    "gaussian_blur": statement(UNIT, weights("g", gauss(1.0, 3)), apply("o", "u", "g"), last=_frames("o")),
    "wavelet_sharpen": _wavelet((2.0, 1.6, 1.3), 0.0),
    "wavelet_denoise": _wavelet((1.0, 1.0, 1.0), 1.0),
    "bilateral_denoise": BILATERAL,
    "guided_refine": _guided(),
    "deconvolve": _deconvolved(),
    "pyramid_energy": statement(UNIT, *pyramid(), pixelwise("o", "abs(a.v)", "p0"), last=_frames("o")),
    "affine_resample": AFFINE,
    "pyramid_merge": statement(UNIT, *_pyramid_merge(), last=_series("pm")),
    "wavelet_merge": _wavelet_merge(),
    "envelope_merge": _envelope(),
    "tree_merge": statement(UNIT, last="SELECT series_id, y, x, round(max(v), 6) + 0.0 AS v FROM u GROUP BY ALL"),
    "drizzle_stack": DRIZZLE,
    "crop_to_overlap": CROP,
    "star_centroids": STARS,
    "global_shift": SHIFT,
}
