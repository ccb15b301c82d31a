"""Queries that develop colour frames, and their SQL."""

from __future__ import annotations

from ..operators import develop
from ..sources import tables
from . import kernel_sql as k
from .frames import FRAME, query, rounded
from .fusion import COLOUR

GRAY = "gr AS MATERIALIZED (SELECT series_id, seq, y, x, 0.114 * b + 0.587 * g + 0.299 * r AS v FROM cf)"
#: A plane per channel, numbered 3 * seq + channel.
PLANES = "pl AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT series_id, seq * 3 + {c} AS seq, y, x, {n} AS v FROM cf" for c, n in enumerate("bgr")) + ")"
ON = "USING (series_id, seq, y, x)"


def _lowest(name: str, source: str, radius: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.series_id, a.seq, a.y, a.x, min(b.v) AS v FROM {source} a JOIN {source} b ON a.series_id = b.series_id AND a.seq = b.seq AND abs(a.y - b.y) <= {radius} AND abs(a.x - b.x) <= {radius} GROUP BY ALL)"


def _out(*channels: str) -> str:
    return "series_id, seq, y, x, " + ", ".join(f"round({k.clip(e)}, 6) + 0.0 AS {n}" for e, n in zip(channels, "bgr"))


def _developed(name: str, sql: str, kernel, stacked: bool = False):
    @query(name, sql)
    def run(spark, d):
        return rounded(develop.colour_map(tables.colour_frames(spark, d), FRAME, kernel, stacked), "b", "g", "r")


_developed(
    "highlight_reconstruct",
    k.statement(
        COLOUR, PLANES, k.weights("g", k.gauss(1.5, 4)),
        "ok AS MATERIALIZED (SELECT series_id, seq, y, x, CASE WHEN v < 0.6 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM pl)", k.pixelwise("vk", "a.v * b.v", "pl", "ok"), k.apply("nu", "vk", "g"), k.apply("de", "ok", "g"),
        k.pixelwise("nr", "a.v / (b.v + 1e-6)", "nu", "de"), k.pixelwise("fi", "CASE WHEN c.v > 0 THEN a.v ELSE greatest(a.v, b.v) END", "pl", "nr", "ok"),
        "w AS (SELECT series_id, seq // 3 AS seq, y, x, max(CASE WHEN seq % 3 = 0 THEN fi.v END) AS b, max(CASE WHEN seq % 3 = 1 THEN fi.v END) AS g, max(CASE WHEN seq % 3 = 2 THEN fi.v END) AS r, 0.92 * max(fi.v) AS t, min(ok.v) = 0 AS burnt FROM fi JOIN ok USING (series_id, seq, y, x) GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"),
        last="SELECT " + _out(*[f"CASE WHEN burnt THEN greatest({c}, t) ELSE {c} END" for c in "bgr"]) + " FROM w",
    ),
    lambda f: develop.rebuild_highlights(f, 0.6, 1.5),
)

_developed(
    "dehaze",
    k.statement(
        COLOUR, GRAY, "mi AS MATERIALIZED (SELECT series_id, seq, y, x, least(b, g, r) AS v FROM cf)", _lowest("dk", "mi", 1),
        "ai AS MATERIALIZED (SELECT series_id, seq, least(greatest(b, 1e-3), 1) AS ab, least(greatest(g, 1e-3), 1) AS ag, least(greatest(r, 1e-3), 1) AS ar FROM dk JOIN gr USING (series_id, seq, y, x) JOIN cf USING (series_id, seq, y, x) QUALIFY row_number() OVER (PARTITION BY series_id, seq ORDER BY dk.v DESC, gr.v DESC, y, x) = 1)",
        "rt AS MATERIALIZED (SELECT series_id, seq, y, x, least(b / ab, g / ag, r / ar) AS v FROM cf JOIN ai USING (series_id, seq))", _lowest("rl", "rt", 1), k.pixelwise("tr", "1 - 0.9 * a.v", "rl"),
        k.weights("g2", k.gauss(1.0, 3)), k.apply("so", "tr", "g2"),
        "o AS (SELECT cf.*, ab, ag, ar, least(greatest(so.v, 0.1), 1) AS t FROM cf JOIN ai USING (series_id, seq) JOIN so USING (series_id, seq, y, x))",
        last="SELECT " + _out(*[f"{c} + 0.8 * ({k.clip(f'({c} - a{c}) / t + a{c}')} - {c})" for c in "bgr"]) + " FROM o",
    ),
    lambda f: develop.dehaze(f, 0.8, 0.9, 1, 1.0),
)

_developed(
    "tonemap_local",
    k.statement(
        COLOUR, "lg AS MATERIALIZED (SELECT series_id, seq, y, x, log10(greatest(0.114 * b + 0.587 * g + 0.299 * r, 1e-6)) AS v FROM cf)",
        "sp AS (SELECT series_id, seq, greatest(0.1, 0.4 * (max(v) - min(v) + 1e-6)) AS tone FROM lg GROUP BY ALL)",
        """ba AS MATERIALIZED (SELECT series_id, seq, y, x, l, sum(w * n) / sum(w) AS v FROM (SELECT a.series_id, a.seq, a.y, a.x, a.v AS l, c.v AS n, exp(-(dy * dy + dx * dx) / (2 * 4.0 * 4.0) - pow(c.v - a.v, 2) / (2 * tone * tone)) AS w
  FROM lg a JOIN sp ON sp.series_id = a.series_id AND sp.seq = a.seq, range(-3, 4) p(dy), range(-3, 4) q(dx), lg c WHERE c.series_id = a.series_id AND c.seq = a.seq AND c.y = least(greatest(a.y + dy, 0), 7) AND c.x = least(greatest(a.x + dx, 0), 7)) GROUP BY ALL)""",
        "st AS (SELECT series_id, seq, max(v) AS top, least(1, 0.05 / (max(v) - min(v) + 1e-6)) AS s FROM ba GROUP BY ALL)",
        "ra AS (SELECT series_id, seq, y, x, pow(10, (v - top) * s + l - v) / pow(10, l) AS f FROM ba JOIN st USING (series_id, seq))",
        "o1 AS MATERIALIZED (SELECT series_id, seq, y, x, b * f AS b, g * f AS g, r * f AS r FROM cf JOIN ra USING (series_id, seq, y, x))",
        "nm AS (SELECT series_id, seq, quantile_cont(v, 0.995) + 1e-6 AS n FROM (SELECT series_id, seq, unnest([b, g, r]) AS v FROM o1) GROUP BY ALL)",
        "o2 AS MATERIALIZED (SELECT series_id, seq, y, x, " + ", ".join(f"pow({k.clip(f'{c} / n')}, 1 / 2.2) AS {c}" for c in "bgr") + " FROM o1 JOIN nm USING (series_id, seq))",
        "ma AS (SELECT series_id, seq, median(0.114 * b + 0.587 * g + 0.299 * r) AS a FROM cf GROUP BY ALL)", "mb AS (SELECT series_id, seq, median(0.114 * b + 0.587 * g + 0.299 * r) AS m FROM o2 GROUP BY ALL)",
        last="SELECT " + _out(*[f"{c} * least(1, a / greatest(m, 1e-6))" for c in "bgr"]) + " FROM o2 JOIN ma USING (series_id, seq) JOIN mb USING (series_id, seq)",
    ),
    lambda f: develop.tonemap_local(f, 1.0, 0.05),
)


def _capture(rounds: int = 12) -> str:
    ctes = [COLOUR, GRAY, k.weights("g", k.gauss(0.7, 2)), k.pixelwise("x0", "greatest(a.v, 1e-4)", "gr")]
    for i in range(rounds):
        ctes += [k.apply(f"b{i}", f"x{i}", "g"), k.pixelwise(f"q{i}", "a.v / greatest(b.v, 1e-6)", "x0", f"b{i}"), k.apply(f"c{i}", f"q{i}", "g"), k.pixelwise(f"x{i + 1}", "a.v * b.v", f"x{i}", f"c{i}")]
    ctes += [k.pixelwise("ra", "least(greatest(a.v / b.v, 0.3), 3)", f"x{rounds}", "x0"), k.pixelwise("hi", k.clip("(a.v - 0.5) / 0.5"), "gr"), k.weights("g2", k.gauss(2.0, 6)), k.apply("ke", "hi", "g2"), k.pixelwise("f", "a.v * (1 - b.v) + b.v", "ra", "ke")]
    return k.statement(*ctes, last="SELECT " + _out(*[f"{c} * v" for c in "bgr"]) + f" FROM cf JOIN f {ON}")


_developed("capture_sharpen", _capture(), lambda f: develop.capture_sharpen(f, protect=0.5), stacked=True)
