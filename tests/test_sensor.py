"""Colour mosaics, trails, response curves and sub-pixel alignment, on frames whose truth is known."""

import math

import numpy as np
import pytest

from framelake.operators import kernels, radiance, refine, sensor, trails

ARRAYS = "series_id bigint, seq bigint, h int, w int, values array<double>, pattern_ string"


def scene(h, w, seed=1):
    """A smooth colour picture."""
    rng = np.random.default_rng(seed)
    f = np.stack([kernels.blur(rng.random((h, w)), 4.0) for _ in range(3)], axis=2)
    return (f - f.min()) / (f.max() - f.min()) * [0.9, 0.6, 0.75]


def mosaic(f, pattern):
    return np.where(sensor.sites(*f.shape[:2], pattern), f, 0).sum(axis=2)


@pytest.mark.parametrize("pattern", sensor.PATTERNS)
@pytest.mark.parametrize("shape", [(40, 60), (31, 47)])
def test_debayer_returns_the_colours(spark, pattern, shape):
    f = scene(*shape)
    raw = mosaic(f, pattern)
    out = sensor.debayer(raw, pattern)
    assert (out[sensor.sites(*shape, pattern)] == f[sensor.sites(*shape, pattern)]).all()
    assert np.abs(out - f)[1:-1, 1:-1].max() < 0.06 and np.abs(out - f).mean() < 0.01
    scores = {p: sensor.artefacts(raw, p) for p in sensor.PATTERNS}
    least = {p for p in scores if scores[p] <= min(scores.values()) * (1 + sensor.TIE)}
    assert least == ({"RGGB", "BGGR"} if pattern in ("RGGB", "BGGR") else {"GRBG", "GBRG"})


def test_patterns_per_series_and_from_headers(spark):
    rows = []
    for s, p in enumerate(sensor.PATTERNS):
        rows += [(s, k, 24, 36, mosaic(scene(24, 36, 10 * s + k), p).ravel().tolist(), None) for k in range(3)]
    rows += [(7, 0, 2, 2, [0.1, 0.2, 0.3, 0.4], " bggr "), (8, 0, 8, 8, [0.5] * 64, "XTRANS"), (9, 0, 8, 8, None, None), (None, 0, 1, 1, [0.5], None), (10, 0, 8, 8, [math.nan] * 64, "GRBG")]
    df = spark.createDataFrame(rows, ARRAYS)
    chosen = {r["series_id"]: r["pattern"] for r in sensor.pattern_scores(df, ["series_id"]).filter("chosen").collect()}
    assert [chosen[s] for s in range(4)] == ["RGGB", "RGGB", "GRBG", "GRBG"] and chosen[8] == chosen[9] == "RGGB"
    out = {(r["series_id"], r["seq"]): r for r in sensor.debayered(df, ["series_id"], "seq", "pattern_").collect()}
    assert out[7, 0]["pattern"] == "BGGR" and out[10, 0]["pattern"] == "GRBG" and out[9, 0]["values"] is None
    for s, p in enumerate(sensor.PATTERNS):
        f = scene(24, 36, 10 * s + 1)
        assert np.abs(np.array(out[s, 1]["values"]).reshape(24, 36, 3) - (f if p == chosen[s] else f[..., ::-1])).mean() < 0.02
    assert sensor.pattern_scores(df.limit(0), ["series_id"]).count() == 0


# --- trails --------------------------------------------------------------------------------------


def sky(h, w, seed, stars=40):
    rng = np.random.default_rng(seed)
    f = rng.normal(0.1, 0.01, (h, w))
    for _ in range(stars):
        y, x = rng.integers(2, h - 2), rng.integers(2, w - 2)
        f[y - 1 : y + 2, x - 1 : x + 2] += 0.5
    return f


def drawn(f, y0, x0, y1, x1):
    for t in np.linspace(0, 1, 4 * max(f.shape)):
        f[round(y0 + t * (y1 - y0)), round(x0 + t * (x1 - x0))] = 0.9
    return f


def test_trails_of_drawn_lines(spark):
    frames = [
        sky(120, 160, 1),
        drawn(sky(120, 160, 2), 10, 5, 110, 150),
        drawn(sky(120, 160, 3), 60, 20, 60, 95),
        drawn(sky(120, 160, 4), 5, 80, 90, 80),
        drawn(sky(120, 160, 5), 60, 20, 60, 40),  # too short
        np.full((120, 160), 0.3),
    ]
    frames.append(drawn(sky(120, 160, 6), 100, 10, 30, 120))
    frames[-1][::4] = 0.1  # a dashed line
    px = [(1, k, y, x, float(f[y, x])) for k, f in enumerate(frames) for y in range(120) for x in range(160)]
    df = spark.createDataFrame(px, "series_id bigint, seq bigint, y int, x int, v double")
    got = {r["seq"]: r["trail"] for r in trails.detect_trails(df, ["series_id", "seq"], least_votes=45).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert trails.detect_trails(df.limit(0), ["series_id", "seq"]).count() == 0


def test_lines_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    points = sorted({(int(y), int(x)) for y, x in rng.integers(0, 20, (60, 2))})
    got = {(r["angle"], r["rho"], r["votes"], round(r["length"], 6)) for r in trails.lines(spark.createDataFrame([(1, y, x) for y, x in points], "f int, y int, x int"), ["f"], 5, 6.0, 4.0).collect()}
    want = set()
    for a in range(180):
        t, of = math.radians(a), {}
        for y, x in points:
            of.setdefault(math.floor(x * math.cos(t) + y * math.sin(t) + 0.5 + 1e-9), []).append(y * math.cos(t) - x * math.sin(t))
        for rho, along in of.items():
            along.sort()
            if len(along) >= 5:
                pieces = [[along[0]]]
                for u, v in zip(along, along[1:]):
                    if v - u > 4.0:
                        pieces.append([])
                    pieces[-1].append(v)
                want |= {(a, rho, len(along), round(p[-1] - p[0], 6)) for p in pieces if p[-1] - p[0] >= 6.0 - 1e-9}
    assert got == want and want


# --- response ------------------------------------------------------------------------------------


def exposures(spark, curve, times=(0.25, 0.5, 1, 2, 4, 8), pixels=300, levels=64, copies=1):
    rng = np.random.default_rng(2)
    light = np.exp(rng.uniform(math.log(0.01), math.log(1.2), pixels))
    z = lambda e: int(min(levels - 1, max(0, math.floor(curve(min(1.0, e)) * (levels - 1) + 0.5))))
    rows = [(1, 0, i, z(e * t), float(t), "q") for i, e in enumerate(light) for t in times for _ in range(copies)]
    return spark.createDataFrame(rows, "series_id bigint, y int, x int, z int, t double, s string"), light


@pytest.mark.parametrize("gamma", [1.0, 2.2])
def test_known_curves_come_back(spark, gamma):
    px, light = exposures(spark, lambda e: e ** (1 / gamma))
    g = {r["z"]: r["g"] for r in radiance.response_curve(px, ["series_id"], ["y", "x"], 64, smooth=1.0).collect()}
    inner = range(8, 58)
    truth = {z: gamma * math.log(z / 63) for z in inner}
    shift = np.mean([g[z] - truth[z] for z in inner])
    assert max(abs(g[z] - truth[z] - shift) for z in inner) < 0.12
    curve = radiance.response_curve(px, ["series_id"], ["y", "x"], 64, smooth=1.0)
    value = {r["x"]: r["value"] for r in radiance.radiance(px, curve, ["series_id"], ["y", "x"], 64).collect()}
    ratio = np.log([value[i] / light[i] for i in range(len(light)) if light[i] < 0.5])
    assert np.abs(ratio - np.median(ratio)).max() < 0.15


@pytest.mark.parametrize("copies", [1, 3])
def test_curve_equals_the_full_system(spark, copies):
    """All unknowns at once, ln E of each pixel among them."""
    levels, smooth = 32, 4.0
    px, _ = exposures(spark, lambda e: e**0.5, pixels=40, levels=levels, copies=copies)
    rows = [(r["x"], r["z"], r["t"]) for r in px.collect()]
    w = lambda z: min(z, levels - 1 - z) + 1
    a, b = [], []
    for x, z, t in rows:
        line = np.zeros(levels + 40)
        line[z], line[levels + x] = w(z), -w(z)
        a.append(line)
        b.append(w(z) * math.log(t))
    for z in range(1, levels - 1):
        line = np.zeros(levels + 40)
        line[z - 1 : z + 2] = smooth * w(z) * np.array([1, -2, 1])
        a.append(line)
        b.append(0)
    line = np.zeros(levels + 40)
    line[levels // 2] = 1
    want = np.linalg.lstsq(np.array([*a, line]), np.array([*b, 0]), rcond=None)[0][:levels]
    got = [r["g"] for r in radiance.response_curve(px, ["series_id"], ["y", "x"], levels, smooth).orderBy("z").collect()]
    assert np.allclose(got, want, atol=1e-6)
    assert radiance.response_curve(px.limit(0), ["series_id"], ["y", "x"], levels).count() == 0


# --- intensity registration ------------------------------------------------------------------------


def sampled(dx, dy, turn, gain=1.0, size=64):
    """The same smooth scene, seen from a moved and turned frame."""
    rng = np.random.default_rng(5)
    waves = [(rng.uniform(0.03, 0.35), rng.uniform(0.03, 0.35), rng.uniform(0, 6)) for _ in range(25)]
    yy, xx = np.mgrid[0:size, 0:size].astype(float)
    c, s = math.cos(turn), math.sin(turn)
    u, v = c * xx - s * yy + dx, s * xx + c * yy + dy
    return gain * sum(np.sin(a * u + b * v + p) for a, b, p in waves) + (1 - gain)


@pytest.mark.parametrize("dx, dy, turn", [(0.4, -0.3, 0.0), (3.7, 2.2, 0.0), (0.0, 0.0, 0.02), (2.3, -1.6, 0.05), (-5.2, 4.4, -0.03)])
def test_ecc_finds_moves(dx, dy, turn):
    # ref(p) = scene(p); mov(q) = scene(T q): what ref shows at p is in mov at T^-1 p
    m, cc = refine.ecc(sampled(0, 0, 0), sampled(dx, dy, turn, gain=0.6))
    full = np.linalg.inv(np.vstack((m, [0, 0, 1])))
    assert cc > 0.99
    assert abs(math.degrees(math.atan2(full[1, 0], full[0, 0]) - turn)) < 0.1
    for p in ([20, 20, 1], [40, 30, 1]):
        want = np.array([math.cos(turn) * p[0] - math.sin(turn) * p[1] + dx, math.sin(turn) * p[0] + math.cos(turn) * p[1] + dy])
        assert np.abs((full @ p)[:2] - want).max() < 0.05


def test_ecc_other_motions_and_hopeless_pairs():
    m, cc = refine.ecc(sampled(0, 0, 0), sampled(1.3, -0.7, 0), motion="translation")
    assert np.abs(m[:, 2] + [1.3, -0.7]).max() < 0.05 and cc > 0.99
    m, cc = refine.ecc(sampled(0, 0, 0), sampled(1.3, -0.7, 0.03), motion="affine")
    assert cc > 0.99
    flat, start = np.zeros((40, 40)), np.array([[1, 0, 2.0], [0, 1, 3.0]])
    m, cc = refine.ecc(flat, flat, start)
    assert cc == 0 and (m == start).all()
    with pytest.raises(ValueError):
        refine.ecc(flat, flat, motion="flow")


def test_refine_and_align_pairs(spark):
    ref = sampled(0, 0, 0)
    rows = [(1, k, 64, 64, ref.ravel().tolist(), sampled(0.5 * k, -0.3 * k, 0.01 * k).ravel().tolist(), 3) for k in range(4)]
    rows += [(1, 8, 64, 64, ref.ravel().tolist(), None, 3), (1, 9, 64, 64, ref.ravel().tolist(), [0.0] * 4096, 3)]
    df = spark.createDataFrame(rows, "series_id bigint, seq bigint, h int, w int, ref array<double>, mov array<double>, cc_ int")
    got = {r["seq"]: r for r in refine.refine(df, ["series_id", "seq"]).collect()}
    assert got[8]["cc"] == got[9]["cc"] == 0 and got[8]["m"] == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    for k in range(4):
        assert abs(got[k]["m"][3] + math.sin(0.01 * k)) < 0.002
    laid = {r["seq"]: np.array(r["values"]).reshape(64, 64) for r in refine.align_pairs(df, ["seq"], least=0.5).collect()}
    assert sorted(laid) == [0, 1, 2, 3]
    for k in range(4):
        assert np.abs(laid[k] - ref)[8:-8, 8:-8].max() < 0.25 * np.abs(ref).max()
        assert np.abs(laid[k] - ref)[8:-8, 8:-8].mean() < 0.02 * np.ptp(ref)


def test_lines_store_no_votes(spark):
    """A line with a gap is two pieces, one with too few votes none; votes make no rows of the plan."""
    from framelake.operators import trails

    rows = [(1, 7, 3, x) for x in (*range(10), *range(20, 26))] + [(1, 8, y, y) for y in range(12)] + [(2, 7, 0, 0), (2, 7, 5, 9)]
    found = trails.lines(spark.createDataFrame(rows, "series_id bigint, seq bigint, y int, x int"), ["series_id", "seq"], 8, 4.0, 3.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    got = {tuple(r) for r in found.selectExpr("series_id", "seq", "angle", "rho", "votes", "round(length, 6)").collect()}
    assert {(1, 7, 90, 3, 16, 9.0), (1, 7, 90, 3, 16, 5.0)} <= got and (1, 8, 135, 0, 12, round(11 * 2**0.5, 6)) in got
    assert not any(r[0] == 2 for r in got)
