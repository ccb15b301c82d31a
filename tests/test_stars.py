"""Star tables, point shapes, star removal and point-star stacks on skies that are known."""

import math

import numpy as np
import pytest

from framelake.operators import kernels, stars

ROWS = "series_id bigint, seq bigint, h int, w int, values array<double>, mask_ string"


def sky(places, shape=(120, 160), sigma=2.0, noise=0.004, slope=0.1, seed=1, stretch=1.0):
    """Gaussian stars (x, y, height) on a sloping background."""
    yy, xx = np.mgrid[0 : shape[0], 0 : shape[1]]
    f = 0.1 + slope * xx / shape[1] + np.random.default_rng(seed).normal(0, noise, shape)
    for x, y, height in places:
        f = f + height * np.exp(-((xx - x) ** 2 / stretch**2 + (yy - y) ** 2) / (2 * sigma**2))
    return f


def spread(n, shape=(120, 160), seed=2, edge=16, apart=14.0):
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        x, y = rng.uniform(edge, shape[1] - edge), rng.uniform(edge, shape[0] - edge)
        if all(math.hypot(x - a, y - b) > apart for a, b, _ in out):
            out.append((x, y, rng.uniform(0.2, 0.6)))
    return out


def frames(spark, *images):
    return spark.createDataFrame([(1, k, *(f.shape if f is not None else (2, 2)), None if f is None else f.ravel().tolist(), "m") for k, f in enumerate(images)], ROWS)


def test_star_table(spark):
    truth = spread(20)
    df = frames(spark, sky(truth), np.full((40, 40), 0.2), None, sky(truth, stretch=1.8))
    table = [r for r in stars.star_table(df, ["series_id", "seq"]).collect() if r["seq"] == 0]
    assert len(table) == 20 and [r["id"] for r in sorted(table, key=lambda r: -r["flux"])] == list(range(20))
    for x, y, height in truth:
        r = min(table, key=lambda r: math.hypot(r["x"] - x, r["y"] - y))
        assert math.hypot(r["x"] - x, r["y"] - y) < 0.15
    quality = {r["seq"]: r for r in stars.frame_quality(df, ["series_id", "seq"]).collect()}
    assert quality[0]["stars"] == 20 and quality[0]["fwhm"] == pytest.approx(2.3548 * 2.0, rel=0.15) and quality[0]["elongation"] < 1.2
    assert quality[1]["stars"] == quality[2]["stars"] == 0 and quality[1]["fwhm"] == 99 and quality[2]["background"] is None
    assert quality[3]["elongation"] > 1.5
    assert stars.star_table(df.limit(0), ["seq"]).count() == 0


@pytest.mark.parametrize("sigma", [1.5, 2.2])
def test_point_shape_has_the_true_width(spark, sigma):
    bright = [(20.0, 20.0, 1.5)]  # saturates, and is left out
    df = frames(spark, *[sky([*spread(25, seed=s, apart=22.0, shape=(240, 240)), *bright], (240, 240), sigma=sigma, seed=s) for s in (3, 4)])
    rows = stars.point_shape(df, ["series_id"]).collect()
    shape = np.zeros((21, 21))
    for r in rows:
        shape[r["y"], r["x"]] = r["value"]
    assert shape.sum() == pytest.approx(1.0) and rows[0]["stars"] >= 40
    line = shape[10] / shape[10, 10]
    half = np.interp(0.5, line[10:][::-1], np.arange(10, -1, -1.0))
    assert 2 * half == pytest.approx(2.3548 * math.sqrt(sigma**2 + 1 / 6), rel=0.05)  # bilinear samples widen a little
    lone = stars.point_shape(frames(spark, np.full((40, 40), 0.2)), ["series_id"]).collect()
    assert sum(r["value"] for r in lone) == pytest.approx(1.0) and lone[0]["stars"] == 0


def test_removed_stars_leave_the_background(spark):
    truth = spread(25)
    clean = sky([])
    df = frames(spark, sky(truth), None, np.full((20, 20), 0.5))
    out = {r["seq"]: r for r in stars.remove_stars(df, ["series_id", "seq"], grow=5).collect()}
    got, mask = np.array(out[0]["values"]).reshape(120, 160), np.array(out[0]["mask"]).reshape(120, 160) > 0
    assert 0.05 < mask.mean() < 0.4 and (got[~mask] == sky(truth)[~mask]).all()
    smooth = sky([], noise=0)
    assert np.abs(got - smooth)[mask].mean() < 0.008 and np.abs(got - smooth)[mask].max() < 0.03
    assert out[1]["values"] is None and out[2]["values"] == [0.5] * 400
    assert clean.std() > 0


def test_fill_of_odd_holes():
    yy, xx = np.mgrid[0:40, 0:50]
    plane = 0.01 * xx + 0.005 * yy
    hole = np.zeros((40, 50), dtype=bool)
    hole[10:22, 15:30] = True
    assert np.abs(stars.filled(plane, hole, 200) - plane).max() < 0.03
    assert (stars.filled(plane, ~np.zeros_like(hole)) == plane).all() and (stars.filled(plane, np.zeros_like(hole)) == plane).all()
    corner = np.zeros((5, 5), dtype=bool)
    corner[:4, :4] = True
    assert np.allclose(stars.filled(np.ones((5, 5)), corner), 1)


def test_point_stars_over_a_standing_ground(spark):
    rng = np.random.default_rng(9)
    ground = kernels.blur(rng.random((120, 160)), 2.0)
    truth = [(x, y, 0.7) for x, y, _ in spread(12, (76, 160), edge=14)]
    images, moves = [], []
    for k in range(7):
        t, dx, dy = 0.012 * (k - 3), 2.5 * (k - 3), -0.8 * (k - 3)
        back = np.array([[math.cos(t), -math.sin(t), dx], [math.sin(t), math.cos(t), dy], [0, 0, 1]])  # reference to frame
        moved = [(*(back @ [x, y, 1])[:2], h) for x, y, h in truth]
        f = sky(moved, sigma=1.3, slope=0, noise=0.003, seed=k)
        f[80:] = ground[80:]
        images.append(f)
        moves.append((1, k, np.linalg.inv(back).ravel().tolist() if k != 5 else None))
    df = frames(spark, *images, None)
    m = spark.createDataFrame(moves, "series_id bigint, seq bigint, m array<double>")
    out = np.zeros((120, 160))
    rows = stars.point_stars(df, ["series_id"], "seq", m, horizon=78, feather=4).collect()
    for r in rows:
        out[r["y"], r["x"]] = r["value"]
    assert len(rows) == 120 * 160
    assert np.abs(out[84:] - np.mean(images, axis=0)[84:]).max() < 1e-9
    found = stars.detect(out[:75])[0]
    for x, y, _ in truth:
        assert np.hypot(found["x"] - x, found["y"] - y).min() < 0.5
    assert np.median(found["elongation"]) < 1.25
    plain = stars.detect(np.mean(images, axis=0)[:75], most_area=5000)[0]
    assert found["peak"].max() > 1.5 * plain["peak"].max()
    assert stars.point_stars(df.limit(0), ["series_id"], "seq", m).count() == 0


def test_bending_takes_distortion_away(spark):
    truth = spread(40, (160, 200), edge=14, apart=13.0)
    off = lambda x, y: (x + 3.5 * ((x - 100) / 100) ** 2, y + 2.5 * ((y - 80) / 80) * ((x - 100) / 100))
    wrong = sky([(*off(x, y), h) for x, y, h in truth], (160, 200), sigma=1.6)
    right = sky(truth, (160, 200), sigma=1.6, seed=4)
    rows = [(1, 0, 160, 200, wrong.ravel().tolist()), (1, 1, 160, 200, right.ravel().tolist()), (2, 0, 160, 200, wrong.ravel().tolist()), (1, 2, 160, 200, None)]
    moved = spark.createDataFrame(rows, "series_id bigint, seq bigint, h int, w int, moved array<double>")
    reference = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y, _) in enumerate(truth)], "series_id bigint, id bigint, x double, y double")
    got = {(r["series_id"], r["seq"]): r for r in stars.bent_frames(moved, ["series_id"], "seq", reference).collect()}
    assert got[1, 0]["pairs"] == 40 and got[1, 0]["apart"] > 0.5 and got[1, 1]["apart"] < 0.2
    assert got[1, 1]["moved"] == rows[1][4] and got[2, 0]["moved"] == rows[2][4] and got[2, 0]["pairs"] == 0 and got[1, 2]["moved"] is None
    bent = np.array(got[1, 0]["moved"]).reshape(160, 200)

    def residual(f):
        found = stars.detect(np.nan_to_num(f, nan=0.1), least_area=3)[0]
        return [np.hypot(found["x"] - x, found["y"] - y).min() for x, y, _ in truth]

    assert np.median(residual(bent)) < 0.15 and np.max(residual(bent)) < 0.7 and np.median(residual(wrong)) > 0.6
