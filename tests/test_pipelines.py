"""Whole runs on series whose result is known."""

import math

import numpy as np
import pytest

from framelake.operators import kernels, pipelines, stars

ROWS = "series_id bigint, seq bigint, h int, w int, values array<double>"
PIXELS = "series_id bigint, seq bigint, y int, x int, v double"


def pixels(spark, images):
    return spark.createDataFrame([(1, 10 * k, y, x, float(v)) for k, f in enumerate(images) for (y, x), v in np.ndenumerate(f)], PIXELS)


def image(df, value="value"):
    rows = df.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


def test_astro_run(spark):
    rng = np.random.default_rng(4)
    shape, truth = (130, 170), []
    while len(truth) < 22:
        x, y = rng.uniform(22, 148), rng.uniform(22, 108)
        if all(math.hypot(x - a, y - b) > 11 for a, b, _ in truth):
            truth.append((x, y, rng.uniform(0.3, 0.9)))
    yy, xx = np.mgrid[0 : shape[0], 0 : shape[1]]
    images, place = [], {}
    for k in range(9):
        t, dx, dy = 0.02 * (k - 4), 2.2 * (k - 4), -1.4 * (k - 4)
        back = np.array([[math.cos(t), -math.sin(t), dx], [math.sin(t), math.cos(t), dy], [0, 0, 1]])
        place[k] = back
        f = 0.1 + rng.normal(0, 0.006, shape)
        for x, y, height in truth[: 5 if k == 7 else None]:  # frame 7 is clouded
            u, v, _ = back @ [x, y, 1]
            f += height * np.exp(-((xx - u) ** 2 + (yy - v) ** 2) / (2 * 1.6**2))
        if k == 2:
            for s in np.linspace(0, 1, 800):
                f[round(10 + 100 * s), round(8 + 150 * s)] = 1.0  # a satellite
        f[60, 40] = 1.0  # a hot pixel
        images.append(f)
    df = spark.createDataFrame([(1, k, *shape, f.ravel().tolist()) for k, f in enumerate(images)], ROWS)
    out, fate = pipelines.astro(df, ["series_id"], "seq", "sigma", least_votes=50)
    states = {r["seq"]: (r["state"], r["reasons"]) for r in fate.collect()}
    assert states[2] == ("rejected", ["trail"]) and states[7][0] == "rejected" and "few stars" in states[7][1]
    assert sorted(s for s, _ in states.values()) == ["direct"] * 6 + ["reference"] + ["rejected"] * 2
    reference = next(k for k, (s, _) in states.items() if s == "reference")
    result = np.nan_to_num(image(out), nan=0.1)
    found = stars.detect(result)[0]
    for x, y, _ in truth:
        u, v, _ = place[reference] @ [x, y, 1]
        assert np.hypot(found["x"] - u, found["y"] - v).min() < 0.4
    assert np.median(found["elongation"]) < 1.2
    corner = result[20:40, 20:60]
    assert np.median(np.abs(corner - np.median(corner))) < 0.6 * np.median(np.abs(images[4][20:40, 20:60] - np.median(images[4][20:40, 20:60])))


def test_focus_run(spark):
    sharp = kernels.blur(np.random.default_rng(5).random((32, 32)), 0.7)
    soft = kernels.blur(sharp, 2.5)
    left, right = sharp.copy(), sharp.copy()
    left[:, 16:], right[:, :16] = soft[:, 16:], soft[:, :16]
    out, fate = pipelines.focus(pixels(spark, [left, right, kernels.blur(sharp, 6.0)]), ["series_id"], "seq")
    got = image(out)
    assert np.abs(got - sharp)[:, [*range(12), *range(20, 32)]].mean() < 0.25 * np.abs(soft - sharp).mean()
    rows = {r["seq"]: (r["contrib"], r["kept"]) for r in fate.collect()}
    assert rows[20] == (0, False) and rows[0][1] and rows[10][1] and rows[0][0] + rows[10][0] == 16
    crisp = image(pipelines.focus(pixels(spark, [left, right]), ["series_id"], "seq", sharpen=80.0)[0])
    assert kernels.sharpness(crisp).mean() > kernels.sharpness(got).mean()


def test_exposure_run(spark):
    rng = np.random.default_rng(6)
    light = kernels.blur(rng.random((24, 24)), 1.0)
    light = 0.05 + (light - light.min()) / np.ptp(light) * 1.6
    rows = []
    for k, t in enumerate((0.3, 0.6, 1.2)):
        f = np.clip(light * t, 0, 1)
        if k == 2:
            f[5:9, 5:9] = 0.02 if f[6, 6] > 0.5 else 0.98  # something moved
        rows += [(1, k, y, x, float(v), float(v * 0.9), float(v * 0.8)) for (y, x), v in np.ndenumerate(f)]
    df = spark.createDataFrame(rows, "series_id bigint, seq bigint, y int, x int, b double, g double, r double")
    plain, steady = image(pipelines.exposures(df, ["series_id"], "seq", "off"), "g"), image(pipelines.exposures(df, ["series_id"], "seq", "auto"), "g")
    assert plain.shape == steady.shape == (24, 24) and 0 <= steady.min() and steady.max() <= 1
    assert np.corrcoef(plain.ravel(), light.ravel())[0, 1] > 0.85
    best = 0.9 * np.clip(light * 0.6, 0, 1)
    options = [0.9 * np.clip(light * t, 0, 1) for t in (0.3, 0.6)]
    assert min(np.abs(steady - o)[6:8, 6:8].mean() for o in options) < min(np.abs(plain - o)[6:8, 6:8].mean() for o in options) or np.abs(steady - best)[6:8, 6:8].mean() < 0.1
    with pytest.raises(ValueError):
        pipelines.exposures(df, ["series_id"], "seq", "maybe")


def test_long_exposure_run(spark):
    rng = np.random.default_rng(7)
    images = rng.random((5, 6, 7))
    df = pixels(spark, images)
    run = lambda *a: image(pipelines.long_exposure(df, ["series_id"], "seq", *a))
    assert np.allclose(run("smooth"), images.mean(axis=0)) and np.allclose(run("trails"), images.max(axis=0)) and np.allclose(run("median"), np.median(images, axis=0))
    assert np.allclose(run("bright"), 0.4 * images.mean(axis=0) + 0.6 * images.max(axis=0))
    assert np.allclose(run("smooth", 0.25), 0.25 * images.mean(axis=0) + 0.75 * images[2])
    assert run("clean").shape == (6, 7)
    with pytest.raises(ValueError):
        run("fast")


def test_lucky_run(spark):
    sharp = kernels.blur(np.random.default_rng(8).random((16, 16)), 0.5)
    images = [kernels.blur(sharp, 1.5) for _ in range(7)] + [sharp] * 3
    assert np.allclose(image(pipelines.lucky(pixels(spark, images), ["series_id"], "seq", gains=())), sharp)
    assert np.allclose(image(pipelines.lucky(pixels(spark, images), ["series_id"], "seq", local=False, gains=())), sharp)
    assert np.allclose(image(pipelines.lucky(pixels(spark, images), ["series_id"], "seq")), kernels.wavelet_sharpen(sharp), atol=1e-9)


def test_runs_of_nothing(spark):
    empty = spark.createDataFrame([], PIXELS)
    assert pipelines.focus(empty, ["series_id"], "seq")[0].count() == 0
    assert pipelines.long_exposure(empty, ["series_id"], "seq", "smooth", 0.5).count() == 0
    out, fate = pipelines.astro(spark.createDataFrame([], ROWS), ["series_id"], "seq")
    assert out.count() == 0 and fate.count() == 0
