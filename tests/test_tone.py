"""Bands, looks, star colours and alignment of frames whose truth is known."""

import math

import numpy as np
import pytest

from framelake.operators import kernels, pipelines, stars, tone

ROWS = "series_id bigint, seq bigint, h int, w int, values array<double>"


def scene(h=40, w=50, seed=1, sigma=3.0):
    rng = np.random.default_rng(seed)
    f = np.stack([kernels.blur(rng.random((h, w)), sigma) for _ in range(3)], axis=2)
    return 0.1 + 0.8 * (f - f.min()) / np.ptp(f)


def test_lab_both_ways():
    f = np.random.default_rng(2).random((20, 20, 3))
    f[0, :5] = [[0, 0, 0], [1, 1, 1], [1, 0, 0], [0, 1, 0], [0.001, 0.002, 0.003]]
    lab = tone.to_lab(f)
    assert np.abs(tone.from_lab(lab) - f).max() < 1e-6
    assert lab[0, 1] == pytest.approx([1, 0, 0], abs=1e-9) and lab[0, 0] == pytest.approx([0, 0, 0], abs=1e-9)
    assert lab[0, 2, 2] * 128 == pytest.approx(-107.86, abs=0.1) and lab[0, 3, 0] * 100 == pytest.approx(87.73, abs=0.05)  # pure blue, pure green


def test_bands_add_up_and_noise_goes():
    x = scene()[..., 0]
    assert np.allclose(tone.rebanded(x, 4, 1.0, lambda k, band: band), x)
    noisy = x + np.random.default_rng(3).normal(0, 0.02, x.shape)
    wide = scene(90, 120, sigma=12.0)[..., 0]
    grain = wide + np.random.default_rng(3).normal(0, 0.02, wide.shape)
    assert np.abs(tone.denoised(grain) - wide).mean() < 0.6 * np.abs(grain - wide).mean()
    assert np.allclose(tone.denoised(np.clip(noisy, 0, 1), luma=0), np.clip(noisy, 0, 1))
    strong = tone.denoised(noisy, iso=3200)
    assert np.abs(np.diff(strong)).mean() < np.abs(np.diff(tone.denoised(noisy))).mean()
    f = scene(90, 120, sigma=12.0)
    specks = np.clip(f + np.random.default_rng(4).normal(0, 0.03, f.shape), 0, 1)
    calm = tone.to_lab(tone.denoised(specks, luma=0.0, chroma=2.0))
    before, truth = tone.to_lab(specks), tone.to_lab(f)
    assert np.abs(calm[..., 1:] - truth[..., 1:]).mean() < 0.6 * np.abs(before[..., 1:] - truth[..., 1:]).mean()
    assert np.abs(calm[..., 0] - before[..., 0]).mean() < 0.01


def test_contrast_and_looks():
    f = scene()
    more = tone.on_lightness(f, lambda x: tone.lively(x, 0.8))
    assert tone.to_lab(more)[..., 0].std() > 1.05 * tone.to_lab(f)[..., 0].std()
    assert np.allclose(tone.lively(np.full((9, 9), 0.4), 1.0), 0.4)
    spread = [tone.to_lab(tone.look(f, p))[..., 0].std() for p in ("neutral", "natural", "vivid", "dramatic")]
    assert spread == sorted(spread) and np.array_equal(tone.look(f, "neutral"), f)
    assert np.allclose(tone.look(np.zeros((8, 8, 3))), 0, atol=1e-6) and np.allclose(tone.look(np.ones((8, 8, 3))), 1, atol=1e-6)
    with pytest.raises(ValueError):
        tone.look(f, "loud")


def coloured_sky(tint, n=30, seed=5):
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:150, 0:200]
    f = np.stack([0.06 * t + rng.normal(0, 0.002, yy.shape) for t in (1.3, 1.0, 0.8)], axis=2)
    for _ in range(n):
        x, y, h = rng.uniform(10, 190), rng.uniform(10, 140), rng.uniform(0.2, 0.5)
        f += (h * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / 5))[..., None] * np.array(tint)
    return np.clip(f, 0, 1)


def test_stars_give_the_white(spark):
    f = coloured_sky((0.7, 1.0, 1.3))
    out = tone.balanced(f)
    found = stars.detect(out.mean(axis=2), least_area=3)[0]
    seen = np.median([out[int(round(y)), int(round(x))] for x, y in zip(found["x"], found["y"])], axis=0)
    assert np.ptp(seen) < 0.08 * seen.mean()
    few = coloured_sky((0.7, 1.0, 1.3), n=4)
    assert np.array_equal(tone.balanced(few), few) and np.allclose(tone.balanced(f, 0.0), f)
    white = tone.white_stars(f)
    spot = f.max(axis=2) > 0.3
    assert np.ptp(white, axis=2)[spot].mean() < 0.25 * np.ptp(f, axis=2)[spot].mean()
    away = tone.star_share(f) == 0
    assert away.mean() > 0.3 and np.array_equal(white[away], f[away])
    df = spark.createDataFrame([(1, 0, 150, 200, f.ravel().tolist()), (1, 1, 2, 2, None)], ROWS)
    rows = {r["seq"]: r["values"] for r in tone.tone_map(df, ["series_id", "seq"], tone.balanced).collect()}
    assert rows[1] is None and np.allclose(np.array(rows[0]).reshape(150, 200, 3), out)


def test_alignment_on_a_moving_subject(spark):
    def flower(cx, cy, size=(120, 160)):
        yy, xx = np.mgrid[0 : size[0], 0 : size[1]]
        f = np.full((*size, 3), 0.5) + np.random.default_rng(int(cx)).normal(0, 0.01, (*size, 3))
        inside = (xx - cx) ** 2 + (yy - cy) ** 2 < 26**2
        f[inside] = (0.1, 0.2, 0.9)
        return np.clip(f, 0, 1)

    place = [(60, 60), (72, 55), (80, 62), (88, 70), (130, 35), None]
    rows = [(1, k, 120, 160, (flower(*p) if p else np.full((120, 160, 3), 0.5)).ravel().tolist()) for k, p in enumerate(place[:5])]
    rows += [(2, k, 120, 160, (flower(*p) if p else np.full((120, 160, 3), 0.5)).ravel().tolist()) for k, p in enumerate([(60, 60), None, (70, 70)])]
    rows += [(3, 0, 120, 160, flower(80, 60).ravel().tolist()), (3, 1, 120, 160, flower(82, 61).ravel().tolist()), (3, 2, 120, 160, None)]
    got = {(r["series_id"], r["seq"]): (r["m"], r["state"]) for r in pipelines.align_on_subject(spark.createDataFrame(rows, ROWS), ["series_id"], "seq").collect()}
    assert [got[1, k][1] for k in range(5)] == ["aligned", "aligned", "reference", "aligned", "too far"]
    for k in (0, 1, 3):
        assert got[1, k][0][2] == pytest.approx(80 - place[k][0], abs=0.6) and got[1, k][0][5] == pytest.approx(62 - place[k][1], abs=0.6)
    assert {got[2, k] for k in range(3)} == {(None, "no reference subject")} and got[3, 2] == (None, "no subject") and got[3, 0][1] == "aligned"


@pytest.mark.parametrize("mode", ["direct", "sequential"])
def test_alignment_by_intensities(spark, mode):
    rng = np.random.default_rng(6)
    waves = [(rng.uniform(0.05, 0.3), rng.uniform(0.05, 0.3), rng.uniform(0, 6)) for _ in range(15)]
    yy, xx = np.mgrid[0:56, 0:56].astype(float)
    rows = []
    for k in range(5):
        t, dx, dy = 0.01 * (k - 2), 0.8 * (k - 2), -0.5 * (k - 2)
        u, v = math.cos(t) * xx - math.sin(t) * yy + dx, math.sin(t) * xx + math.cos(t) * yy + dy
        rows.append((1, k, 56, 56, sum(np.sin(a * u + b * v + p) for a, b, p in waves).ravel().tolist()))
    got = {r["seq"]: np.array(r["m"]).reshape(3, 3) for r in pipelines.align_images(spark.createDataFrame(rows, ROWS), ["series_id"], "seq", mode).collect() if r["m"] is not None}
    for k in set(range(5)) - ({2} if mode == "direct" else set()):
        t = 0.01 * (k - 2)
        want = np.array([[math.cos(t), -math.sin(t), 0.8 * (k - 2)], [math.sin(t), math.cos(t), -0.5 * (k - 2)]])
        for p in ([15, 15, 1], [40, 30, 1]):
            assert np.abs(got[k][:2] @ p - want @ p).max() < 0.1
