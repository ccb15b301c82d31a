"""Fusion, deghosting, lucky imaging and verdicts against plain loops and planted cases."""

import numpy as np
import pytest

from framelake.operators import fusion, kernels, score


def pixels(spark, frames):
    """Frames (n x h x w) as a pixel table of series 1."""
    rows = [(1, s, y, x, float(v)) for s, f in enumerate(frames) for (y, x), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, "series_id bigint, seq bigint, y int, x int, v double")


def image(df, value="value"):
    rows = df.collect()
    out = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1))
    for r in rows:
        out[r["y"], r["x"]] = r[value]
    return out


def test_exposure_fusion_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    colour = rng.random((3, 6, 7, 3))
    rows = [(1, s, y, x, *map(float, colour[s, y, x])) for s in range(3) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(rows, "series_id bigint, seq bigint, y int, x int, b double, g double, r double")
    second = np.array([1.0, -2.0, 1.0])
    w = []
    for f in colour:
        gray = f @ np.array([0.114, 0.587, 0.299])
        lap = kernels._along(gray, second, 0) + kernels._along(gray, second, 1)
        w.append(np.abs(lap) * f.std(axis=2) * np.exp(-((f - 0.5) ** 2).sum(axis=2) / 0.08) + 1e-12)
    w = np.stack(w) / np.sum(w, axis=0)
    want = np.zeros((6, 7, 3))
    for c in range(3):
        total = None
        for f, share in zip(colour, w):
            levels = [share]
            for _ in range(2):
                levels.append(kernels.halve(levels[-1]))
            parts = [b * s for b, s in zip(kernels.pyramid(f[..., c], 2), levels)]
            total = parts if total is None else [a + b for a, b in zip(total, parts)]
        want[..., c] = np.clip(kernels.collapse(total), 0, 1)
    got = fusion.exposure_fusion(fusion.exposure_weights(df, ["series_id"], "seq"), ["series_id"], "seq")
    for c in range(3):
        assert np.allclose(image(got.filter(f"c = {c}")), want[..., c])


def test_equal_exposures_fuse_to_themselves(spark):
    f = np.random.default_rng(2).random((4, 4, 3)) * 0.5 + 0.25
    rows = [(1, s, y, x, *map(float, f[y, x])) for s in range(3) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "series_id bigint, seq bigint, y int, x int, b double, g double, r double")
    weighted = fusion.exposure_weights(df, ["series_id"], "seq").cache()
    assert all(r["w"] == pytest.approx(1.0) for r in weighted.groupBy("y", "x").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect())


def test_consistent_merge_equals_a_plain_loop_and_keeps_the_coarse_choice(spark):
    stack = np.random.default_rng(8).random((4, 8, 8))
    parts = [kernels.pyramid(x, 2) for x in stack]
    prior, bands = None, []
    for k in (1, 0):
        e = np.stack([kernels.box(np.abs(p[k]), 2) for p in parts])
        own = e.argmax(axis=0)
        if prior is not None:
            up = prior.repeat(2, axis=0).repeat(2, axis=1)
            held = np.take_along_axis(e, up[None], axis=0)[0]
            own = np.where(e.max(axis=0) > held * 1.25 + 1e-6, own, up)
        prior = own
        bands.insert(0, np.take_along_axis(np.stack([p[k] for p in parts]), own[None], axis=0)[0])
    want = kernels.collapse([*bands, np.mean([p[2] for p in parts], axis=0)])
    assert np.allclose(image(fusion.consistent_merge(pixels(spark, stack), ["series_id"], "seq"), "v"), want)
    one = np.random.default_rng(1).random((8, 8))
    assert np.allclose(image(fusion.consistent_merge(pixels(spark, [one, one]), ["series_id"], "seq"), "v"), one)


def test_a_moving_block_is_taken_from_the_reference_exposure(spark):
    base = np.random.default_rng(5).random((16, 16)) * 40 + 90
    frames = [base.copy() for _ in range(3)]
    frames[1][4:10, 4:10] = 230.0
    df = pixels(spark, frames)
    merged = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(np.mean(frames, axis=0))], "series_id bigint, y int, x int, value double")
    moving = image(fusion.exposure_motion(df, ["series_id"], "seq"), "moving")
    assert moving[4:10, 4:10].mean() > 0.6 and moving[13:, 13:].max() == 0
    out = image(fusion.deghost_exposures(df, merged, ["series_id"], "seq", soft=0.5))
    ghost = np.abs(np.mean(frames, axis=0) - base)[4:10, 4:10].mean()
    assert np.abs(out - base)[4:10, 4:10].mean() < 0.6 * ghost


def test_voted_winner_ignores_single_specks(spark):
    rng = np.random.default_rng(3)
    sharp, flat = rng.random((9, 9)), np.full((9, 9), 0.5)
    flat[4, 4] = 3.0
    got = image(fusion.voted_winner(pixels(spark, [sharp, flat]), ["series_id"], "seq"), "seq")
    assert (got == 0).all()


def test_deghost_keeps_calm_areas(spark):
    calm = np.random.default_rng(6).random((8, 8))
    frames = [calm.copy() for _ in range(3)]
    frames[2][0:2, 0:2] += 2.0
    df = pixels(spark, frames)
    mean = np.mean(frames, axis=0)
    merged = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(mean)], "series_id bigint, y int, x int, value double")
    out = image(fusion.deghost_sharpest(df, merged, ["series_id"], "seq"))
    assert np.allclose(out[3:, 3:], calm[3:, 3:])
    source = np.stack(frames)[:, 0, 0]
    assert np.abs(source - out[0, 0]).min() < 1e-9


def test_modes_of_long_exposures(spark):
    def mode(frames):
        return fusion.suggest_mode(pixels(spark, frames), ["series_id"], "seq").first()

    rng = np.random.default_rng(9)
    texture = rng.random((16, 16)) * 60 + 100
    lights = [np.full((16, 16), 10.0) + rng.random((16, 16)) for _ in range(8)]
    for k, f in enumerate(lights):
        f[2 * k, 3:6] = 250
    assert mode(lights)["mode"] == "trails"
    walkers = [texture.copy() for _ in range(8)]
    for k, f in enumerate(walkers):
        f[8, k : k + 2] = 20
    assert mode(walkers)["mode"] == "declutter" and mode(walkers)["align"] == "none"
    assert mode([texture * 0.2] * 4)["mode"] == "bright"
    assert mode([texture] * 4)["mode"] == "smooth"
    assert mode([np.roll(texture, 3 * k, axis=1) for k in range(4)])["align"] == "feature"


def test_score_of_a_soft_and_of_a_ghosted_stack(spark):
    rng = np.random.default_rng(7)
    crisp = rng.random((16, 16)) * 120 + 60
    verdict = lambda result, frames, **o: fusion.stack_score(pixels(spark, [result]).drop("seq"), pixels(spark, frames), ["series_id"], "seq", **o).first()
    calm = [crisp + rng.random((16, 16)) for _ in range(4)]
    soft = verdict(np.full((16, 16), 100.0), calm)
    assert "soft" in soft["findings"] and soft["halo"] == 0 and soft["score"] == 88
    moved = [f.copy() for f in calm]
    moved[1][5, 5] = 0.0
    moved[2][5, 5] = 255.0
    ghosted = verdict(crisp, moved)
    assert "ghosts" in ghosted["findings"] and ghosted["ghost_area_pct"] > 0.2
    assert verdict(crisp, moved, subject_aligned=True)["score"] == ghosted["score"] + 12
    assert verdict(crisp, moved[:2])["ghost_area_pct"] == 0


def test_lucky_results_come_from_the_sharp_frames(spark):
    rng = np.random.default_rng(11)
    sharp = rng.random((8, 8))
    frames = [kernels.blur(sharp, 1.5) for _ in range(7)] + [sharp] * 3
    assert np.allclose(image(fusion.lucky_stack(pixels(spark, frames), ["series_id"], "seq", 0.3)), sharp)
    assert np.allclose(image(fusion.lucky_map(pixels(spark, frames), ["series_id"], "seq", share=0.3)), sharp)


@pytest.mark.parametrize("shape", [(16, 16), (15, 21), (5, 4)])
def test_lucky_map_covers_the_frame(spark, shape):
    sharp = np.random.default_rng(13).random(shape)
    frames = [kernels.blur(sharp, 1.5) for _ in range(7)] + [sharp] * 3
    rows = fusion.lucky_map(pixels(spark, frames), ["series_id"], "seq", share=0.3).collect()
    assert len(rows) == shape[0] * shape[1]
    assert all(abs(r["value"] - sharp[r["y"], r["x"]]) < 1e-9 for r in rows)


def test_tiles_follow_the_frame(spark):
    f = np.random.default_rng(15).random((16, 24))
    got = {r["tile"]: r["s"] for r in score.tile_sharpness(pixels(spark, [f]), ["series_id", "seq"]).collect()}
    p = np.pad(f, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * f
    inner = {4 * a + b: lap[4 * a : 4 * a + 4, 6 * b : 6 * b + 6].var() for a in range(4) for b in range(4)}
    assert got.keys() == inner.keys() and all(abs(got[t] - inner[t]) < 1e-9 for t in (5, 6, 9, 10))


def test_votes_of_a_frame_with_gaps(spark):
    px = pixels(spark, [np.random.default_rng(16).random((6, 6)) for _ in range(3)]).filter("NOT (y = 2 AND x > 0)")
    rows = fusion.voted_winner(px, ["series_id"], "seq").collect()
    assert len(rows) == 31 and all(r["seq"] is not None for r in rows)


def test_focus_average_prefers_the_sharp_frame(spark):
    sharp = np.random.default_rng(12).random((8, 8))
    flat = np.full((8, 8), 0.5)
    out = image(fusion.focus_average(pixels(spark, [sharp, flat]), ["series_id"], "seq", 1))
    assert np.abs(out - sharp).max() < 1e-3


def test_local_normalization_takes_a_gradient_away(spark):
    base = np.random.default_rng(14).random((24, 24)) * 0.1
    slope = np.linspace(0, 1, 24)[None, :].repeat(24, axis=0)
    got = fusion.local_normalize(pixels(spark, [base, base + slope]), ["series_id"], "seq", 2)
    assert np.allclose(image(got.filter("seq = 0")), base)
    rest = image(got.filter("seq = 1")) - base
    assert np.abs(rest[:, 6:18]).max() < 0.1 * np.ptp(slope)
