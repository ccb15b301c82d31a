"""Bundle and photometric adjustment on rigs and exposures that are known."""

import numpy as np
import pytest

from framelake.operators import adjust

POINTS = "series_id bigint, i bigint, j bigint, xi double, yi double, ui double, xj double, yj double, uj double, note string"


def distorted(x, y, unit, terms):
    """The place that ``undistorted`` takes to (x, y), by fixed-point steps."""
    u, v = x.copy(), y.copy()
    for _ in range(60):
        a, b = adjust.undistorted(u, v, np.full(len(u), unit), np.tile(terms, (len(u), 1)))
        u, v = u + x - a, v + y - b
    return u, v


def rig(series, focal, terms, count, seed, noise=0.0, wrong=0.0):
    """A row of cameras that turn by about a third of their view, and what neighbours both see."""
    rng = np.random.default_rng(seed)
    axis = np.array([[rng.normal(0, 0.03), 0.28 * k, rng.normal(0, 0.03)] for k in range(count)])
    axis[0] = 0
    turn = adjust.rotations(axis)
    rows = []
    for k in range(count - 1):
        rays = turn[k] @ np.array([0.14, 0, 1]) + rng.uniform(-0.35, 0.35, (400, 3))
        places = []
        for c in (k, k + 1):
            p = rays @ turn[c]
            ok = p[:, 2] > 0.2
            x, y = p[:, 0] / np.where(ok, p[:, 2], 1) * focal, p[:, 1] / np.where(ok, p[:, 2], 1) * focal
            x, y = distorted(x, y, 300.0, terms)
            places.append((x, y, ok & (np.abs(x) < 400) & (np.abs(y) < 300)))
        (x, y, a), (u, v, b) = places
        both = np.flatnonzero(a & b)[:120]
        off = rng.normal(0, noise, (4, len(both)))
        off[:, rng.random(len(both)) < wrong] += 40
        rows += [(series, 10 * k, 10 * k + 10, *map(float, (x[n] + off[0, m], y[n] + off[1, m], 300.0, u[n] + off[2, m], v[n] + off[3, m], 300.0)), "q") for m, n in enumerate(both)]
    return rows, turn


def test_rotations():
    rng = np.random.default_rng(1)
    r = adjust.rotations(np.concatenate((rng.normal(0, 1, (20, 3)), np.zeros((1, 3)))))
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(r), 1) and (r[-1] == np.eye(3)).all()
    assert np.allclose(adjust.rotations(np.array([[0, 0, np.pi / 2]]))[0] @ [1, 0, 0], [0, 1, 0])


def test_bundle_recovers_a_rig(spark):
    one, turn = rig(1, 820.0, [0.0, -0.02, 0.0], 5, 3)
    two, turn2 = rig(2, 700.0, [0.0, 0.03, 0.0], 3, 4, noise=0.2, wrong=0.05)
    rows = one + two + [(3, 1, 1, *[1.0] * 6, "same image"), (None, 1, 2, *[1.0] * 6, "no series"), (1, 0, 10, None, *[1.0] * 5, "no place")]
    fitted = adjust.fit(spark.createDataFrame(rows, POINTS), ["series_id"], adjust.bundle(760.0), rounds=25)
    found = {r["series_id"]: r for r in adjust.summary(fitted, ["series_id"]).collect()}
    assert sorted(found) == [1, 2]
    assert found[1]["shared"][0] == pytest.approx(820, rel=2e-3) and found[1]["shared"][2] == pytest.approx(-0.02, abs=3e-3) and found[1]["rms"] < 0.02
    assert found[2]["shared"][0] == pytest.approx(700, rel=2e-2)
    for s in found.values():
        assert len(s["costs"]) > 2 and all(b < a for a, b in zip(s["costs"], s["costs"][1:]))
    own = {(r["series_id"], r["image"]): np.array(r["own"]) for r in adjust.images(fitted, ["series_id"]).collect()}
    for s, truth, near in ((1, turn, 0.05), (2, turn2, 0.5)):
        for k, t in enumerate(truth):
            error = adjust.rotations(own[s, 10 * k][None])[0].T @ t
            assert np.degrees(np.arccos(min(1.0, (np.trace(error) - 1) / 2))) < near


LIGHT = "series_id bigint, i string, j string, vi double, ri double, vj double, rj double, v string"


def test_photometric_recovers_gains_and_falloff(spark):
    rng, rows = np.random.default_rng(6), []
    gains, fall = {"a": 0.8, "b": 1.0, "c": 1.25, "d": 1.1}, (-0.25, 0.04)
    dim = lambda r: 1 + fall[0] * r + fall[1] * r * r
    for i, j in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")):
        for _ in range(300):
            light, ri, rj = rng.uniform(40, 200), rng.uniform(0, 1.6), rng.uniform(0, 1.6)
            wrong = 120 * (rng.random() < 0.05)  # something moved
            rows.append((1, i, j, light * dim(ri) / gains[i], ri, light * dim(rj) / gains[j] + wrong, rj, "q"))
    obs = spark.createDataFrame(rows, LIGHT)
    fitted = adjust.fit(obs, ["series_id"], adjust.photometric(0.01), rounds=40)
    s = adjust.summary(fitted, ["series_id"]).first()
    found = {r["image"]: np.exp(r["own"][0]) for r in adjust.images(fitted, ["series_id"], "string").collect()}
    for n in gains:
        assert found[n] / found["b"] == pytest.approx(gains[n] / gains["b"], rel=0.01)
    for r in (0.3, 0.8, 1.2, 1.6):
        assert 1 + s["shared"][0] * r + s["shared"][1] * r * r == pytest.approx(dim(r), rel=0.01)
    assert all(b < a for a, b in zip(s["costs"], s["costs"][1:]))
    px = spark.createDataFrame([(1, n, 100 * dim(r) / gains[n], r) for n in gains for r in (0.0, 1.0)] + [(1, "z", 5.0, 0.0), (2, "a", 6.0, 0.0)], "series_id bigint, image string, v double, r2 double")
    even = {(r["series_id"], r["image"], r["r2"]): r["v"] for r in adjust.evened(px, fitted, ["series_id"], "image").collect()}
    values = [v for (s_, n, _), v in even.items() if s_ == 1 and n != "z"]
    assert len(even) == 10 and max(values) / min(values) < 1.02 and even[1, "z", 0.0] == 5.0 and even[2, "a", 0.0] == 6.0


def test_nothing_to_fit(spark):
    assert adjust.summary(adjust.fit(spark.createDataFrame([], LIGHT), ["series_id"], adjust.photometric()), ["series_id"]).count() == 0
    same = spark.createDataFrame([(1, "a", "b", 5.0, 0.5, 5.0, 0.5, "v")] * 3, LIGHT)
    out = adjust.images(adjust.fit(same, ["series_id"], adjust.photometric(), rounds=5), ["series_id"], "string").collect()
    assert sorted(r["image"] for r in out) == ["a", "b"] and all(abs(r["own"][0]) < 1e-9 for r in out)


def blocks_of(model, i, j, seed=2):
    """Random positive blocks of pairs, as ``fit`` adds them up."""
    rng = np.random.default_rng(seed)
    slopes = rng.normal(0, 1, (len(i), 30, model.block))
    matrix = slopes.transpose(0, 2, 1) @ slopes
    return np.column_stack((matrix.reshape(len(i), -1), rng.normal(0, 1, (len(i), model.block)), np.zeros((len(i), 2))))


@pytest.mark.parametrize("model", [adjust.bundle(100.0), adjust.photometric()])
def test_steps_by_elimination_are_those_of_the_whole_matrix(model):
    i, j = np.array([(k, k + d) for k in range(60) for d in (1, 2, 7) if k + d < 60 and (k < 40) == (k + d < 40)] + [(5, 2), (2, 1)]).T  # two parts, and a pair both ways
    own = np.random.default_rng(3).normal(0, 0.1, (60, model.own))
    sums, o = blocks_of(model, i, j), model.own
    size = 60 * o + len(model.start)
    whole, right = np.zeros((size, size)), np.zeros(size)
    for p, q, s in zip(i, j, sums):
        at = np.concatenate((p * o + np.arange(o), q * o + np.arange(o), np.arange(60 * o, size)))
        whole[np.ix_(at, at)] += s[: model.block**2].reshape(model.block, -1)
        right[at] += s[model.block**2 : model.block**2 + model.block]
    if model.first_fixed:
        whole[:o], whole[:, :o], right[:o] = 0, 0, 0
        whole[np.arange(o), np.arange(o)] = 1
    else:
        whole[:60, :60] += (50 / 60) ** 2
        right[:60] += 50**2 * own.mean() / 60
    want = -np.linalg.solve(whole + np.diag(0.01 * np.diag(whole)), right)
    for core in (4, 20, 200):
        got = adjust._step(model, i, j, sums, own, 0.01, core)
        assert np.allclose(np.concatenate((got[0].ravel(), got[1])), want, rtol=1e-7, atol=1e-10)


def test_a_long_row_of_images_needs_no_square_matrix():
    import tracemalloc

    model, i = adjust.photometric(), np.arange(5000)
    sums = blocks_of(model, i, i + 1)
    tracemalloc.start()
    own, shared = adjust._step(model, i, i + 1, sums, np.zeros((5001, 1)), 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(own).all() and np.isfinite(shared).all() and peak < 60e6  # the matrix would hold 200 MB
