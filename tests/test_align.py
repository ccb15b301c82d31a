"""Scans over partitions, chained alignment and registration over bridges, each against a plain loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import align, scan

NINE = "array<double>"


def rigid(rng, scale=True):
    t, s = rng.uniform(-0.4, 0.4), rng.uniform(0.9, 1.1) if scale else 1.0
    c, n = s * math.cos(t), s * math.sin(t)
    return np.array([[c, -n, rng.uniform(-9, 9)], [n, c, rng.uniform(-9, 9)], [0, 0, 1]])


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_scan_over_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(s, k, rigid(rng, False).ravel().tolist()) for s, n in [(1, 500), (2, 1), (3, 40), (None, 30), (5, 700)] for k in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(rows, f"s bigint, k bigint, m {NINE}").withColumn("__part", F.lit("mine"))
    try:
        got = {(r["s"], r["k"]): np.array(r["p"]).reshape(3, 3) for r in scan.segmented_scan(df.repartition(5), ["s"], ["k"], "m", scan.multiply_matrices, "p").collect()}
        numbers = sorted((r["s"] or 0, r["k"], r["n"]) for r in scan.positions(df, ["s"], ["k"], "n").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    so_far = {}
    for s, k, m in rows:
        so_far[s] = so_far.get(s, np.eye(3)) @ np.array(m).reshape(3, 3)
        assert np.allclose(got[s, k], so_far[s], atol=1e-6), (s, k)
    assert len(got) == len(rows) and numbers == sorted((s or 0, k, k) for s, k, _ in rows)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], f"s bigint, k bigint, m {NINE}")
    assert scan.segmented_scan(df, ["s"], ["k"], "m", scan.multiply_matrices, "p").count() == 0
    assert scan.positions(df, ["s"], ["k"]).count() == 0


@pytest.mark.parametrize("both_ways", [False, True])
def test_align_sequential(spark, both_ways):
    rng, rows = random.Random(4), []
    for s, n in [(1, 1), (2, 2), (3, 31), (4, 64), (None, 5)]:
        for k in range(n):
            lost = rng.random() < 0.1 or (s == 4 and k == 9)
            back = None if k == 0 or lost else (np.zeros(9) if s == 4 and k == 50 and not both_ways else rigid(rng).ravel()).tolist()
            rows.append((s, k, back, None if k == n - 1 or rng.random() < 0.1 else rigid(rng).ravel().tolist(), "x", 7))
    frames = spark.createDataFrame(rows, f"series_id bigint, k bigint, back {NINE}, onward {NINE}, steps_ string, note int")
    out = align.align_sequential(frames, ["series_id"], ahead="onward" if both_ways else None)
    got = {(r["series_id"], r["k"]): (np.array(r["m"]).reshape(3, 3), r["steps"], r["failed"], r["note"]) for r in out.collect()}
    assert len(got) == len(rows)
    table = {(s, k): (b, a) for s, k, b, a, *_ in rows}
    for s in {r[0] for r in rows}:
        n = sum(r[0] == s for r in rows)
        for side in (1, -1):
            m, failed = np.eye(3), 0
            k = n // 2
            while 0 <= k < n:
                assert np.allclose(got[s, k][0], m, atol=1e-6) and got[s, k][1:] == (abs(k - n // 2), failed, 7), (s, k)
                k += side
                if not 0 <= k < n:
                    break
                step = table[s, k][0] if side > 0 else table[s, k][1] if both_ways else table[s, k + 1][0]
                step = None if step is None else np.array(step).reshape(3, 3)
                if side < 0 and not both_ways and step is not None:
                    step = np.linalg.inv(step) if abs(np.linalg.det(step)) > 1e-12 else None
                failed += step is None
                m = m if step is None else m @ step


def test_moment_steps_follow_a_moving_blob(spark):
    yy, xx = np.mgrid[0:24, 0:24]
    rows, truth = [], []
    for k in range(6):
        t, cx, cy = 0.1 * k, 11 + 0.4 * k, 12 - 0.3 * k
        u, v = (xx - cx) * math.cos(t) + (yy - cy) * math.sin(t), -(xx - cx) * math.sin(t) + (yy - cy) * math.cos(t)
        w = np.exp(-u * u / 18 - v * v / 4)
        truth.append((t, cx, cy))
        rows += [(1, 10 * k, y, x, float(w[y, x])) for y in range(24) for x in range(24)]
    px = spark.createDataFrame(rows, "series_id bigint, seq bigint, y int, x int, v double")
    steps = align.moment_steps(align.frame_moments(px, ["series_id", "seq"]), ["series_id"], ["seq"])
    out = {r["k"]: np.array(r["m"]).reshape(3, 3) for r in align.align_sequential(steps, ["series_id"]).collect()}
    assert len(out) == 6
    for k, (_, cx, cy) in enumerate(truth):
        assert np.allclose((out[k] @ [cx, cy, 1])[:2], truth[3][1:], atol=0.05)
        assert abs(math.atan2(out[k][1, 0], out[k][0, 0]) - (truth[3][0] - truth[k][0])) < 0.01


# --- registration ---------------------------------------------------------------------------------


def plain_registration(frames, pairs):
    """Kruskal's forest per series, then products along its paths from the reference."""
    out = {}
    for s in {f[0] for f in frames}:
        nodes = {f for t, f, _ in frames if t == s}
        head = min((f for t, f, r in frames if t == s and r), default=None)
        edges, group = [], {n: n for n in nodes}
        for t, a, b, m, score in pairs:
            if t == s and m is not None and score is not None and a in nodes and b in nodes and a != b and abs(np.linalg.det(m)) > 1e-12:
                edges.append(((0 if head in (a, b) else 1, -score, min(a, b), max(a, b)), a, b, m))

        def find(n):
            while group[n] != n:
                n = group[n]
            return n

        links = {n: [] for n in nodes}
        for _, a, b, m in sorted(edges, key=lambda e: e[0]):
            if find(a) != find(b):
                group[find(a)] = find(b)
                links[a].append((b, np.linalg.inv(m)))  # from b's coordinates to a's
                links[b].append((a, m))
        paired = {n for _, a, b, _ in edges for n in (a, b)}
        direct = {n for _, a, b, _ in edges for n in (a, b) if head in (a, b)}
        for n in nodes:
            out[s, n] = (None, "no reference" if head is None else "unpaired" if n not in paired else "apart")
        if head is not None:
            todo, seen = [(head, np.eye(3))], set()
            while todo:
                n, m = todo.pop()
                seen.add(n)
                out[s, n] = (m, "reference" if n == head else "direct" if n in direct else "bridged")
                todo += [(o, m @ step) for o, step in links[n] if o not in seen]
    return out


def registered(spark, frames, pairs, **options):
    f = spark.createDataFrame(frames, "series_id bigint, frame bigint, reference boolean")
    p = spark.createDataFrame([(s, a, b, None if m is None else np.asarray(m).ravel().tolist(), score) for s, a, b, m, score in pairs], f"series_id bigint, mov bigint, ref bigint, m {NINE}, score double")
    rows = align.register(f, p, ["series_id"], **options).collect()
    return {(r["series_id"], r["frame"]): (None if r["m"] is None else np.array(r["m"]).reshape(3, 3), r["state"]) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (m, state) in want.items():
        assert got[key][1] == state, (key, got[key], state)
        assert (m is None) == (got[key][0] is None) and (m is None or np.allclose(got[key][0], m, atol=1e-6)), key


def test_register_chain_star_and_broken_series(spark):
    rng = random.Random(1)
    frames = [(1, k, k == 20) for k in range(41)]  # a chain
    pairs = [(1, k, k - 1, rigid(rng, False), 30.0) for k in range(1, 41)]
    frames += [(2, k, k == 0) for k in range(12)]  # a star
    pairs += [(2, k, 0, rigid(rng), float(k)) for k in range(1, 12)]
    frames += [(3, k, k == 2) for k in range(10)]  # broken: 0-4 and 5-8 hang together, 9 in no pair
    pairs += [(3, k, k + 1, rigid(rng), 9.0) for k in (0, 1, 2, 3, 5, 6, 7)]
    frames += [(4, k, False) for k in range(3)] + [(5, 0, True), (None, 1, True), (6, None, True)]
    pairs += [(4, 0, 1, rigid(rng), 1.0), (5, 0, 0, rigid(rng), 1.0), (5, 0, 99, rigid(rng), 1.0), (9, 1, 2, rigid(rng), 1.0), (None, 1, 2, rigid(rng), 1.0)]
    want = plain_registration([f for f in frames if None not in f[:2]], pairs)
    same(registered(spark, frames + frames[:5], pairs), want)
    states = [s for _, s in want.values()]
    assert {s: states.count(s) for s in set(states)} == {"reference": 4, "direct": 15, "bridged": 40, "apart": 4, "unpaired": 1, "no reference": 3}


def test_register_random_graphs(spark):
    rng, frames, pairs = random.Random(8), [], []
    for s in range(12):
        n = rng.randrange(1, 30)
        frames += [(s, k, k == n // 2) for k in range(n)]
        for _ in range(rng.randrange(3 * n)):
            m = None if rng.random() < 0.05 else np.zeros((3, 3)) if rng.random() < 0.05 else rigid(rng)
            a, b = rng.randrange(n), rng.randrange(n)
            if not any(p[0] == s and {p[1], p[2]} == {a, b} for p in pairs):
                pairs.append((s, a, b, m, None if rng.random() < 0.05 else float(rng.randrange(6))))  # many ties
    same(registered(spark, frames, pairs), plain_registration(frames, pairs))


def test_register_checks_bridges_by_points(spark):
    rng = random.Random(2)
    stars = np.array([[rng.uniform(0, 400), rng.uniform(0, 300)] for _ in range(60)])
    place = {k: np.eye(3) if k == 0 else rigid(rng, False) for k in range(4)}  # frame to reference
    step = lambda a, b: np.linalg.inv(place[b]) @ place[a]
    pairs = [(1, 1, 0, step(1, 0), 40.0), (1, 2, 1, step(2, 1), 30.0), (1, 3, 1, step(3, 1) @ np.array([[1, 0, 25.0], [0, 1, 0], [0, 0, 1]]), 30.0)]
    frames = [(1, k, k == 0) for k in range(4)]
    rows = [(1, k, *(np.linalg.inv(place[k]) @ [x, y, 1])[:2].tolist()) for k in range(4) for x, y in stars]
    points = spark.createDataFrame(rows, "series_id bigint, frame bigint, x double, y double")
    got = registered(spark, frames, pairs, points=points)
    assert [got[1, k][1] for k in range(4)] == ["reference", "direct", "bridged", "unverified"]
    assert np.allclose(got[1, 2][0], place[2], atol=1e-6) and got[1, 3][0] is None


def test_register_nothing(spark):
    assert registered(spark, [], []) == {}
    assert registered(spark, [(1, 1, True)], []).keys() == {(1, 1)}


def test_pairs_of_frames_are_compared_once(spark):
    from framelake.plans import alignment

    frames = spark.createDataFrame([(s, 10 * k, k, 2, [float(k)]) for s in (1, 2) for k in range(5)], "series_id bigint, seq bigint, k bigint, middle bigint, embedding array<float>")
    got = sorted((r["ref"], r["mov"], r["least"]) for r in alignment._beside(frames).filter("series_id = 2").collect())
    assert got == [(0, 10, 15), (10, 20, 15), (20, 0, 30), (20, 10, 30), (20, 30, 15), (20, 40, 30), (30, 40, 15)]
    assert alignment._beside(frames).filter("rv[0] * 10 <> ref OR mv[0] * 10 <> mov").isEmpty()


def test_neighbours_that_both_reach_the_middle_frame_are_not_compared(spark):
    from framelake.plans import alignment, neighbourhoods

    rng = np.random.default_rng(18)
    base = rng.normal(0, 0.125, 64)
    rows = [(s, 10 * k, k, 12, (base + rng.normal(0, 0.2 if k % 7 == 3 else 0.01, 64)).tolist()) for s in (1, 2) for k in range(24)]
    frames = spark.createDataFrame(rows, "series_id bigint, seq bigint, k bigint, middle bigint, embedding array<float>")
    plain, spared = (neighbourhoods.similarities(alignment._beside(frames), "least", *head).toPandas() for head in ([], ["head"]))
    key = ["series_id", "ref", "mov"]
    left = plain.merge(spared, on=list(plain.columns), how="left", indicator=True)
    assert (left["_merge"] == "both").sum() == len(spared) and not plain.duplicated(key).any()
    good = plain[plain["inliers"] >= plain["least"]]
    reach = set(good[good["ref"] == 120][["series_id", "mov"]].itertuples(index=False, name=None))
    gone = left[left["_merge"] == "left_only"]
    assert len(gone) >= 8 and all((r.series_id, f) in reach and 120 not in (r.ref, r.mov) for r in gone.itertuples() for f in (r.ref, r.mov))
    nodes = [(s, q, k == 12) for s, q, k, *_ in rows]
    pairs = lambda found: [(r.series_id, r.mov, r.ref, np.array([[r.a, r.b, r.tx], [r.c, r.d, r.ty], [0, 0, 1]]), float(r.inliers)) for r in found[found["inliers"] >= found["least"]].itertuples()]
    same(registered(spark, nodes, pairs(spared)), plain_registration(nodes, pairs(plain)))


def test_best_share_keeps_the_best_of_all(spark):
    from framelake.operators import select

    rng = random.Random(3)
    rows = [(k, None if rng.random() < 0.1 else float(rng.randrange(40)), "x") for k in range(900)]
    df = spark.createDataFrame(rows, "id bigint, v double, __s string").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for share in (0.01, 0.1, 0.5, 0.97, 1.0):
        got = sorted(r["id"] for r in select.best_share(df, "v", "id", share).collect())
        assert got == sorted(r[0] for r in order[: max(1, int(900 * share))]), share
    assert select.best_share(df.limit(0), "v", "id").count() == 0
