"""Frame queries against their SQL, and invariants of the operators."""

import math
import re
import struct

import duckdb
import numpy as np
import pytest

import __spark_entry__
from framelake.functions import colour, curves, meta
from framelake.operators import combine, kernels, match, score, select, sequence
from framelake.plans import tones
from framelake.sources import images, tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not re.match(r"op\d", n)))
def test_query_equals_its_sql(spark, sf, oracle, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    want = oracle.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False)), key=str) for df in (got, want)]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 3e-5) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def series(spark, values, keys=("k",)):
    return spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")


def test_clipping_rejects_an_outlier(spark):
    df = series(spark, [1.0, 1.1, 0.9, 1.05, 0.95] * 6 + [50.0])
    means = {m: combine.combine(df, ["k"], m).first()["value"] for m in ("average", "median", "sigma", "winsor", "linearfit")}
    assert means["average"] > 2 and all(abs(means[m] - 1) < 0.01 for m in ("median", "sigma", "linearfit"))
    assert means["sigma"] < means["winsor"] < means["average"]


def test_unknown_names_raise(spark):
    with pytest.raises(ValueError):
        combine.combine(series(spark, [1]), ["k"], "mode")
    with pytest.raises(ValueError):
        colour.xyz_to_working([], "cmyk")


def test_nine_files_make_three_brackets(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(9)], "s int, i int, v double")
    assert sequence.brackets_fixed(df, ["s"], ["i"], 3).groupBy("bracket").count().filter("count = 3").count() == 3


def test_comet_equals_its_recurrence(spark):
    v = np.random.default_rng(1).random(12)
    acc = 0.0
    for x in v:
        acc = max(acc * 0.9, x)
    df = spark.createDataFrame([(1, i, float(x), 11) for i, x in enumerate(v)], "k int, i int, v double, last int")
    assert combine.comet(df, ["k"], "i", "last").first()["value"] == pytest.approx(acc)


def test_colours_survive_the_round_trip(spark):
    rgb = np.random.default_rng(0).random((16, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in rgb], "r double, g double, b double")
    for space, tolerance in (("rec2020", 1e-6), ("prophoto", 1e-5)):
        xyz = colour.apply_matrix(colour.RGB_TO_XYZ["srgb"], [df.r, df.g, df.b])
        back = colour.working_to_srgb(colour.xyz_to_working(xyz, space), space)
        assert np.abs(np.array(df.select(*back).collect()) - rgb).max() < tolerance


def test_curves_are_monotone_between_fixed_ends():
    for lut in (tones.ghs_table(256), curves.pchip([(0, 0), (0.2, 0.1), (0.8, 0.9), (1, 1)], 256)):
        assert lut[0] == pytest.approx(0, abs=1e-9) and lut[-1] == pytest.approx(1) and (np.diff(lut) >= -1e-12).all()


def test_weights_lower_the_noise(spark):
    rng = np.random.default_rng(10)
    rows = [(1, s, y, x, float(0.3 + rng.normal(0, 0.01 if s < 4 else 0.2))) for s in range(8) for y in range(12) for x in range(12)]
    px = spark.createDataFrame(rows, "series_id int, seq int, y int, x int, v double")
    keys = ["series_id", "y", "x"]
    flat = np.std([r["value"] for r in combine.average(px, keys).collect()])
    weighted = px.join(combine.noise_weights(px, ["series_id"], ["seq"]), ["series_id", "seq"])
    assert np.std([r["value"] for r in combine.average(weighted, keys, weight="weight").collect()]) < 0.95 * flat


def test_greedy_cover_equals_a_plain_loop(spark, sf):
    tiles = score.tile_sharpness(tables.pixels(spark, sf).filter("series_id = 0"), ["series_id", "seq"])
    m = tiles.toPandas().pivot(index="seq", columns="tile", values="s").to_numpy()
    peak = m.max(axis=0)
    content = peak > 0.15 * np.median(peak[peak > 0])
    good = m[:, content] / (peak[content] + 1e-9) >= 0.8
    left, order, covered = list(range(len(m))), [], np.zeros(good.shape[1], bool)
    while left and not covered.all():
        best = max(left, key=lambda i: ((good[i] & ~covered).sum(), -i))
        if not (good[best] & ~covered).any():
            break
        order.append(best)
        left.remove(best)
        covered |= good[best]
    won = np.bincount(m.argmax(axis=0)[content], minlength=len(m))
    order += sorted(left, key=lambda i: -won[i])
    got = {r["level"]: r["coverage"] for r in select.greedy_cover(tiles).collect()}
    shares = [got[level] for level in (1.0, 0.8, 0.6, 0.4)]
    assert shares == sorted(shares, reverse=True)
    assert got[0.4] == round(100 * good[order[: max(1, round(0.4 * len(m)))]].any(axis=0).mean(), 1)


def test_range_join_equals_the_theta_join(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((80, 2)) * 30, rng.random((90, 2)) * 30
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "i int, ax double, ay double")
    right = spark.createDataFrame([(j, *map(float, p)) for j, p in enumerate(b)], "j int, bx double, by double")
    got = {(r["i"], r["j"]) for r in match.range_join(left, right, [("ax", "bx"), ("ay", "by")], 2.5).collect()}
    assert got == {(i, j) for i in range(80) for j in range(90) if (np.abs(a[i] - b[j]) < 2.5).all()}


def test_offset_is_recovered_despite_fixed_points(spark):
    rng = np.random.default_rng(0)
    sky, hot = rng.random((40, 2)) * 300, rng.random((5, 2)) * 300
    ref, mov = np.vstack((sky, hot)), np.vstack((sky - (12, -18), hot))
    frame = lambda p: spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)], "id int, x double, y double")
    found = match.offset_vote(frame(ref), frame(mov)).first()
    assert abs(found["dx"] - 12) < 1.5 and abs(found["dy"] + 18) < 1.5


def test_kernels():
    rng = np.random.default_rng(4)
    x = rng.random((16, 20))
    assert np.allclose(kernels.collapse(kernels.pyramid(x, 2)), x)
    bands, rest = kernels.atrous(x, 3)
    assert np.allclose(sum(bands) + rest, x)
    assert kernels.phase_shift(x, np.roll(x, (2, -3), axis=(0, 1))) == (-2, 3)
    assert np.allclose(kernels.affine(x, np.eye(3)[:2]), x)
    assert np.allclose(kernels.drizzle(np.stack([x, x]), [(0, 0), (0, 0)], 1, 1.0), x)
    mask = np.zeros((6, 7), bool)
    mask[1:5, 2:6] = True
    assert kernels.largest_rectangle(mask) == (1, 2, 4, 4)
    mask[0, 0] = True
    assert len(np.unique(kernels.components(mask))) == 3
    points = rng.random((10, 2)) * 10
    assert np.allclose(kernels.thin_plate(points, points @ [2.0, 3.0] + 1, points), points @ [2.0, 3.0] + 1)
    angle = math.radians(35)
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    moved = points @ turn.T + (5, -2)
    moved[0] += 40
    m, good = kernels.ransac(points, moved)
    assert not good[0] and good[1:].all() and np.allclose(m[:, :2], turn)
    h = kernels.homography(points[:6], points[:6] * 2 + 1)
    assert np.allclose(h, [[2, 0, 1], [0, 2, 1], [0, 0, 1]])
    sharp, soft = x.copy(), kernels.blur(x, 2.0)
    assert np.abs(kernels.pyramid_merge(np.stack([sharp, soft])) - sharp).mean() < np.abs(kernels.pyramid_merge(np.stack([soft, soft])) - sharp).mean()
    assert (kernels.tree_merge(np.stack([x * k for k in (1, 3, 2)]), np.maximum) == 3 * x).all()


def test_series_map_over_chunks(spark, sf):
    px = tables.pixels(spark, sf).filter("series_id < 2")
    got = kernels.series_map(px, ["series_id"], "seq", lambda s: kernels.tree_merge(s, np.maximum), most=5)
    want = px.groupBy("series_id", "y", "x").max("v")
    assert {(r[0], r[1], r[2], r[3]) for r in got.select("series_id", "y", "x", "v").collect()} == {tuple(r) for r in want.collect()}


def test_fits_and_pixmaps(spark, tmp_path):
    data = np.arange(24.0).reshape(4, 6) / 24
    header, back = images.decode_fits(images.encode_fits(data, {"FILTER": "Ha", "RA": 10.5}))
    assert header["FILTER"] == "Ha" and float(header["RA"]) == 10.5 and np.allclose(back, data, atol=1e-6)
    folder = tmp_path / "series"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.fits").write_bytes(images.encode_fits(data + k / 10))
        (folder / f"p{k}.pgm").write_bytes(b"P5\n# c\n6 4\n65535\n" + (data * 65535).astype(">u2").tobytes())
    (folder / "broken.fits").write_bytes(b"no header")
    (folder / "notes.txt").write_text("x")
    frames = images.read_frames(spark, str(folder))
    assert frames.count() == 6
    px = images.explode(frames.filter("path like '%p1.pgm'")).collect()
    assert np.allclose(sorted(r["v"] for r in px), sorted(data.ravel()), atol=1e-4)
    listed = images.list_images(spark, str(folder)).orderBy("seq").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["broken.fits", "f0.fits", "f1.fits", "f2.fits"]
    half = images.read_frames(spark, str(folder), max_side=3).filter("path like '%f0.fits'").first()
    assert (half["h"], half["w"]) == (2, 3)


def test_ranges_come_from_headers(spark, tmp_path):
    """Dark and bright frames of one series have one range; a .ser video gives a row per frame."""
    for name, value in (("dark", 200), ("bright", 300)):
        (tmp_path / f"{name}.pgm").write_bytes(b"P5\n3 2\n65535\n" + np.full(6, value, ">u2").tobytes())
    video = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    (tmp_path / "v.ser").write_bytes(b"LUCAM-RECORDER" + struct.pack("<7i", 0, 0, 0, 4, 3, 16, 2).ljust(164, b"\0") + video.tobytes())
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.read_frames(spark, str(tmp_path)).collect()}
    assert {k: r["maxval"] for k, r in rows.items()} == {"dark.pgm": 65535.0, "bright.pgm": 65535.0, "v.ser#000000": 65535.0, "v.ser#000001": 65535.0}
    assert rows["v.ser#000001"]["px"] == list(range(12, 24)) and (rows["v.ser#000001"]["h"], rows["v.ser#000001"]["w"]) == (3, 4)


def test_versions_and_numbers(spark):
    df = spark.createDataFrame([("v1.10", "1.9.9"), ("1.2", "1.2.0")], "a string, b string")
    assert [r[0] for r in df.select(meta.version_key(df.a) > meta.version_key(df.b)).collect()] == [True, False]
    n = spark.createDataFrame([("28/10",), ("50 mm",), ("none",), ("1/0",)], "t string")
    assert [r[0] for r in n.select(meta.number(n.t)).collect()][:3] == [2.8, 50.0, None]


@pytest.mark.parametrize("name", ["pyramid_merge", "wavelet_merge", "envelope_merge"])
def test_merges_are_over_all_frames_at_once(spark, sf, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    px = tables.pixels(spark, sf).toPandas()
    for k, rows in px.groupby("series_id"):
        seqs = np.sort(rows["seq"].unique())
        stack = np.zeros((len(seqs), 8, 8))
        stack[np.searchsorted(seqs, rows["seq"]), rows["y"], rows["x"]] = (rows["v"] + 1) / 2
        one = got[got["series_id"] == k]
        out = np.full((8, 8), np.nan)
        out[one["y"], one["x"]] = one["v"]
        assert len(seqs) > 16 and len(one) == 64 and np.abs(out - getattr(kernels, name)(stack)).max() < 2e-6


def test_triangles_match_despite_turn_and_scale():
    rng = np.random.default_rng(5)
    d, e = rng.random((300, 2)), rng.random((400, 2))
    far = np.hypot(*np.moveaxis(d[:, None] - e[None], 2, 0))
    assert (kernels.nearest_within(d, e, 0.02) == np.where(far.min(axis=1) <= 0.02, far.argmin(axis=1), -1)).all()
    ref = rng.random((64, 2)) * 100
    order = rng.permutation(60)
    mov = 1.3 * ref[order] @ np.array([[0.8, -0.6], [0.6, 0.8]]) + (4, -9)
    i, j = kernels.match_triangles(ref, mov)
    assert len(j) == 60 and (order[j] == i).all()


def test_registration_covers_all_frames(spark, sf, tmp_path):
    tables.table(spark, sf, "embeddings").filter("vec_id < 50").write.parquet(str(tmp_path / "embeddings.parquet"))
    e = tables.table(spark, str(tmp_path), "embeddings").select("label", "vec_id").toPandas().sort_values(["label", "vec_id"])
    want = {(k, *p) for k, rows in e.groupby("label") for p in zip(rows["vec_id"], rows["vec_id"][1:])}
    got = __spark_entry__.queries()["robust_registration"](spark, str(tmp_path)).toPandas()
    assert {tuple(x) for x in got[["series_id", "ref", "mov"]].itertuples(index=False)} == want and len(got) == len(want)
    assert (got["inliers"] >= 3).mean() > 0.9


def test_pair_graph_reaches_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(55)], "i bigint, j bigint, factor double")
    assert {(r["node"], r["depth"]) for r in match.pair_graph(edges).collect()} == {(i, i) for i in range(56)}


def test_background_leaves_a_nebula():
    from framelake.plans import neighbourhoods

    yy, xx = np.mgrid[0:16, 0:16] / 16
    sky = 0.2 + 0.1 * xx + 0.05 * yy
    nebula = np.zeros((16, 16))
    nebula[6:10, 6:10] = 0.4
    out = neighbourhoods._surface(sky + nebula)
    ring = nebula == 0
    assert np.abs(out[ring] - np.median(sky)).max() < 0.02
    assert np.abs(out[~ring] - np.median(sky) - 0.4).max() < 0.02


def test_median_vote_drops_a_lone_winner():
    winner = np.full((5, 5), 3)
    winner[2, 2] = 300
    assert (kernels.median_vote(winner) == 3).all()


def test_all_rounds_of_sample_consensus_are_judged_at_once(monkeypatch):
    rng = np.random.default_rng(11)
    src = rng.uniform(0, 100, (50, 2))
    dst = 1.1 * src @ np.array([[0.8, -0.6], [0.6, 0.8]]) + (3, -2) + rng.normal(0, 0.1, (50, 2))
    dst[:15] += rng.uniform(20, 60, (15, 2))
    src[40] = src[41]  # two points that are one fit nothing
    want = np.zeros(50, dtype=bool)
    picks = np.random.default_rng(7)
    for _ in range(200):
        pick = picks.choice(50, 2, replace=False)
        m = kernels.fit_affine(src[pick], dst[pick])
        good = np.hypot(*(src @ m[:, :2].T + m[:, 2] - dst).T) < 1.0
        want = good if good.sum() > want.sum() else want
    fits, fit = [], kernels.fit_affine
    monkeypatch.setattr(kernels, "fit_affine", lambda *a: fits.append(1) or fit(*a))
    m, good = kernels.ransac(src, dst, 1.0)
    assert (good == want).all() and np.array_equal(m, fit(src[want], dst[want])) and len(fits) < 10


def test_nearest_among_copies_is_the_first():
    rng = np.random.default_rng(12)
    points = np.repeat(rng.random((40, 2)) * 0.02 + 0.4, 5, axis=0)[rng.permutation(200)]
    queries = np.concatenate((points[::3], rng.random((60, 2))))
    far = np.hypot(*np.moveaxis(queries[:, None] - points[None], 2, 0))
    assert (kernels.nearest_within(queries, points, 0.02) == np.where(far.min(axis=1) <= 0.02, far.argmin(axis=1), -1)).all()


def test_nearest_on_grids_far_outside_and_at_the_edge_of_reach():
    rng = np.random.default_rng(13)
    for kind in range(60):
        points, queries = rng.random((rng.integers(1, 300), 2)), rng.random((rng.integers(1, 300), 2))
        points, queries = [(points, queries * 3 - 1), (np.round(points, 2), np.round(queries, 2)), (np.round(points * 0.03, 3) + 0.5, np.round(queries * 0.06, 3) + 0.48)][kind % 3]
        reach = (0.02, 0.05, 0.3)[kind // 3 % 3]
        far = np.hypot(*np.moveaxis(queries[:, None] - points[None], 2, 0))
        assert (kernels.nearest_within(queries, points, reach) == np.where(far.min(axis=1) <= reach, far.argmin(axis=1), -1)).all()


def test_triangles_of_a_frame_are_found_once_for_its_pairs(monkeypatch):
    rng = np.random.default_rng(14)
    frames, found, descriptors = rng.random((5, 20, 2)) * 100, [], kernels.descriptors
    monkeypatch.setattr(kernels, "descriptors", lambda points: found.append(1) or descriptors(points))
    for k in range(1, 5):
        for ref in (0, k - 1):
            kernels.match_triangles(frames[ref], frames[k])
    assert len(found) == 5
    corners = descriptors(np.array([[0.0, 0.0], [3.0, 0.0], [0.0, 4.0], [7.0, 1.0]]))[2]
    assert corners[:, 0].tolist() == [2, 1, 0]  # opposite to sides of 3, 4 and 5


def test_nearest_of_points_that_singles_cannot_tell_apart():
    rng = np.random.default_rng(15)
    for spread in (1e-12, 1e-9, 1e-7, 1e-5):
        points = np.repeat(rng.random((60, 2)), 6, axis=0) + rng.normal(0, spread, (360, 2))
        for offset in (0.0, 1e4):
            queries = np.concatenate((points[::5] + rng.normal(0, spread, (72, 2)), rng.random((400, 2)))) + offset
            far = np.hypot(*np.moveaxis(queries[:, None] - (points + offset)[None], 2, 0))
            assert (kernels.nearest_within(queries, points + offset, 0.02) == np.where(far.min(axis=1) <= 0.02, far.argmin(axis=1), -1)).all()


def test_nearest_in_crowded_and_empty_rows():
    rng = np.random.default_rng(16)
    line = np.stack((rng.random(900), np.full(900, 0.5)), axis=1)
    heap = rng.normal(0.3, 2e-4, (900, 2))
    few = rng.random((40, 2))
    for points in (line, heap, few, np.concatenate((line, heap, few)), line[:, ::-1], line[:1]):
        queries = np.concatenate((points + rng.normal(0, 1e-3, points.shape), rng.random((300, 2)) * 1.2 - 0.1, rng.random((5, 2)) * 1e6))
        far = np.hypot(*np.moveaxis(queries[:, None] - points[None], 2, 0))
        assert (kernels.nearest_within(queries, points, 0.02) == np.where(far.min(axis=1) <= 0.02, far.argmin(axis=1), -1)).all()


def test_most_triangles_find_their_nearest_without_discs(monkeypatch):
    rng = np.random.default_rng(17)
    k, asked, found, pick, descriptors = np.arange(60), [], [], kernels._pick, kernels.descriptors
    frame = lambda: np.stack((k * 37 % 101 + 4 * rng.normal(0, 0.125, 60).astype("float32").astype(float), k * 53 % 97), axis=1)
    a, b = frame(), frame()
    monkeypatch.setattr(kernels, "_pick", lambda x, *more: asked.append(len(x)) or pick(x, *more))
    monkeypatch.setattr(kernels, "descriptors", lambda points: found.append(descriptors(points)) or found[-1])
    i, j = kernels.match_triangles(a, b + (7.5, -7.5))
    assert sum(asked) < 0.4 * len(found[0][0])
    kernels.match_triangles(b, a + (7.5, -7.5))
    assert len(found) == 2  # a frame that was moved has the triangles it had
    (rx, ry, _), (mx, my, _) = found
    some = slice(None, None, 60)
    near = np.hypot(rx[some, None] - mx, ry[some, None] - my).argmin(axis=1)
    assert (kernels.nearest_within(np.stack((rx, ry), axis=1), np.stack((mx, my), axis=1), 0.02)[some] == near).all() and len(i) >= 30


def test_two_nearest_in_blocks_match_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(21)
    a, b = rng.normal(0, 1, (70, 8)).astype("float32"), rng.normal(0, 1, (90, 8)).astype("float32")
    b[40:] = b[:50]  # copies: the smaller id of equals
    a[5] = b[3]
    monkeypatch.setattr(match, "BLOCK", 7)
    rows = lambda v, q, x: spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)] + [(500, None)], f"{q} bigint, {x} array<float>").repartition(3)
    got = {r["q"]: r for r in match.two_nearest(rows(a, "q", "qv"), rows(b, "i", "iv")).collect()}
    far = np.sqrt(((a[:, None].astype(float) - b[None].astype(float)) ** 2).sum(axis=2))
    assert sorted(got) == list(range(70))
    for k, d in enumerate(far):
        first, second = np.lexsort((np.arange(90), d.round(12)))[:2]
        assert got[k]["best"] == first and got[k]["d1"] == pytest.approx(d[first]) and got[k]["d2"] == pytest.approx(d[second])
    mutual = match.mutual_match(rows(a, "q", "qv"), rows(b, "q", "qv"))
    plan = mutual._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and mutual.count() == sum(far[:, far[k].argmin()].argmin() == k for k in range(70))
    one = match.two_nearest(rows(a, "q", "qv"), rows(b[:1], "i", "iv"))
    assert one.filter("best = 0 AND d2 IS NULL").count() == 70


def test_stacks_of_frames_give_what_each_frame_gives(spark):
    """Frames of two sizes and with a gap, in one batch; no Python group per frame."""
    from framelake.operators import fusion

    rng = np.random.default_rng(31)
    frames = {(s, k): rng.random((h, w)) for s, h, w in ((1, 9, 8), (2, 16, 11)) for k in range(5)}
    rows = [(s, k, y, x, float(v)) for (s, k), f in frames.items() for (y, x), v in np.ndenumerate(f) if (s, k, y, x) != (2, 3, 4, 4)]
    frames[2, 3][4, 4] = 0
    px = spark.createDataFrame(rows, "series_id int, seq bigint, y int, x int, v double").repartition(3)
    out = kernels.frame_map(px, ["series_id", "seq"], fusion.background_surface, stacked=True)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas()
    bands = kernels.band_rows(px, ["series_id"], "seq", kernels._pyramid_bands(2)).toPandas()
    for (s, k), f in frames.items():
        one = got[(got["series_id"] == s) & (got["seq"] == k)]
        image = np.full(f.shape, np.nan)
        image[one["y"], one["x"]] = one["value"]
        assert len(one) == f.size and np.allclose(image, fusion.background_surface(f), atol=1e-12)
        for b, (want, energy) in enumerate(kernels._pyramid_bands(2)(f)):
            one = bands[(bands["series_id"] == s) & (bands["seq"] == k) & (bands["band"] == b)].sort_values(["y", "x"])
            assert np.allclose(one["v"], want.ravel(), atol=1e-12) and np.allclose(one["energy"], energy.ravel(), atol=1e-12)
