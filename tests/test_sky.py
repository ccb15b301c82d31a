"""Projections both ways, catalogues on frames, and colour gains of known stars."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import sky as projection
from framelake.operators import sky
from framelake.sources import images

FRAME = "frame bigint, h int, w int, " + ", ".join(f"{c} double" for c in projection.CARDS)


def view(k, ra, dec, turn=0.3, scale=0.01):
    return (k, 400, 600, float(ra), float(dec), 300.5, 200.5, -scale * math.cos(turn), scale * math.sin(turn), scale * math.sin(turn), scale * math.cos(turn))


def plain(ra, dec, v):
    """Pixels by unit vectors: the tangent plane's axes instead of formulas in angles."""
    _, _, _, ra0, dec0, px, py, a, b, c, d = v
    unit = lambda r, t: np.array([math.cos(t) * math.cos(r), math.cos(t) * math.sin(r), math.sin(t)])
    r0, d0 = math.radians(ra0), math.radians(dec0)
    n, east = unit(r0, d0), np.array([-math.sin(r0), math.cos(r0), 0])
    p = unit(math.radians(ra), math.radians(dec))
    if p @ n <= 1e-9:
        return None
    xi, eta = np.degrees(p @ east / (p @ n)), np.degrees(p @ np.cross(n, east) / (p @ n))
    u = np.linalg.solve([[a, b], [c, d]], [xi, eta])
    return u[0] + px - 1, u[1] + py - 1


VIEWS = [view(k, ra, dec) for k, (ra, dec) in enumerate([(0.5, 10), (359.9, -45), (120, 89.5), (200, -89.9), (83.8, -5.4)])]


def test_round_trip_stays_below_a_millionth_of_a_pixel(spark):
    df = spark.createDataFrame(VIEWS, FRAME).withColumn("x", F.explode(F.array(*map(F.lit, (0.0, 123.25, 599.0))))).withColumn("y", F.explode(F.array(*map(F.lit, (0.0, 77.5, 399.0)))))
    ra, dec = projection.to_sky(F.col("x"), F.col("y"))
    df = df.withColumns({"ra": ra, "dec": dec})
    x2, y2 = projection.to_pixel(F.col("ra"), F.col("dec"))
    rows = df.withColumns({"x2": x2, "y2": y2}).collect()
    assert len(rows) == 45
    for r in rows:
        assert abs(r["x"] - r["x2"]) < 1e-6 and abs(r["y"] - r["y2"]) < 1e-6 and 0 <= r["ra"] < 360
        x, y = plain(r["ra"], r["dec"], VIEWS[r["frame"]])
        assert abs(r["x"] - x) < 1e-6 and abs(r["y"] - y) < 1e-6


def test_catalogue_on_frames_near_seams_and_poles(spark):
    rng = random.Random(1)
    stars = [(k, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1))), "c") for k in range(3000)]
    for k, v in enumerate(VIEWS):
        stars += [(10_000 + 100 * k + n, (v[3] + rng.uniform(-3, 3) / max(0.01, math.cos(math.radians(v[4])))) % 360, max(-90.0, min(90.0, v[4] + rng.uniform(-2.5, 2.5))), "c") for n in range(100)]
    stars.append((99_999, None, 1.0, "c"))
    df = spark.createDataFrame(stars, "id bigint, ra double, dec double, w_ string")
    got = {(r["frame"], r["id"]): (r["x"], r["y"]) for r in sky.on_frames(df, spark.createDataFrame([*VIEWS, (9, 400, 600, *[None] * 8)], FRAME), ["frame"], 3.7).collect()}
    want = {}
    for v in VIEWS:
        for i, ra, dec, _ in stars[:-1]:
            p = plain(ra, dec, v)
            if p and -0.5 <= p[0] < 599.5 and -0.5 <= p[1] < 399.5:
                want[v[0], i] = p
    assert got.keys() == want.keys() and len(want) > 300
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_named_stars_and_gains(spark):
    v = VIEWS[4]
    rng, catalogue, own = random.Random(3), [], []
    for k in range(60):
        x, y = 20 + 60 * (k % 10) + rng.uniform(-5, 5), 30 + 60 * (k // 10) + rng.uniform(-5, 5)
        catalogue.append((k, x, y))
        for n, (c, gain) in enumerate((("b", 0.8), ("g", 1.0), ("r", 1.25))):
            own.append((4, 3 * k + n, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1), c, 100.0 / gain * (5 if k % 15 == 0 else 1)))
    own.append((4, 999, 5.0, 395.0, "g", 1.0))
    places = spark.createDataFrame([(k, *v[1:], x, y) for k, x, y in catalogue], FRAME.replace("frame", "star") + ", x double, y double")
    ra, dec = projection.to_sky(F.col("x"), F.col("y"))
    table = places.select("star", ra.alias("ra"), dec.alias("dec"), F.lit(100.0).alias("bright"))
    shown = sky.on_frames(table, spark.createDataFrame([v], FRAME), ["frame"], 3.7)
    named = sky.named_stars(shown, spark.createDataFrame(own, "frame bigint, id bigint, x double, y double, channel string, flux double"), ["frame"], "star")
    rows = named.collect()
    assert len(rows) == 180 and all(r["star"] == r["id"] // 3 and r["distance"] < 1.5 for r in rows)
    gains = {r["channel"]: r["gain"] for r in sky.colour_gains(named.join(table.select("star", "bright"), "star"), ["frame"], "bright").collect()}
    assert gains == {"b": pytest.approx(0.8), "g": pytest.approx(1.0), "r": pytest.approx(1.25)}
    assert sky.colour_gains(named.limit(5).join(table.select("star", "bright"), "star"), ["frame"], "bright").count() == 0


def test_projections_from_headers(spark, tmp_path):
    cards = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": 83.8, "CRVAL2": -5.4, "CRPIX1": 30.0, "CRPIX2": 20.0}
    cd = projection.wcs_of({**{k: str(v) for k, v in cards.items()}, "CDELT1": "-0.01", "CDELT2": "0.01", "CROTA2": "30"})
    assert cd["cd11"] == pytest.approx(-0.01 * math.cos(math.radians(30))) and cd["cd12"] == pytest.approx(-0.01 * math.sin(math.radians(30))) and cd["cd21"] == pytest.approx(-0.01 * math.sin(math.radians(30)))
    assert projection.wcs_of({**cards, "CDELT1": "-0.01"}) is None and projection.wcs_of({**cards, "CTYPE1": "GLON-CAR"}) is None and projection.wcs_of({}) is None
    assert projection.wcs_of({**cards, "CD1_1": "0", "CD2_2": "1"}) is None
    for name, extra in (("a", {"CD1_1": -0.01, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.01}), ("b", {"PC1_1": 1.0, "PC2_2": 1.0, "CDELT1": 0.02, "CDELT2": 0.02}), ("c", {})):
        (tmp_path / f"{name}.fits").write_bytes(images.encode_fits(np.ones((40, 60)), cards | extra))
    (tmp_path / "d.fits").write_bytes(images.encode_fits(np.ones((4, 6))))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.read_wcs(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.fits", "b.fits"] and rows["a.fits"]["h"] == 40 and rows["b.fits"]["cd11"] == 0.02 and rows["a.fits"]["crval2"] == -5.4
