"""TIFF bytes both ways, and frame files as a data source."""

import os
import struct
import zlib

import numpy as np
import pytest

from framelake.sources import files, images, tiff


def pictures():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16):
        top = np.iinfo(kind).max
        for shape in ((1, 1, 1), (7, 5, 1), (40, 61, 3), (300, 257, 1), (3, 70_000, 1), (5, 4, 4)):
            yield rng.integers(0, top + 1, shape, dtype=kind)


@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_round_trip(deflate):
    pages = list(pictures())
    for page in pages:
        (back,) = tiff.decode(tiff.encode([page], deflate))
        assert back.dtype == page.dtype and (back == page).all()
    assert all((a == b).all() for a, b in zip(tiff.decode(tiff.encode(pages, deflate)), pages, strict=True))
    assert (tiff.decode(tiff.encode([pages[1][..., 0]]))[0] == pages[1]).all()


def big_endian(page, predictor=2, photometric=1):
    """A plain writer of its own: one strip, other byte order, tags inline or at the end."""
    h, w = page.shape
    strip = np.concatenate((page[:, :1], np.diff(page, axis=1)), axis=1) if predictor == 2 else page
    raw = zlib.compress(strip.astype(">u2").tobytes())
    tags = [(256, 3, w), (257, 3, h), (258, 3, 16), (259, 3, 32946), (262, 3, photometric), (273, 4, 8), (278, 3, h), (279, 4, len(raw)), (317, 3, predictor), (305, 2, 0)]
    body = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0\0\0\0"
    return struct.pack(">2sHI", b"MM", 42, 8 + len(raw)) + raw + body


def test_tiff_of_other_writers():
    page = np.random.default_rng(2).integers(0, 65536, (9, 14), dtype=np.uint16)
    assert (tiff.decode(big_endian(page))[0][..., 0] == page).all()
    assert (tiff.decode(big_endian(page, 1))[0][..., 0] == page).all()
    assert (tiff.decode(big_endian(page, photometric=0))[0][..., 0] == 65535 - page).all()
    good = tiff.encode([page])
    for bad in (b"", b"II", b"no tiff at all", good[: len(good) // 2], good.replace(struct.pack("<HHII", 259, 3, 1, 8), struct.pack("<HHII", 259, 3, 1, 5))):
        with pytest.raises((ValueError, struct.error)):
            tiff.decode(bad)
    with pytest.raises(ValueError):
        tiff.encode([page.astype(float)])


def test_frames_as_a_data_source(spark, tmp_path):
    files.register(spark)
    folder = str(tmp_path / "out")
    rng = np.random.default_rng(3)
    colour, small = rng.integers(0, 65536, (6, 9, 3)), rng.integers(0, 256, (4, 4, 1))
    pages = [rng.integers(0, 65536, (5, 8, 1)) for _ in range(3)]
    rows = [("a.tif", 0, 6, 9, colour.ravel().astype(float).tolist(), 16), ("b.tiff", 0, 4, 4, small.ravel().astype(float).tolist(), 8), ("c.fits", 0, 5, 8, pages[0].ravel().astype(float).tolist(), None)]
    rows += [("m.tif", k, 5, 8, p.ravel().astype(float).tolist(), None) for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows[::-1], "name string, page int, h int, w int, px array<double>, bits int")
    df.repartition(3, "name").sortWithinPartitions("name", "page").write.format("frames").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["a.tif", "b.tiff", "c.fits", "m.tif"]
    with open(f"{folder}/a.tif", "rb") as f:
        assert (tiff.decode(f.read())[0] == colour[..., ::-1]).all()  # red first in the file
    back = spark.read.format("frames").load(folder)
    assert back.rdd.getNumPartitions() == 4
    got = {r["path"].rsplit("/", 1)[1]: r for r in back.collect()}
    assert sorted(got) == ["a.tif", "b.tiff", "c.fits", "m.tif#000000", "m.tif#000001", "m.tif#000002"]
    assert got["a.tif"]["px"] == rows[0][4] and got["a.tif"]["maxval"] == 65535 and got["b.tiff"]["px"] == rows[1][4] and got["b.tiff"]["maxval"] == 255
    assert all(got[f"m.tif#00000{k}"]["px"] == rows[3 + k][4] for k in range(3)) and got["c.fits"]["px"] == rows[2][4]
    everywhere = {r["path"].rsplit("/", 1)[1]: r["px"] for r in images.read_frames(spark, folder).collect()}
    assert everywhere == {k: r["px"] for k, r in got.items()}
    df.filter("name = 'b.tiff'").write.format("frames").option("compression", "none").mode("overwrite").save(folder)
    assert os.listdir(folder) == ["b.tiff"]


def test_unreadable_and_misnamed_frames(spark, tmp_path):
    files.register(spark)
    (tmp_path / "bad.tif").write_bytes(b"II*\0 no more")
    (tmp_path / "good.tif").write_bytes(tiff.encode([np.ones((2, 2), np.uint8)]))
    (tmp_path / "notes.txt").write_text("x")
    assert spark.read.format("frames").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="unreadable frame file"):
        spark.read.format("frames").option("mode", "FAILFAST").load(str(tmp_path)).count()
    assert [r["path"].rsplit("/", 1)[1] for r in images.unreadable(spark, str(tmp_path)).collect()] == ["bad.tif"]
    for name in ("../x.tif", "x.png"):
        df = spark.createDataFrame([(name, 1, 1, [1.0])], "name string, h int, w int, px array<double>")
        with pytest.raises(Exception, match="plain .tif or .fits"):
            df.write.format("frames").mode("append").save(str(tmp_path / "new"))
    assert not [n for n in os.listdir(tmp_path / "new") if not n.startswith(".")]
    split = spark.createDataFrame([("x.tif", 1, 1, [1.0])] * 2, "name string, h int, w int, px array<double>").repartition(2)
    with pytest.raises(Exception, match="several partitions"):
        split.write.format("frames").mode("append").save(str(tmp_path / "new"))
