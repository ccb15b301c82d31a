"""Image folders as series of frames: listings, decoded frames, exports."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import meta
from ..session import bounded_batches
from . import tiff

FRAME_SCHEMA = "path string, h int, w int, nch int, maxval double, px array<double>"
#: Long side in pixels, sharpening in percent, bits: fixed values of the export presets.
PRESETS = {"instagram": (1080, 40, 8), "web": (2048, 25, 8), "4k": (3840, 20, 8), "print": (0, 10, 16), "full": (0, 0, 8)}


def list_images(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """path, length, changed, series_id (the folder), seq: capture order is the order of names.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("changed"))
    files = files.filter(meta.suffix(F.col("path")).isin(suffixes or [*meta.RAW_SUFFIXES, *meta.IMAGE_SUFFIXES, *meta.FITS_SUFFIXES]))
    files = files.withColumn("series_id", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return files.withColumn("seq", F.row_number().over(Window.partitionBy("series_id").orderBy("path")) - 1)


def _fits_cards(content: bytes) -> tuple[dict[str, str], int]:
    """Cards of the first header, and where its data begin."""
    header, at, done = {}, 0, False
    while not done and at < len(content):
        for k in range(at, at + 2880, 80):
            card = content[k : k + 80].decode("ascii", "replace")
            if card.startswith("END"):
                done = True
                break
            if card[8:10] == "= ":
                value = card[10:]
                value = value.split("'")[1].strip() if value.lstrip().startswith("'") else value.split("/")[0].strip()
                header[card[:8].strip()] = value
        at += 2880
    return header, at


def fits_header(content: bytes) -> dict[str, str]:
    return _fits_cards(content)[0]


def decode_fits(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Header cards and the array (first header and data unit); 16-bit whole numbers carry BZERO and BSCALE."""
    header, at = _fits_cards(content)
    kinds = {"8": ">u1", "16": ">i2", "32": ">i4", "-32": ">f4", "-64": ">f8"}
    shape = [int(header[f"NAXIS{k}"]) for k in range(int(header.get("NAXIS", "0")), 0, -1)]
    kind = np.dtype(kinds[header["BITPIX"]])
    count = int(np.prod(shape)) if shape else 0
    data = np.frombuffer(content, dtype=kind, count=count, offset=at).astype(np.float64).reshape(shape)
    return header, np.nan_to_num(data * float(header.get("BSCALE", 1)) + float(header.get("BZERO", 0)))


def encode_fits(data: np.ndarray, cards: dict[str, str | float] | None = None) -> bytes:
    """A float32 file with the given cards."""
    data = np.asarray(data, dtype=">f4")
    head = [("SIMPLE", "T"), ("BITPIX", "-32"), ("NAXIS", str(data.ndim))]
    head += [(f"NAXIS{k + 1}", str(n)) for k, n in enumerate(reversed(data.shape))]
    head += [(k, f"'{v}'" if isinstance(v, str) else repr(float(v))) for k, v in (cards or {}).items()]
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in head) + "END".ljust(80)
    raw = data.tobytes()
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii") + raw + b"\0" * (-len(raw) % 2880)


def decode_netpbm(content: bytes) -> tuple[float, np.ndarray]:
    """The greatest value that the header allows, and the pixels of a binary PGM or PPM of 8 or 16 bits."""
    parts, at = [], 0
    while len(parts) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        parts.append(content[at:end])
        at = end
    kind = ">u2" if int(parts[3]) > 255 else "u1"
    width, height, channels = int(parts[1]), int(parts[2]), 3 if parts[0] == b"P6" else 1
    data = np.frombuffer(content, dtype=kind, count=width * height * channels, offset=at + 1).astype(np.float64).reshape(height, width, channels)
    return float(parts[3]), data[..., ::-1]


def decode_ser(content: bytes) -> np.ndarray:
    """Frames of a raw .ser video: n x h x w."""
    big, width, height, depth, count = struct.unpack_from("<5i", content, 22)
    kind = np.dtype("u1" if depth <= 8 else ("<u2" if big == 0 else ">u2"))
    return np.frombuffer(content, dtype=kind, count=width * height * count, offset=178).astype(np.float64).reshape(count, height, width)


#: Greatest values by BITPIX; files of floating-point numbers hold shares, unless a DATAMAX card says otherwise.
FITS_RANGE = {"8": 255.0, "16": 65535.0, "32": 4294967295.0}


def decoded(path: str, content: bytes, max_side: int) -> list[tuple]:
    """Rows of a file's frames.  The range comes from the header, so all frames of a series have the same."""
    name = path.lower()
    try:
        if name.endswith(tuple(meta.FITS_SUFFIXES)):
            header, data = decode_fits(content)
            top = float(header.get("DATAMAX", FITS_RANGE.get(header["BITPIX"], 1.0)))
            frames = [(path, data[..., None] if data.ndim == 2 else np.moveaxis(data, 0, -1)[..., ::-1])]
        elif name.endswith(".ser"):
            data = decode_ser(content)
            top = 255.0 if struct.unpack_from("<i", content, 34)[0] <= 8 else 65535.0
            frames = [(f"{path}#{k:06d}", x[..., None]) for k, x in enumerate(data)]
        elif name.endswith((".tif", ".tiff")):
            pages = tiff.decode(content)
            top = float(np.iinfo(pages[0].dtype).max)
            pages = [p[..., ::-1] if p.shape[2] == 3 else p for p in pages]  # b, g, r like other sources
            frames = [(path if len(pages) == 1 else f"{path}#{k:06d}", p.astype(np.float64)) for k, p in enumerate(pages)]
        else:
            top, data = decode_netpbm(content)
            frames = [(path, data)]
    except (ValueError, KeyError, IndexError, struct.error):
        return []  # an unreadable file is left out, as a camera folder may hold others
    out = []
    for frame, data in frames:
        if max_side:
            step = -(-max(data.shape[:2]) // max_side)
            h, w = data.shape[0] // step * step, data.shape[1] // step * step
            data = data[:h, :w].reshape(h // step, step, w // step, step, -1).mean(axis=(1, 3))
        out.append((frame, *(int(n) for n in data.shape), top, data.ravel()))
    return out


_DECODED = [*meta.FITS_SUFFIXES, ".tif", ".tiff", ".pgm", ".ppm", ".ser"]


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files that ``read_frames`` leaves out although it knows their kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            bad = [not decoded(p, c, 0) for p, c in zip(batch["path"], batch["content"])]
            yield batch.loc[bad, ["path", "length"]]

    return files.filter(meta.suffix(F.col("path")).isin(_DECODED)).mapInPandas(run, "path string, length bigint")


def read_frames(spark: SparkSession, folder: str, max_side: int = 0) -> DataFrame:
    """Decoded FITS, TIFF, PGM and PPM files and raw .ser videos, one row per frame; at most ``max_side`` pixels per side by whole block means.

    Files are read and decoded by executors; unreadable ones are left out, and
    ``unreadable`` lists them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    files = files.filter(meta.suffix(F.col("path")).isin(_DECODED))
    bounded_batches(spark)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [x for p, c in zip(batch["path"], batch["content"]) for x in decoded(p, c, max_side)]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "nch", "maxval", "px"])

    return files.mapInPandas(run, FRAME_SCHEMA)


def read_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """JPEG, PNG and BMP by Spark's own image source (8 bits, channels b, g, r)."""
    image = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder).select("image.*")

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame(
                {
                    "path": batch["origin"], "h": batch["height"], "w": batch["width"], "nch": batch["nChannels"], "maxval": 255.0,
                    "px": [np.frombuffer(x, dtype=np.uint8).astype(float) for x in batch["data"]],
                }
            )

    return image.mapInPandas(run, FRAME_SCHEMA)


def explode(frames: DataFrame) -> DataFrame:
    """path, y, x, c, v from decoded frames, values as shares of the range."""
    cells = frames.select("path", "w", "nch", "maxval", F.posexplode("px").alias("at", "v"))
    return cells.select("path", F.expr("at div nch div w").alias("y"), F.expr("at div nch % w").alias("x"), F.expr("at % nch").alias("c"), (F.col("v") / F.col("maxval")).alias("v"))


def write_fits(frames: DataFrame, folder: str) -> None:
    """Rows (name, h, w, px) as a table of name and FITS content, encoded by executors."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            content = [encode_fits(np.asarray(px, dtype=np.float64).reshape(h, w)) for h, w, px in zip(batch["h"], batch["w"], batch["px"])]
            yield pd.DataFrame({"name": batch["name"], "content": content})

    frames.select("name", "h", "w", "px").mapInPandas(run, "name string, content binary").write.mode("overwrite").parquet(folder)


def read_wcs(spark: SparkSession, folder: str) -> DataFrame:
    """path, h, w and the projection (functions.sky.CARDS) of the FITS files that have one; headers are read by executors."""
    from ..functions import sky

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    files = files.filter(meta.suffix(F.col("path")).isin([*meta.FITS_SUFFIXES]))
    bounded_batches(spark)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                header = fits_header(content)
                wcs = sky.wcs_of(header)
                if wcs:
                    rows.append((path, int(header.get("NAXIS2", 0)), int(header.get("NAXIS1", 0)), *(wcs[c] for c in sky.CARDS)))
            yield pd.DataFrame(rows, columns=["path", "h", "w", *sky.CARDS])

    return files.mapInPandas(run, "path string, h int, w int, " + ", ".join(f"{c} double" for c in sky.CARDS))
