"""Frame files as a Spark data source: ``spark.read.format("frames")`` and ``df.write.format("frames")``.

Reading gives a row per frame and a partition per file; writing makes a file per
name.  Executors open the files themselves, so the folder must be one that all of them
share; ``images.read_frames`` reads the same kinds from any store that Spark reads.
Files are written to a staging folder and moved at the end, so that a task that runs
twice or a job that fails leaves nothing behind but that folder.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import images, tiff

SUFFIXES = (".tif", ".tiff", ".fits", ".fit", ".fts", ".pgm", ".ppm", ".ser")


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.strict = _folder(options), options.get("mode", "").upper() == "FAILFAST"

    def partitions(self) -> list[InputPartition]:
        found = [self.folder] if os.path.isfile(self.folder) else glob.glob(f"{glob.escape(self.folder)}/**/*", recursive=True)
        return [File(p) for p in sorted(found) if p.lower().endswith(SUFFIXES)]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            content = f.read()
        rows = images.decoded(partition.path, content, 0)
        if self.strict and not rows:
            raise ValueError(f"unreadable frame file: {partition.path}")
        for path, h, w, nch, top, px in rows:
            yield (path, h, w, nch, top, px.tolist())


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.folder, self.overwrite = _folder(options), overwrite
        self.deflate = options.get("compression", "deflate").lower() != "none"
        self.columns = [f.name for f in schema]
        self.staging = f"{self.folder}/.staging-{uuid.uuid4()}"
        missing = {"name", "h", "w", "px"} - set(self.columns)
        if missing:
            raise ValueError(f"frames to write need columns {sorted(missing)}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.staging, exist_ok=True)
        names, name, pages = [], None, []

        def flush():
            if name is None:
                return
            if os.path.basename(name) != name or not name.lower().endswith((".tif", ".tiff", ".fits")):
                raise ValueError(f"a frame's name is a plain .tif or .fits file name, not {name!r}")
            raw = tiff.encode(pages, self.deflate) if name.lower().endswith((".tif", ".tiff")) else images.encode_fits(pages[0])
            part = f"{self.staging}/{name}.{uuid.uuid4()}"
            with open(part, "wb") as f:
                f.write(raw)
            names.append(os.path.basename(part))

        for row in iterator:
            got = dict(zip(self.columns, row))
            if got["name"] != name:
                flush()
                name, pages = got["name"], []
            px = np.asarray(got["px"], dtype=float).reshape(got["h"], got["w"], -1)
            if name.lower().endswith(".fits"):
                pages.append(px[..., 0] if px.shape[2] == 1 else np.moveaxis(px, 2, 0))
            else:
                px = px[..., ::-1] if px.shape[2] == 3 else px
                bits = got.get("bits") or 16
                pages.append(np.clip(np.rint(px), 0, 2**bits - 1).astype(np.uint8 if bits == 8 else np.uint16))
        flush()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [n for m in messages if m is not None for n in m.names]
        finals = [n.rsplit(".", 1)[0] for n in files]
        if len(set(finals)) != len(finals):
            self.abort(messages)
            raise ValueError("frames of one name came from several partitions; repartition by name and sort by name and page")
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.folder)}/*"):
                if old.lower().endswith(SUFFIXES):
                    os.remove(old)
        for part, final in zip(files, finals):
            os.replace(f"{self.staging}/{part}", f"{self.folder}/{final}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Frames(DataSource):
    """Options: path; mode FAILFAST (an unreadable file is an error, else it is left out); compression none or deflate.

    Rows to write: name (a file name with .tif or .fits), h, w, px (channels last, b, g, r;
    levels of the file) and maybe bits (8, or 16 as without).  Several rows of a name are the pages
    of one file: they must lie in one partition, side by side and in order.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return images.FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(self.options, schema, overwrite)


def _folder(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("frames need a path")
    return path.removeprefix("file://").rstrip("/")


def register(spark: SparkSession) -> None:
    """Make ``format("frames")`` known to the session."""
    spark.dataSource.register(Frames)
