"""A folder watcher that acts once a folder is quiet, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FILES = "path string, modificationTime timestamp, length bigint, content binary"
STATE = "files bigint, signature bigint, done bigint"
READY = "folder string, files bigint, signature bigint"


def file_stream(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """New files under ``folder``: folder, name, length.  Contents are not kept."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(folder)
    parent, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"[^/]+$", 0)
    return stream.select(parent.alias("folder"), name.alias("name"), "length")


class QuietPeriod(StatefulProcessor):
    """Per folder: how many files came and an order-free signature of them; a timer that every file sets anew; a row when it fires and the signature differs from the last one done."""

    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", STATE)

    def _read(self) -> tuple[int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        files, signature, done = self._read()
        for frame in rows:
            files += len(frame)
            signature = (signature + int(frame["mark"].astype("object").sum())) % (2**62)
        self.state.update((files, signature, done))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settle_ms)
        yield pd.DataFrame({"folder": [], "files": [], "signature": []}).astype({"folder": "object", "files": "int64", "signature": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        files, signature, done = self._read()
        if signature != done:
            self.state.update((files, signature, signature))
            yield pd.DataFrame({"folder": [key[0]], "files": [files], "signature": [signature]})

    def close(self) -> None:
        pass


def quiet_folders(files: DataFrame, settle_ms: int = 2000) -> DataFrame:
    """A row per folder each time it has been quiet for ``settle_ms`` and holds something new: folder, files, signature.

    State is three numbers per folder and lives in RocksDB.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = files.withColumn("mark", F.pmod(F.xxhash64("name", "length"), F.lit(2**40)))
    return marked.groupBy("folder").transformWithStateInPandas(QuietPeriod(settle_ms), outputStructType=READY, outputMode="Append", timeMode="ProcessingTime")


def watch(spark: SparkSession, folder: str, action: Callable[[DataFrame, int], None], checkpoint: str, settle_ms: int = 2000):
    """Start the watcher: ``action`` gets the ready folders of each micro-batch.  A changed folder is given again as a whole."""
    return quiet_folders(file_stream(spark, folder), settle_ms).writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()


def running_statistics(frames: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Count, mean and population deviation per element over a stream of frames: algebraic partial aggregates, so chunks may come in any order."""
    return frames.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
