import time

import pytest

from framelake.operators import combine
from framelake.sources import tables
from framelake.streaming import watch


def test_quiet_folders_are_given_once_per_change(spark, tmp_path):
    folder = tmp_path / "in" / "series"
    folder.mkdir(parents=True)
    for k in range(3):
        (folder / f"{k}.fits").write_bytes(b"x" * (k + 1))
    seen = []
    query = watch.watch(spark, str(tmp_path / "in"), lambda df, _: seen.extend(r["files"] for r in df.collect()), str(tmp_path / "checkpoint"), settle_ms=500)
    try:
        until = time.time() + 90
        while not seen and time.time() < until and query.isActive:
            time.sleep(0.5)
        assert seen == [3], query.exception()
        (folder / "3.fits").write_bytes(b"more")
        while len(seen) < 2 and time.time() < until and query.isActive:
            time.sleep(0.5)
        assert seen == [3, 4], query.exception()
    finally:
        query.stop()


def test_running_statistics_equal_the_batch(spark, sf, tmp_path):
    px = tables.pixels(spark, sf).filter("series_id < 2")
    px.repartition(3).write.parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "px"))
    keys = ["series_id", "y", "x"]
    query = watch.running_statistics(stream, keys).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {tuple(r[k] for k in keys): r["mean"] for r in spark.table("stats").collect()}
    for r in combine.average(px, keys).collect():
        assert got[tuple(r[k] for k in keys)] == pytest.approx(r["value"])
