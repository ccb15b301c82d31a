"""Session helpers: lineage, and the size of Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch for Python.  One value for texts and frames alike, so the order of calls doesn't matter.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which long texts and large frames would otherwise fill without limit."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that all executors share, which ``spark.checkpoint.dir`` names.

    Where that is unset, a session on one machine takes a folder of its own; on a
    cluster that would be a folder no other executor sees, so it is an error there.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in that folder, read again.

    Unlike a checkpoint it comes with its true size, where the estimates of loops
    that join their own results would square in every round.
    """
    path = f"{_shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = "/tmp/checkpoints/framelake"
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()
