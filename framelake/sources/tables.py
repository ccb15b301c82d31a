"""The driver's tables as frames, series of scores, and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 frames: series_id, seq, y, x, v (double)."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select(F.col("label").alias("series_id"), F.col("vec_id").alias("seq"), F.posexplode("embedding").alias("at", "v"))
    return cells.select("series_id", "seq", F.expr(f"CAST(at DIV {SIDE} AS INT)").alias("y"), F.expr(f"CAST(at % {SIDE} AS INT)").alias("x"), F.col("v").cast("double").alias("v"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 21 colour pixels in [0, 1]: series_id, seq, p, b, g, r."""
    e = table(spark, sf_dir, "embeddings").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(20))))
    value = lambda c: ((F.element_at("embedding", F.col("p") * 3 + 1 + c).cast("double") + 1.0) / 2.0)
    return e.select(F.col("label").alias("series_id"), F.col("vec_id").alias("seq"), "p", value(0).alias("b"), value(1).alias("g"), value(2).alias("r"))


def colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 colour frames in [0, 1]; a pixel's channels are its value and the next two: series_id, seq, y, x, b, g, r."""
    n = SIDE * SIDE
    e = table(spark, sf_dir, "embeddings").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    value = lambda c: ((F.element_at("embedding", ((F.col("at") + c) % n + 1).cast("int")).cast("double") + 1.0) / 2.0)
    place = [F.expr(f"CAST(at DIV {SIDE} AS INT)").alias("y"), F.expr(f"CAST(at % {SIDE} AS INT)").alias("x")]
    return e.select(F.col("label").alias("series_id"), F.col("vec_id").alias("seq"), *place, value(0).alias("b"), value(1).alias("g"), value(2).alias("r"))


def array_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 frames in [0, 1], an array row each: series_id, seq, h, w, values (double)."""
    e = table(spark, sf_dir, "embeddings")
    unit = F.transform("embedding", lambda v: (v.cast("double") + 1.0) / 2.0)
    return e.select(F.col("label").cast("bigint").alias("series_id"), F.col("vec_id").alias("seq"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), unit.alias("values"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame scores: series_id, ts, seq (event_id), v, event_type, props."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("v"), "event_type", "props")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a value series per part: series_id, v and the order columns."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("series_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v")
    )
