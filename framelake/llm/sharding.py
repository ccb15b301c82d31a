"""Longest-processing-time sharding of groups that must stay together.

Scale: the driver holds a heap over a bounded number of items only.  A group
with at least 1/(shards * LARGE) of all bytes is an item of its own, so there
are at most shards * LARGE of these.  All smaller groups are dealt by hash into
LEVELS sets of BUNDLES bundles whose sizes halve from set to set; a bundle is
an item.  Longest first, least-loaded shard first: the last items placed are the
tiny bundles, which level the shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LARGE = 256
LEVELS = 8
BUNDLES = 512
#: Rows of one (shard, part) cell in which slots are counted in one task, on average.
CELL_ROWS = 20_000
ROW_COST = 16


def longest_first(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """LPT: items (size, name) by falling size go to the least-loaded shard; ties by name, then shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard; equal texts share one.

    Returns doc_id, size, text_crc32, shard, slot.  A null text counts as the
    empty one (size 16, crc32 0) and is grouped with it.  A null doc_id is kept
    and sorted first.  Repeated rows are rows like any others: each gets a slot.
    Slots are gapless from 0 within a shard, in order of (part, doc_id).  An
    empty table gives an empty result.  A group larger than a shard's share
    stays whole, as it must: that shard is then larger than the others.  Groups of
    one size are placed in the order of their texts' MD5.  Only sizes and digests of
    texts move, so a long text costs no more than its digest; other columns are not read.
    """
    spark = docs.sparkSession
    text = common.null_safe_text().cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_COST).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("group"),
    )
    coin = F.xxhash64("group")
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):  # level k holds 2**-(k+1) of the hashes, the last the rest
        level = F.when(F.pmod(coin, F.lit(1 << (k + 1))) == (1 << k), F.lit(k)).otherwise(level)
    bundle = F.concat(F.lit("~"), level, F.lit("/"), F.pmod(F.shiftright(coin, 20), F.lit(BUNDLES)))

    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    totals = groups.agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).first()
    all_bytes, n = totals["b"] or 0, totals["n"] or 0
    bound = max(1, all_bytes // (shards * LARGE))
    items = [
        (r["bytes"], r["item"])
        for r in groups.withColumn("item", F.when(F.col("bytes") >= bound, F.col("group")).otherwise(bundle))
        .groupBy("item")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # at most shards * LARGE + LEVELS * BUNDLES rows
    ]
    placed = longest_first(items, shards)
    where = spark.createDataFrame([(k, v) for k, v in placed.items()], "item string, shard int")
    large = where.filter(~F.col("item").startswith("~")).withColumnsRenamed({"item": "group", "shard": "own"})
    rest = where.filter(F.col("item").startswith("~")).withColumnsRenamed({"item": "bundle", "shard": "with"})

    parts = max(1, -(-n // (shards * CELL_ROWS)))
    cell = rows.withColumn("bundle", bundle).join(F.broadcast(large), "group", "left").join(F.broadcast(rest), "bundle", "left")
    cell = cell.select(
        "doc_id", "size", "text_crc32",
        F.coalesce("own", "with").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts * 8)).cast("int").alias("part"),
    )
    counts = cell.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("in_cell"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    numbered = cell.withColumn("rank", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Law ``bytes``: equal texts together, shard sizes as near as LPT brings them."""
    out = assign(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
