"""Importance resampling towards a target distribution by hashed n-grams.

The bucket of an n-gram is the CRC-32 of its words, joined by spaces, modulo the
number of buckets.  Each word's CRC is computed once; that of an n-gram follows
from its words' by shifts over GF(2) (:mod:`crc`), so no n-gram is ever written.

Scale: one pass adds up bucket counts inside each task and sends a row per
bucket to the driver; a second pass sums a document's gains.  Ranks come from a
range partitioning of (score, doc_id) and the row counts of its partitions, not
from one ordered task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crc

BUCKETS = 10_000
GRAMS = 1
PERCENT = 10
SEED = 2024
LEAST_WORDS = 20

#: What ends a word, after A-Z have become a-z: bytes 00-2F, 3A-60 and 7B-7F.
_BREAK = bytes(int(c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F) for c in range(256))
_SPACE = np.frombuffer(b" ", dtype=np.uint8)


def gram_buckets(texts: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``grams`` words of each text, and the texts' numbers of words."""
    raw = b"\n".join([*texts, b""]).lower()
    edge = np.frombuffer(b"\x01" + raw.translate(_BREAK) + b"\x01", dtype=np.uint8)
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = edge[::2], edge[1::2]
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    doc = np.searchsorted(text_end, start, side="right")
    words = crc.span_crcs(np.frombuffer(raw, dtype=np.uint8), start, end)
    docs, found, whole = [doc], [words % buckets], words
    if grams > 1 and len(words):
        length = end - start + 1
        spaced = crc.joined(np.full(len(words), crc.span_crcs(np.append(_SPACE, _SPACE), np.array([0]), np.array([1]))), words, length - 1)
        for n in range(2, grams + 1):
            if len(words) < n:
                break
            whole = crc.joined(whole[:-1], spaced[n - 1 :], length[n - 1 :])
            inside = doc[: len(whole)] == doc[n - 1 :]
            docs.append(doc[: len(whole)][inside])
            found.append(whole[inside] % buckets)
    return np.concatenate(docs), np.concatenate(found).astype(np.int64), np.bincount(doc, minlength=len(texts))


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``texts`` (text) per bucket."""

    def run(batches):
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            raw = common.raw_texts(batch.column("text"))
            for i, j in common.blocks(raw):
                sums += np.bincount(gram_buckets(raw[i:j], grams, buckets)[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in common.arrow_map(texts.select("text"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the smoothed log ratio of target to corpus, floored."""
    size = len(corpus)
    every, wanted = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t + 1) * every) / (float(s + 1) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text)."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            raw = common.raw_texts(batch.column("text"))
            words, features, weight = [], [], []
            for i, j in common.blocks(raw):
                doc, bucket, n = gram_buckets(raw[i:j], grams, buckets)
                order = np.argsort(doc, kind="stable") if grams > 1 else slice(None)
                many = np.bincount(doc, minlength=j - i)
                sums = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                ends = np.cumsum(many)
                words.append(n)
                features.append(many)
                weight.append(sums[ends] - sums[ends - many])
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (words, features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with rank 1, 2, 3 ... in the given order, by range partitions and their row counts."""
    spot, part = common.fresh(rows, "spot"), common.fresh(rows, "part")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = common.checkpointed(sorted_rows.withColumn(spot, F.monotonically_increasing_id()))  # the partition, then the row in it
    placed = placed.withColumn(part, F.shiftright(spot, 33))
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per partition
        offsets.append((row[0], before))
        before += row[1]
    offset = common.fresh(rows, "offset")
    table = rows.sparkSession.createDataFrame(offsets, f"{part} bigint, {offset} bigint")
    rank = F.col(offset) + F.col(spot).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(table), part).withColumn("rank", rank).drop(spot, part, offset)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its weight towards ``target`` (text), and the rank of those drawn.

    Returns doc_id, n_features, weight, score, rank, n_words.  Of the N rows with
    ``least_words`` words or more, the floor(percent * N / 100) highest scores are
    drawn without replacement (Gumbel noise from ``seed`` and doc_id); ties go to
    the smaller doc_id, then to the larger weight and more features.  A null or
    empty text has no features and weight 0.  A null doc_id is kept, its noise is
    that of an empty id, and it comes first among ties.  Repeated rows are rows
    like any others, each with a rank of its own.  A long text is one block of
    work, whose memory grows with its length.  An empty table gives no rows, and
    with an empty target all gains compare with even counts.  Other columns of
    both tables, whatever their names, are not read.
    """
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    chance = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000.0 * F.log(-F.log(chance)))
    scored = common.checkpointed(weigh(docs, gain, grams).withColumn("score", score.cast("bigint")))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(able, *order).withColumn("rank", rank).select(*columns).unionByName(rest.select(*columns))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` towards ``benchmark``: single words, 10,000 buckets, a tenth drawn."""
    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
