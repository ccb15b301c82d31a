"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Stages but the last return the columns of their input, whatever their names; only
text and n_chars change.  A null doc_id is kept like any other row: lines and near-duplicates
of it are not compared.  Repeated rows and rows that share an id are one document for
line dedup and near-dedup.  Texts are worked on whole.  An empty table passes through
all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, common, decontaminate, langid, lines, neardup

#: Line dedup judges every line with a word; ``op2_line_dedup`` leaves out shorter ones, as its SQL does.
LEAST_WORDS = 1
#: Near-duplicates share 80 % of their five-word shingles.
SHINGLE_WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts and texts without a letter go.  Languages are learned from this table's own rows, ties go to the first by name."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; n_chars follows the text.

    A document that loses all its text goes: earlier ones hold every line of it.
    """
    out = lines.dedup_lines(docs, least=LEAST_WORDS, counts=False, keep_emptied=False)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id; documents without a word are in no group."""
    return neardup.keep_first(docs, SHINGLE_WORDS, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; with an empty benchmark, all."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, for every row; a null text has no tokens."""
    out = bpe.encode_decode(docs)
    return out.selectExpr(
        "doc_id", "CAST(octet_length(ids) / 4 AS BIGINT) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256"
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the learned language profiles or the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each cut off from the plan of those before."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.checkpointed(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
