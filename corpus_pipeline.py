"""A corpus pipeline of the llm operators: quality, exact dedup, near dedup, secrets, packing.

Every stage reads the five columns of ``documents`` and no others, so further columns can't clash; an empty table gives no rows; null
and empty texts pass all stages (by their score in the first); rows without a doc_id, and rows that repeat one with another text,
are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import exact_dedup, jaccard_join, packing, quality, secrets
from alertloom.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; empty texts by the labelled share of good ones."""
    scored = quality.score_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat it, one."""
    docs = docs.select(*COLUMNS)
    kept = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.withColumn("_own", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.join(kept, rows.doc_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi").dropDuplicates(["doc_id", "_own"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (linked at Jaccard 0.75 or more of 5-word shingles) the row with the smallest doc_id; rows are told apart by doc_id and text."""
    docs = docs.select(*COLUMNS)
    kept = jaccard_join.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.withColumn("_own", F.xxhash64("text"))
    return rows.join(kept, rows.doc_id.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left_semi").select(*COLUMNS)


def mask_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    return secrets.mask_secrets(docs.select(*COLUMNS))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [("quality", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secrets", mask_live_secrets), ("packing", pack_bins)]

#: SQL can't express the trained classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's rows are written once to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
