"""The training-data pipeline: quality rules, exact dedup, near dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. Stages work on all that their predecessor kept. All but the last return the columns of ``documents``.

Defined results, for every stage: a null or empty text has no words and goes with the quality rules; very long texts are read and cut whole; of
copies the longest original stays, then the least doc_id, and rows without a doc_id come before the others; of near copies the least doc_id; of
rows that repeat doc_id and text one stays; several texts under one doc_id are judged apart; an empty table passes through as one; other columns,
whatever their names, are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as exact
from tessera.llm import near_dedup as near
from tessera.llm import packing, repetition, secrets
from tessera.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.keep_quality(docs.select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that the operator keeps stays."""
    return _apply(docs, exact.exact_dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return _apply(docs, near.near_duplicates(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked; no document goes. Blobs are scanned once and findings joined back to their paths."""
    ws = Workspace(spark, "pipeline-secrets")
    found = secrets.scan(docs, f"{ws.path}/ledger", ws).where(F.size("spans") > 0).select("doc_id", "blob", "spans").dropDuplicates(["doc_id", "blob"])
    found = ws.stage(found, "found")
    dirty = found.withColumnRenamed("doc_id", "at")
    same = F.col("doc_id").eqNullSafe(F.col("at")) & (F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("blob"))
    masked = docs.select(*COLUMNS).join(dirty, same, "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.mask_spans(F.col("text"), F.col("spans")))
    return masked.withColumn("text", text).withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _apply(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The kept rows of ``docs``: an anti join on the (identifier, text) pairs that go; only those travel besides the texts."""
    ws = Workspace(docs.sparkSession, "pipeline-decisions")
    counts = decisions.groupBy("doc_id", "text_tag").agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("rows"))
    gone = ws.stage(counts.where("stay < rows").select(F.col("doc_id").alias("at"), F.col("text_tag").alias("tag"), "stay"), "gone")
    tagged = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_tag"))
    same = F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("own_tag") == F.col("tag"))
    rest = tagged.join(gone.where("stay = 0"), same, "left_anti")
    repeated = gone.where("stay > 0")
    if not repeated.limit(1).count():
        return rest.select(*COLUMNS)
    # Rows that repeat an identifier and its text: one of them stays.
    again = rest.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "own_tag"])
    return rest.join(repeated, same, "left_anti").unionByName(again).select(*COLUMNS)


#: (name, function), in order.
STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Signatures, tokenisers and packing are not SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is a table in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
