"""Retrieval and answer metrics, sampling and split checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_answer
from .staging import staged


def case_metrics(cases: DataFrame, retrieved: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Per case: recall, reciprocal rank and nDCG at each k. Cases nobody answered score 0.

    ``cases`` (case_id, category), ``retrieved`` (case_id, doc, rank from 1), ``relevant`` (case_id, doc), distinct.
    """
    retrieved = staged(retrieved.select("case_id", "doc", "rank"), "retrieved")  # top-k rows, read twice
    sizes = relevant.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = retrieved.join(relevant, ["case_id", "doc"])
    at = []
    for k in ks:
        inside = F.col("rank") <= k
        at += [F.count_if(inside).alias(f"hits_{k}"), F.min(F.when(inside, F.col("rank"))).alias(f"first_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}")]
    scored = cases.join(sizes, "case_id").join(hits.groupBy("case_id").agg(*at), "case_id", "left")
    answered = retrieved.select("case_id").distinct().withColumn("answered", F.lit(True))
    scored = scored.join(answered, "case_id", "left")
    out = [F.col("case_id"), F.col("category"), F.coalesce("answered", F.lit(False)).alias("answered")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [
            F.coalesce(F.col(f"hits_{k}") / F.col("n_relevant"), F.lit(0.0)).alias(f"recall_{k}"),
            F.coalesce(1 / F.col(f"first_{k}"), F.lit(0.0)).alias(f"rr_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return scored.select(*out)


def summary(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Macro averages per category and over all (category null), with the count of unanswered cases: one pass."""
    return metrics.rollup("category").agg(F.count(F.lit(1)).alias("cases"), F.count_if(~F.col("answered")).alias("missing"), *(F.round(F.avg(n), 6).alias(n) for n in names))


def answer_scores(answers: DataFrame) -> DataFrame:
    """(case_id, candidate_id, prediction, expected) to per case exact match and best token F1 over its candidates."""
    p, e = normal_answer(F.col("prediction")), normal_answer(F.col("expected"))
    rows = answers.select("case_id", "candidate_id", p.alias("p"), e.alias("e"))
    bag = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    sized = rows.withColumns({"np": F.size(bag("p")), "ne": F.size(bag("e"))})
    words = lambda c, n: rows.select("case_id", "candidate_id", F.explode(bag(c)).alias("w")).groupBy("case_id", "candidate_id", "w").agg(F.count(F.lit(1)).alias(n))
    both = words("p", "a").join(words("e", "b"), ["case_id", "candidate_id", "w"]).groupBy("case_id", "candidate_id").agg(F.sum(F.least("a", "b")).alias("both"))
    f1 = F.when((F.col("np") > 0) & (F.col("ne") > 0) & (F.col("both") > 0), 2.0 * F.col("both") / (F.col("np") + F.col("ne"))).otherwise(0.0)
    per = sized.join(both, ["case_id", "candidate_id"], "left").select("case_id", (F.col("p") == F.col("e")).cast("int").alias("em"), f1.alias("f1"))
    return per.groupBy("case_id").agg(F.max("em").alias("exact_match"), F.round(F.max("f1"), 6).alias("token_f1"))


def nearest_rank(column: str, p: float) -> Column:
    """The element numbered max(1, ceil(p n)) of the sorted values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def latency_summary(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(column).alias("n"), F.round(nearest_rank(column, 0.5), 6).alias("p50"), F.round(nearest_rank(column, 0.95), 6).alias("p95"),
        F.round(F.avg(column), 6).alias("mean"), F.round(F.min(column), 6).alias("least"), F.round(F.max(column), 6).alias("most"),
    )


def stratified_sample(cases: DataFrame, limit: int, seed: str) -> DataFrame:
    """One case per category in turn, both in an order fixed by a seeded hash, up to ``limit`` (the sampling feature)."""
    key = F.sha2(F.concat_ws("\0", F.lit(seed), F.col("category").cast("string"), F.col("case_id").cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy("category").orderBy(key, "case_id"))
    category_key = F.sha2(F.concat_ws("\0", F.lit(seed), F.col("category").cast("string")), 256)
    return cases.withColumn("turn", turn).withColumn("category_key", category_key).orderBy("turn", "category_key", "category").limit(limit).select("case_id", "category", "turn")


def locked_cases(manifest: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases of a locked split (one row: case_ids), in its order; ids without a case have a null category."""
    return manifest.select(F.posexplode("case_ids").alias("pos", "case_id")).join(cases, "case_id", "left").select("pos", "case_id", "category")


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not there."""
    return wanted.select(key).distinct().join(held.select(key), key, "left_anti")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
