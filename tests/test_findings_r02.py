"""What round 2 found: work that grew with the square of a group, and a limit that a table could not meet."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import cases, scope


def test_receipts_of_a_crowded_key(spark):
    """20,000 facts and 5,000 receipts of one key: pairs would be 100 million; the first of each is used, once."""
    heads = spark.range(20_000).select(F.col("id").alias("fact_id"), F.lit(1).alias("fact_key"), F.lit(2).alias("value_hash"), F.lit("a").alias("authority"))
    heads = heads.unionByName(spark.createDataFrame([(7, 3, 2, "a"), (-5, 3, 2, "a")], heads.schema))
    receipts = spark.range(5_000).select((F.col("id") + 10).alias("receipt_id"), F.lit(1).alias("fact_key"), F.lit(2).alias("value_hash"), F.lit("a").alias("authority"), F.when(F.col("id") == 0, 1).cast("long").alias("consumed_by"))
    receipts = receipts.unionByName(spark.createDataFrame([(4, 3, 2, "a", None)], receipts.schema))
    made = cases.consume_receipts(heads, receipts)
    # fact 7 has two keys and takes the lesser receipt, 4, which fact -5 uses first
    assert sorted(tuple(r) for r in made.collect()) == [(-5, 4), (0, 11)]
    joined = [int(m.value()) for m in _metrics(made, "Join")]
    assert joined and max(joined) <= 20_002


def _metrics(df, kind):
    """The output rows of the plan's nodes whose name has ``kind``."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
            continue
        if kind in p.nodeName():
            m = p.metrics().get("numOutputRows")
            if m.isDefined():
                out.append(m.get())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_visible_counts_equal_the_pairs(spark):
    r = random.Random(3)
    some = lambda n: [r.choice("abcdef") for _ in range(r.randint(0, n))]
    people = spark.createDataFrame([(i, f"t{i % 3}", some(3)) for i in range(60)], "principal_id long, tenant_id string, acl_tokens array<string>")
    rows = [(i, f"t{r.randint(0, 3)}", some(4)) for i in range(300)]
    chunks = spark.createDataFrame(rows + rows[:40] + [(0, rows[0][1], ["f"])], "chunk_id long, tenant_id string, acl array<string>")
    want = scope.visible_to_many(people, chunks).groupBy("principal_id").agg(F.count(F.lit(1)).alias("n_visible"), F.min("chunk_id").alias("first_chunk"))
    got = scope.visible_counts(people, chunks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_allow_list_that_is_a_table_has_no_limit(spark):
    chunks = spark.range(30_000).select(F.col("id").alias("chunk_id"), F.lit("t").alias("tenant_id"), F.array(F.lit("tenant")).alias("acl"), F.lit("k").alias("kb"), F.lit(1).alias("version_order"), F.lit("1").alias("version"), F.col("id").alias("logical_id"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    allow = chunks.where("chunk_id % 4 != 0").select("chunk_id")
    p = scope.Principal("t")
    assert scope.scoped(chunks, p, datetime(2024, 1, 1), allow=allow, allow_most=None).count() == 22_500
    with pytest.raises(Exception, match="allow-list is too long"):
        scope.scoped(chunks, p, datetime(2024, 1, 1), allow=allow).count()
