"""Plumbing that the training-data operators share: staged tables, session limits, skew-proof group facts.

Every operator cuts its lineage with a table written below the folder named by ``spark.checkpoint.dir``, so a lost
executor only costs the tasks it ran. Where that setting is absent a local session gets a private folder; on a cluster that is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_root

#: What separates words everywhere in this subpackage: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]"

def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (very long texts), and drop shuffle files once the query that made them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Workspace:
    """Staged tables of one operator run, all below one new folder of the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: later steps start from files, not from the plan that made them."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove staged tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(conf).delete(p, True)


def group_facts(
    rows: DataFrame, keys: Sequence[str], spread: Sequence[str], aggs: Sequence[tuple[str, Column, Column]], ways: int = 1024
) -> DataFrame:
    """``rows`` with facts of their group beside them, with no task that ever holds a whole group.

    ``aggs`` are (name, first, merge): ``first`` aggregates rows, ``merge`` aggregates partial results named ``name``.
    Rows are aggregated by key and one of ``ways`` salts (a hash of ``spread``), partial results by key, and the facts
    travel back the same two steps: a key with a third of all rows is in ``ways`` parts at the last join, and is
    at most ``ways`` rows at the one before. ``rows`` is read twice, so stage it first. Keys must not be null.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(ways)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*(first.alias(name) for name, first, _ in aggs))
    whole = parts.groupBy(*keys).agg(*(merge.alias(name) for name, _, merge in aggs))
    facts = parts.select(*keys, "_salt").join(whole, list(keys))
    return salted.join(facts, [*keys, "_salt"]).drop("_salt")
