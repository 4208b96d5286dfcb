"""Structured Streaming over the audit log: idempotent ingest, rolling metrics, sessions, lease expiry, latest state.

The batch counterparts live in ``operators.operations``. Sources are Parquet directories here; any streaming source with
the same columns does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.staging import staged


def event_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """The events of a folder of Parquet files as a stream, with an event-time column Spark can watermark."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, as long as its repetition comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rolling_metrics(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and event type; windows close when the watermark passes them."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events that follow each other within ``gap``."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def lease_expiry(leases: DataFrame, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """Jobs (run_id, ts: heartbeats) whose lease ran out: state holds the last heartbeat, an event-time timer fires when it is old."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "expired_at": [pd.Timestamp(last + seconds * 1_000_000, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["ts"].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return leases.withWatermark("ts", late).groupBy("run_id").applyInPandasWithState(step, "run_id long, expired_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_latest(target: str, key: str, order: str, buckets: int = 256) -> Any:
    """A ``foreachBatch`` sink: the newest row per key in the table folder ``target``, partitioned by a hash of the key.

    A batch rewrites the buckets that it touches and no others. Merging the same batch twice changes nothing, so a retry, or a restart from a
    new checkpoint, is safe.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = staged(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "latest-batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.unionByName(spark.read.schema(new.schema).parquet(target).where(F.col("bucket").isin(touched)))
        last = new.groupBy("bucket", key).agg(F.max_by(F.struct(*(c for c in new.columns if c != "bucket")), order).alias("r")).select("r.*", "bucket")
        staged(last, "latest-merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return merge


def late_rows(query: Any) -> int:
    """How many rows a finished query dropped because the watermark had passed them, from its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into an in-memory table and return it."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
