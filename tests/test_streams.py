"""Streams against their batch counterparts."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(EVENTS, tmp_path / "in" / "a.parquet")
    shutil.copy(EVENTS, tmp_path / "in" / "b.parquet")  # everything once more
    return tmp_path


def test_idempotent_ingest(spark, folder):
    out = streams.run_to_table(streams.idempotent(streams.event_stream(spark, str(folder / "in"))), "once", str(folder / "c"))
    assert out.count() == spark.read.parquet(EVENTS).count()


def test_rolling_metrics(spark, folder):
    (folder / "in" / "b.parquet").unlink()
    out = streams.run_to_table(streams.rolling_metrics(streams.event_stream(spark, str(folder / "in"))), "rolling", str(folder / "c"), "complete")
    batch = spark.read.parquet(EVENTS).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r.start, r.event_type, r.n) for r in out.collect()) == sorted((r.start, r.event_type, r.n) for r in batch.collect())


def test_sessions_hold_every_event(spark, folder):
    (folder / "in" / "b.parquet").unlink()
    out = streams.run_to_table(streams.sessions(streams.event_stream(spark, str(folder / "in"))), "sess", str(folder / "c"), "complete")
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()


@pytest.mark.parametrize("restarts", [1, 2])
def test_keep_latest(spark, folder, restarts):
    """Also after a restart that has lost its checkpoint."""
    for n in range(restarts):
        stream = streams.event_stream(spark, str(folder / "in"), 1)
        q = stream.writeStream.foreachBatch(streams.keep_latest(str(folder / "out"), "user_id", "event_id", 8)).option("checkpointLocation", str(folder / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(folder / "out")).collect()}
    want = {r.user_id: r.m for r in spark.read.parquet(EVENTS).groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert got == want


def test_late_rows_are_counted(spark, tmp_path):
    source, seen = tmp_path / "in", set()
    for n, (i, at) in enumerate([(1, "2024-01-01 10:00:00"), (2, "2024-01-05 10:00:00"), (3, "2024-01-05 11:00:00"), (4, "2024-01-01 09:00:00")]):  # the last comes too late
        spark.createDataFrame([(i, at)], "event_id long, at string").select("event_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
        for f in set(source.glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 60 * n,) * 2)
            seen.add(f)
    stream = streams.rolling_metrics(streams.event_stream(spark, str(source), 1))
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert streams.late_rows(q) == 1
