"""Exact dedup by two-pass Bloom filtering.

Pass one hashes every whole text inside the JVM and stages one small row a document. From those hashes Bloom filters
of the bits that were set twice are built, one for each range of hashes. Pass two tests each row: a hash with a bit that nobody else
set is unique and passes straight through; only possibly repeated rows are shuffled, as (digest, length, id), never as text.
While all filters together are at most BROADCAST_BYTES (33 million rows), rows are tested where they lie, against a broadcast.
Beyond that the small rows go to their range's filter instead, in parts of about a million rows, so a hash with a third
of all rows is spread; memory per task is the same at any size, no filter saturates, and unique rows pass through from there.

Defined results: a null text counts as empty; texts that only hold blanks are equal to the empty one; of rows that tie
in length and doc_id (repeated rows) exactly one is kept; rows without a doc_id come before all others in a tie; very long texts are hashed
whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import BLANKS, Workspace, group_facts


#: What the filters may take up together to be broadcast; beyond it rows go to the filters.
BROADCAST_BYTES = 64 << 20
_FLAGGED = "doc_id long, digest binary, n_chars int, text_tag long, row_tag long, maybe_repeated boolean"


def _flag_by_broadcast(hashes: DataFrame, filters: DataFrame, rows: int) -> DataFrame:
    """Every row where it lies, with whether its hash may be repeated."""
    ranges, bits = bloom.ranges_for(rows), bloom.bits_for(rows)
    size = bits // 8
    all_bits = np.zeros(ranges * size, np.uint8)
    for r in filters.toLocalIterator():  # at most BROADCAST_BYTES
        all_bits[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(all_bits)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64)
            at = (h.view(np.uint64) >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(h), np.int64)
            flags = np.zeros(len(h), bool)
            for r in np.unique(at):
                flags[at == r] = bloom.all_set(shared.value[r * size : (r + 1) * size], h[at == r], bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flags)], names=[*batch.schema.names[:-1], "maybe_repeated"])

    return hashes.mapInArrow(test, _FLAGGED)


def _flag_by_range(hashes: DataFrame, filters: DataFrame, rows: int) -> DataFrame:
    """The same by range and part: each part of a range meets the range's filter, no part is much larger than a range should be."""
    bits = bloom.bits_for(rows)
    ranged = hashes.withColumn("range", bloom.range_of(F.col("h"), bloom.ranges_for(rows)))
    ways = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / (2 * bloom.ROWS)).cast("int").alias("ways"))
    left = ranged.join(ways, "range").withColumn("part", F.pmod(F.xxhash64("row_tag"), F.col("ways")).cast("int")).drop("ways")
    right = filters.join(ways, "range").select("range", "twice", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("part"))

    def test(own: pa.Table, held: pa.Table) -> pa.Table:
        twice = np.frombuffer(held.column("twice")[0].as_py(), np.uint8)
        flags = bloom.all_set(twice, own.column("h").to_numpy(), bits)
        return own.select(["doc_id", "digest", "n_chars", "text_tag", "row_tag"]).append_column("maybe_repeated", pa.array(flags))

    return left.groupBy("range", "part").cogroup(right.groupBy("range", "part")).applyInArrow(test, _FLAGGED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and n_chars and text_tag, the xxhash64, of the original text)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = ws.stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text, BLANKS + "+", ""), 256)).alias("digest"),
            F.length(text).alias("n_chars"),
            F.xxhash64(text).alias("text_tag"),
            F.monotonically_increasing_id().alias("row_tag"),
        ),
        "hashed",
    )
    rows = hashed.count()
    hashes = hashed.withColumn("h", F.xxhash64("digest"))
    filters = ws.stage(bloom.filters(hashes.select("h"), rows), "filters")
    flag = _flag_by_broadcast if bloom.ranges_for(rows) * bloom.bits_for(rows) // 8 <= BROADCAST_BYTES else _flag_by_range
    flagged = ws.stage(flag(hashes, filters, rows), "flagged")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "row_tag"))
    suspects = group_facts(
        flagged.where("maybe_repeated"), ["digest"], ["row_tag"], [("best", best, F.min("best")), ("group_size", F.count(F.lit(1)), F.sum("group_size"))]
    )
    columns = lambda keep_id, size, kept: ["doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars", "text_tag"]
    return suspects.select(columns(F.col("best.doc_id"), F.col("group_size"), F.col("best.row_tag") == F.col("row_tag"))).unionByName(
        flagged.where("NOT maybe_repeated").select(columns(F.col("doc_id"), F.lit(1), F.lit(True)))
    )
