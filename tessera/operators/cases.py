"""Review cases and their evidence: bounded values, identity checks, claims to facts, receipts, attempts, layout boxes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from .operations import json_keys

#: Metadata keys (letters and digits only) that a caller may not set.
RESERVED_KEYS = ("workspaceroot", "workspacepath", "artifactroot", "artifactpath", "skillpackid", "baseagentprofileid")


def bounded_value(text: Column, most: int) -> Column:
    """Text as it is, or what stands for it if it is longer: its size and hash."""
    gone = F.to_json(F.struct(F.lit(True).alias("omitted"), F.length(text).alias("size"), F.sha2(text, 256).alias("sha256")))
    return F.when(F.length(text) > most, gone).otherwise(text)


def clipped(text: Column, most: int, suffix: str = "…") -> Column:
    """Text cut so that it and the suffix fit."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - len(suffix))), F.lit(suffix)))


def both_or_either(left: Column, right: Column) -> Column:
    """The intersection of two filters; null is no filter."""
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.array_intersect(left, right))


def reconciled(claims: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each field from what is claimed and what is declared (f, f_declared): the one that is there; conflicts are counted."""
    clash = [F.when(F.col(f).isNotNull() & F.col(f"{f}_declared").isNotNull() & (F.col(f) != F.col(f"{f}_declared")), 1).otherwise(0) for f in fields]
    total = clash[0]
    for c in clash[1:]:
        total = total + c
    return claims.withColumns({**{f: F.coalesce(f, f"{f}_declared") for f in fields}, "conflicts": total}).drop(*(f"{f}_declared" for f in fields))


def evidence_header(title: Column, source: Column, published: Column) -> Column:
    """Heading lines for those of the three that are not blank."""
    line = lambda name, c: F.when(stripped(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), stripped(c)))
    return F.concat_ws("\n", line("title", title), line("source", source), line("published_at", published))


def citation_list(rows: DataFrame, by: str, refs: Column, fields: Sequence[str]) -> DataFrame:
    """(by, ref, pos): references first, then the evidence fields in order; blanks go, the first of equals stays."""
    all_refs = F.concat(refs, F.array(*fields))
    seen = rows.select(by, "line", F.posexplode(all_refs).alias("at", "ref")).where("ref IS NOT NULL AND ref != ''")
    first = seen.groupBy(by, "ref").agg(F.min(F.struct("line", "at")).alias("first"))
    return first.select(by, "ref", F.row_number().over(Window.partitionBy(by).orderBy("first", "ref")).alias("pos"))


def exhausted(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Slots whose latest run failed at the last permitted attempt."""
    last = runs.groupBy("plan_id", "slot_id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))
    return slots.join(last, ["plan_id", "slot_id"]).where("status = 'failed' AND attempt >= max_attempts").select("plan_id", "slot_id", "attempt")


def take_over(runs: DataFrame, now: datetime) -> DataFrame:
    """What an exclusive claim at ``now`` finds: free, expired (taken over, token counted up) or held."""
    state = F.when(F.col("owner").isNull(), "free").when(F.col("expires_at") <= F.lit(now), "expired").otherwise("held")
    return runs.withColumn("state", state).withColumn("token", F.when(state == "held", F.col("token")).otherwise(F.col("token") + 1))


def project_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """New facts from claims (fact_key, source_run, value), once per key and run: versions go on from the key's head."""
    head = facts.groupBy("fact_key").agg(F.max("version").alias("head"))
    new = claims.join(facts.select("fact_key", "source_run"), ["fact_key", "source_run"], "left_anti").join(head, "fact_key", "left")
    n = F.row_number().over(Window.partitionBy("fact_key").orderBy("source_run"))
    return new.select("fact_key", "source_run", "value", (F.coalesce("head", F.lit(0)) + n).alias("version"))


def consume_receipts(heads: DataFrame, receipts: DataFrame) -> DataFrame:
    """Which unconsumed receipt (receipt_id, fact_key, value_hash, authority, consumed_by) verifies each fact head; each is used once."""
    key = ["fact_key", "value_hash", "authority"]
    # Only a key's first receipt can be the first of any of its facts: facts meet one row per key, not all its receipts.
    first = receipts.where("consumed_by IS NULL").groupBy(*key).agg(F.min("receipt_id").alias("receipt_id"))
    one = heads.join(first, key).groupBy("fact_id").agg(F.min("receipt_id").alias("receipt_id"))
    return one.groupBy("receipt_id").agg(F.min("fact_id").alias("fact_id")).select("fact_id", "receipt_id")


def private_memory(rows: DataFrame, now: datetime) -> DataFrame:
    """Unexpired memories, one per content, numbered per role."""
    alive = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    first = alive.groupBy("role", "content_hash").agg(F.min("at").alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("role").orderBy("at", "content_hash")))


def reserved_keys(json_map: Column) -> Column:
    """Whether a JSON text has a reserved key at any depth, compared by its letters and digits."""
    return F.exists(json_keys(json_map), lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(list(RESERVED_KEYS)))


def union_box(boxes: DataFrame, by: str, width: float, height: float) -> DataFrame:
    """The box around all boxes of a group, clamped to the page and rounded half to even."""
    clamp = lambda c, most: F.least(F.lit(most), F.greatest(F.lit(0.0), F.col(c)))
    return boxes.groupBy(by).agg(
        F.bround(F.min(clamp("x0", width)), 3).alias("x0"), F.bround(F.min(clamp("top", height)), 3).alias("top"), F.bround(F.max(clamp("x1", width)), 3).alias("x1"), F.bround(F.max(clamp("bottom", height)), 3).alias("bottom")
    )
