"""The operational plane as batch transformations: audit metrics, idempotent logs, leases, state machines."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import back_off
from ..functions.text import stripped

#: Fixed values.
SUCCESS = ("ok", "success", "succeeded", "completed")
SAFETY_ERRORS = ("approval_invalidated", "capability_denied", "idempotency_key_required", "policy_denied", "tool_not_allowed")
CASE_TRANSITIONS = (
    ("draft", "submitted"), ("submitted", "running"), ("submitted", "failed"), ("running", "waiting_human_review"), ("running", "failed"),
    ("waiting_human_review", "approved"), ("waiting_human_review", "rejected"), ("waiting_human_review", "failed"),
)
SECRET_KEY = r"(?i)(?:^|[_-])(?:password|passwd|secret|api[_-]?key|authorization|cookie|credential|private[_-]?key|token|access[_-]?token|refresh[_-]?token|session[_-]?token)(?:$|[_-])"
SECRET_VALUE = (
    r"(?i)(?:\bBearer\s+[A-Za-z0-9._~+/-]{6,}=*|\bsk-[A-Za-z0-9_-]{6,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|"
    r"\b(?:password|passwd|secret|api[_-]?key|authorization|cookie|access[_-]?token|refresh[_-]?token)\s*[:=]\s*[^\s,;]+)"
)
SECRET_ASSIGNMENT = r"(?i)\b(password|passwd|secret|api[_-]?key|authorization|cookie|access[_-]?token|refresh[_-]?token)\s*[:=]\s*\S+"


def words_of(pattern: str) -> str:
    """A pattern whose word boundaries (all before words) see letters and digits of any alphabet."""
    return pattern.replace(r"\b", r"(?<![\p{L}\p{N}_])")


def secret_like(text: Column) -> Column:
    return text.rlike(words_of(SECRET_VALUE))


def json_keys(tree: Column) -> Column:
    """The keys at any depth of a JSON text: strings that a colon follows."""
    return F.regexp_extract_all(tree, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))


def secret_tree(tree: Column) -> Column:
    """Whether a JSON text has a secret-like key or value at any depth."""
    return F.exists(json_keys(tree), lambda k: k.rlike(SECRET_KEY)) | secret_like(tree)


def redacted(text: Column, most: int = 500) -> Column:
    """Text without secret-like values, cut to ``most`` characters."""
    out = F.regexp_replace(F.regexp_replace(text, words_of(SECRET_VALUE), "[REDACTED]"), words_of(SECRET_ASSIGNMENT), "$1=[REDACTED]")
    return F.substring(stripped(out), 1, most)


def audit_metrics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, success rates, latency percentiles and usage sums of an audit log. A run counts by its last run event; a rate
    without a denominator and a sum without values are null."""
    good = F.lower("outcome").isin(list(SUCCESS))
    is_run = (F.col("action") == "run") | F.startswith("action", F.lit("run."))
    last = Window.partitionBy(*by, "run_id", "is_run").orderBy(F.desc("occurred_at"), F.desc("sequence"))
    rows = events.withColumn("is_run", is_run).withColumn("is_last", F.col("is_run") & (F.row_number().over(last) == 1))
    tool = F.col("tool").isNotNull()
    rate = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_last").alias("runs"), F.count_if(F.col("is_last") & good).alias("runs_ok"),
        F.count_if(tool).alias("tools"), F.count_if(tool & good).alias("tools_ok"),
        F.round(F.percentile("duration_ms", 0.5), 6).alias("p50"), F.round(F.percentile("duration_ms", 0.95), 6).alias("p95"),
        F.sum("total_tokens").alias("total_tokens"), F.count_if("safety_violation").alias("safety"),
    )
    return out.withColumn("run_rate", rate(F.col("runs_ok"), F.col("runs"))).withColumn("tool_rate", rate(F.col("tools_ok"), F.col("tools")))


def newest(events: DataFrame, by: str, n: int) -> DataFrame:
    """The newest n rows per group, to be read in ascending order."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sequence")))).where(F.col("_n") <= n).drop("_n")


def append_once(stored: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """Classify incoming rows (key, content_hash, arrival): inserted, replayed (same content) or conflict (other content)."""
    first = Window.partitionBy(key).orderBy("arrival")
    known = stored.select(key, F.col("content_hash").alias("stored_hash"))
    rows = incoming.withColumn("first_hash", F.first("content_hash").over(first)).withColumn("nth", F.row_number().over(first)).join(known, key, "left")
    reference = F.coalesce("stored_hash", "first_hash")
    return rows.select(key, "arrival", F.when(F.col("content_hash") != reference, "conflict").when(F.col("stored_hash").isNull() & (F.col("nth") == 1), "inserted").otherwise("replayed").alias("verdict"))


def claim(jobs: DataFrame, now: datetime, per_tenant: int = 1) -> DataFrame:
    """The jobs that a claim at ``now`` takes per tenant: due or with an expired lease, by priority and age."""
    at = F.lit(now)
    expired = (F.col("status") == "leased") & (F.col("lease_expires_at") <= at)
    due = jobs.where(((F.col("status") == "queued") & (F.col("available_at") <= at)) | expired).withColumn("lease_expired", expired)
    order = Window.partitionBy("tenant_id").orderBy(F.desc("priority"), "available_at", "created_at", "run_id")
    return due.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_tenant).select(
        "tenant_id", "run_id", "n", "lease_expired", (F.col("attempt") + 1).alias("attempt"), (F.col("lease_version") + 1).alias("lease_version")
    )


def fail(jobs: DataFrame, now: datetime) -> DataFrame:
    """What failing each leased job makes of it: dead letter, or queued again after a back-off."""
    dead = F.col("attempt") >= F.col("max_attempts")
    wait = back_off(F.col("attempt"))
    return jobs.where("status = 'leased'").select(
        "run_id", F.when(dead, "dead_letter").otherwise("queued").alias("status"), F.when(~dead, F.round(wait, 6)).alias("wait_s"),
        F.when(~dead, F.timestamp_micros(F.unix_micros(F.lit(now)) + (wait * 1e6).cast("long"))).alias("available_at"),
    )


def transition_violations(history: DataFrame, allowed: DataFrame, entity: str, order: str, status: str) -> DataFrame:
    """Steps of each entity's history that the table (from_status, to_status) does not allow."""
    steps = history.withColumn("from_status", F.lag(status).over(Window.partitionBy(entity).orderBy(order))).where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col(status)))
    return steps.withColumnRenamed(status, "to_status").join(allowed, ["from_status", "to_status"], "left_anti")


def command_replay(commands: DataFrame) -> DataFrame:
    """Per idempotency key: first result, whether all requests agree, and how often it was replayed."""
    return commands.groupBy("tenant_id", "idempotency_key").agg(
        F.min_by("result", "sequence").alias("result"), (F.count_distinct("request_hash") > 1).alias("conflict"), (F.count(F.lit(1)) - 1).alias("replays")
    )


def usage_delta(runs: DataFrame) -> DataFrame:
    """Usage of a resumed run beyond what its previous snapshot had seen; null where neither carries the column."""
    return runs.select("run_id", F.when(F.col("current_tokens").isNotNull(), F.greatest(F.lit(0), F.col("current_tokens") - F.coalesce("previous_tokens", F.lit(0)))).alias("delta_tokens"))


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Stored rows with incoming ones over them where their ``order`` is not less: one aggregation, no join."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def replace_slice(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows with every slice that incoming rows touch replaced by them."""
    return stored.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming)


def capability(requests: DataFrame) -> DataFrame:
    """Decisions on tool requests (allowed_tools, tool, registered, side_effecting, idempotency_key, requires_approval, risk): the first rule that applies."""
    refused = ~F.array_contains("allowed_tools", F.col("tool")) | ~F.col("registered") | (F.col("side_effecting") & (F.coalesce("idempotency_key", F.lit("")) == ""))
    asks = F.col("requires_approval") | F.col("risk").isin("write", "external", "destructive")
    return requests.withColumn("decision", F.when(refused, "deny").when(asks, "approval").otherwise("allow"))


def safety_violation(ok: Column, error: Column) -> Column:
    """A failed tool result whose error is a refusal."""
    return ~ok & F.coalesce(error, F.lit("")).isin(list(SAFETY_ERRORS))


def tool_audit(steps: DataFrame) -> DataFrame:
    """Audit rows of tool results (run_id, step, call_id, tool, ok, reused): a reused receipt counts for no tool and says so; the event id follows from run and call."""
    event = F.substring(F.sha2(F.concat_ws("\0", F.col("run_id").cast("string"), F.col("call_id").cast("string")), 256), 1, 32)
    outcome = F.when(F.col("reused"), "reused").when(F.col("ok"), "ok").otherwise("failed")
    return steps.select(event.alias("event_id"), "run_id", "step", F.when(~F.col("reused"), F.coalesce("tool", F.lit("<unknown>"))).alias("tool"), outcome.alias("outcome"))


def reconciled(runs: DataFrame, audit: DataFrame) -> DataFrame:
    """Terminal runs (run_id, status) whose closing event is not in the audit log yet. Its id follows from run and status, so a retry adds nothing."""
    event = F.substring(F.sha2(F.concat_ws("\0", F.lit("terminal"), F.col("run_id").cast("string"), "status"), 256), 1, 32)
    closing = runs.where(F.col("status").isin("completed", "failed", "cancelled")).select(event.alias("event_id"), "run_id", F.concat(F.lit("run."), "status").alias("action"))
    return closing.dropDuplicates(["event_id"]).join(audit.select("event_id"), "event_id", "left_anti")


def usage_totals(steps: DataFrame) -> DataFrame:
    """Usage per run of (run_id, input_tokens, output_tokens): sums, null where no step carried the figure, and whether any did."""
    total = lambda c: (F.sum(c).alias(c), (F.count(c) > 0).alias(f"seen_{c}"))
    return steps.groupBy("run_id").agg(*total("input_tokens"), *total("output_tokens"))


def run_summary(scores: DataFrame) -> DataFrame:
    """One row for a set of scored runs (passed, violations, steps)."""
    n = F.count(F.lit(1))
    return scores.agg(n.alias("runs"), F.round(F.count_if("passed") / F.when(n > 0, n), 6).alias("success_rate"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.round(F.avg("steps"), 6).alias("average_steps"))


def json_faults(rows: DataFrame, text: str = "json", most_depth: int = 50, most_chars: int = 1_000_000, container: str = "{") -> DataFrame:
    """Rows with ``fault``: why strict loading refuses a JSON text, or null.

    too_long, invalid, container (not the one asked for), number (NaN or infinite), surrogate, depth, or duplicate (a key twice in one object).
    Runs in Arrow batches: Spark's parsers keep the last of equal keys without a word.
    """
    class Refused(ValueError):
        pass

    def pairs(items: list) -> dict:
        made = dict(items)
        if len(made) != len(items):
            raise Refused("duplicate")
        return made

    def number(_: str):
        raise Refused("number")

    def depth_of(value) -> int:
        deepest, stack = 0, [(value, 1)]
        while stack:
            x, d = stack.pop()
            deepest = max(deepest, d)
            if deepest > most_depth:
                return deepest
            stack += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
        return deepest

    def fault(t: str | None) -> str | None:
        if t is None:
            return "invalid"
        if len(t) > most_chars:
            return "too_long"
        try:
            value = json.loads(t, object_pairs_hook=pairs, parse_constant=number)
        except Refused as e:
            return str(e)
        except (ValueError, RecursionError) as e:
            return "depth" if isinstance(e, RecursionError) else "invalid"
        if not isinstance(value, dict if container == "{" else list):
            return "container"
        if any(0xD800 <= ord(c) < 0xE000 for c in json.dumps(value, ensure_ascii=False)):
            return "surrogate"
        return "depth" if depth_of(value) > most_depth else None

    @F.pandas_udf("string")
    def checked(texts: pd.Series) -> pd.Series:
        return texts.map(fault, na_action=None)

    return rows.withColumn("fault", checked(text))


def rejected(rows: DataFrame, key: str, text: str, number: str, link: str) -> DataFrame:
    """(key, reason) of rows that break an input rule: blank text, a repeated key, a number that is not finite, a link to itself."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    reasons = F.array_compact(
        F.array(
            F.when(stripped(F.coalesce(text, F.lit(""))) == "", "blank"), F.when(F.col("_n") > 1, "repeated"),
            F.when(F.isnan(number) | (F.abs(number) == float("inf")), "not_finite"), F.when(F.col(link) == F.col(key), "self_link"),
        )
    )
    return counted.select(key, F.explode(reasons).alias("reason"))
