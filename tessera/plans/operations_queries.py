"""Audit log, queue, state machines, plans, facts, trajectories."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import operations as ops
from ..operators import orchestration as o
from ..sources import corpus as c
from . import sql
from .catalog import query


def _metrics_sql(by: str, group: str) -> str:
    return f"""WITH {sql.AUDIT}, r AS (SELECT *, starts_with(action, 'run.') OR action = 'run' AS is_run FROM audit),
    l AS (SELECT *, is_run AND row_number() OVER (PARTITION BY {by} run_id, is_run ORDER BY occurred_at DESC, sequence DESC) = 1 AS is_last, outcome IN ('ok', 'success', 'succeeded', 'completed') AS good FROM r),
    m AS (SELECT {by} count(*) AS events, count_if(is_last)::BIGINT AS runs, count_if(is_last AND good)::BIGINT AS runs_ok, count(tool) AS tools, count_if(tool IS NOT NULL AND good)::BIGINT AS tools_ok, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95,
      sum(total_tokens)::BIGINT AS total_tokens, count_if(safety_violation)::BIGINT AS safety FROM l {group})
    SELECT *, round(CASE WHEN runs > 0 THEN runs_ok / runs END, 6) AS run_rate, round(CASE WHEN tools > 0 THEN tools_ok / tools END, 6) AS tool_rate FROM m"""


@query(_metrics_sql("", ""))
def audit_metrics(spark, d):
    return ops.audit_metrics(c.audit(spark, d))


@query(_metrics_sql("tenant_id,", "GROUP BY tenant_id"))
def audit_metrics_by_tenant(spark, d):
    return ops.audit_metrics(c.audit(spark, d), ["tenant_id"])


@query(f"WITH {sql.AUDIT} SELECT tenant_id, sequence, action FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY sequence DESC) AS n FROM audit) WHERE n <= 25")
def audit_newest(spark, d):
    return ops.newest(c.audit(spark, d), "tenant_id", 25).select("tenant_id", "sequence", "action")


@query(
    """WITH s AS (SELECT event_id, md5(event_type) AS h FROM events WHERE event_id % 4 = 0), i AS (SELECT event_id // 2 AS event_id, md5(event_type) AS h, event_id AS arrival FROM events),
    j AS (SELECT i.*, s.h AS sh, first_value(i.h) OVER w AS fh, row_number() OVER w AS n FROM i LEFT JOIN s USING (event_id) WINDOW w AS (PARTITION BY i.event_id ORDER BY arrival))
    SELECT event_id, arrival, CASE WHEN h <> coalesce(sh, fh) THEN 'conflict' WHEN sh IS NULL AND n = 1 THEN 'inserted' ELSE 'replayed' END AS verdict FROM j"""
)
def audit_idempotent(spark, d):
    events = c.table(spark, d, "events")
    h = F.md5("event_type").alias("content_hash")
    incoming = events.select(F.floor(F.col("event_id") / 2).alias("event_id"), h, F.col("event_id").alias("arrival"))
    return ops.append_once(events.where("event_id % 4 = 0").select("event_id", h), incoming)


@query("SELECT user_id AS run_id, CASE WHEN c IS NOT NULL THEN greatest(0, c - coalesce(p, 0)) END AS delta_tokens FROM (SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN (props->>'$.k')::BIGINT END)::BIGINT AS c, sum(CASE WHEN event_type = 'view' THEN (props->>'$.k')::BIGINT * 3 END)::BIGINT AS p FROM events GROUP BY ALL)")
def usage_delta(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    runs = c.table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.sum(F.when(F.col("event_type") != "error", k)).alias("current_tokens"), F.sum(F.when(F.col("event_type") == "view", k * 3)).alias("previous_tokens")
    )
    return ops.usage_delta(runs)


_AT = "TIMESTAMP '1998-01-01'"


@query(
    f"""WITH {sql.JOBS}, due AS (SELECT *, status = 'leased' AND lease_expires_at <= {_AT} AS lease_expired FROM jobs WHERE (status = 'queued' AND available_at <= {_AT}) OR (status = 'leased' AND lease_expires_at <= {_AT}))
    SELECT tenant_id, run_id, n::INT AS n, lease_expired, attempt + 1 AS attempt, lease_version + 1 AS lease_version FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY priority DESC, available_at, created_at, run_id) AS n FROM due) WHERE n <= 20"""
)
def queue_claim(spark, d):
    from datetime import datetime

    return ops.claim(c.jobs(spark, d), datetime(1998, 1, 1), 20)


@query(
    f"""WITH {sql.JOBS} SELECT run_id, CASE WHEN attempt >= max_attempts THEN 'dead_letter' ELSE 'queued' END AS status, CASE WHEN attempt < max_attempts THEN least(300.0, pow(2, greatest(0, attempt - 1)))::DOUBLE END AS wait_s,
    CASE WHEN attempt < max_attempts THEN {_AT} + to_seconds(least(300.0, pow(2, greatest(0, attempt - 1)))) END AS available_at FROM jobs WHERE status = 'leased'"""
)
def queue_fail_transition(spark, d):
    from datetime import datetime

    return ops.fail(c.jobs(spark, d), datetime(1998, 1, 1)).withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))


#: (order, line) repeats in the table: one row each, with its least part.
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)"


def _lines(spark, d):
    return c.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


_STATUS = ("draft", "submitted", "running", "waiting_human_review", "approved", "failed")
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in ops.CASE_TRANSITIONS)


@query(
    f"""WITH {_LINES}, h AS (SELECT l_orderkey AS case_id, l_linenumber AS revision, [{', '.join(repr(s) for s in _STATUS)}][least(6, l_linenumber + (l_partkey % 5 = 0)::INT)] AS status FROM lines),
    s AS (SELECT case_id, revision, status AS to_status, lag(status) OVER (PARTITION BY case_id ORDER BY revision) AS from_status FROM h)
    SELECT case_id, revision, from_status, to_status FROM s WHERE from_status IS NOT NULL AND from_status <> to_status AND (from_status, to_status) NOT IN ({_ALLOWED})"""
)
def state_violations(spark, d):
    status = F.element_at(F.array(*map(F.lit, _STATUS)), F.least(F.lit(6), F.col("l_linenumber") + (F.col("l_partkey") % 5 == 0).cast("int")).cast("int"))
    history = _lines(spark, d).select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("revision"), status.alias("status"))
    allowed = spark.createDataFrame(list(ops.CASE_TRANSITIONS), "from_status string, to_status string")
    return ops.transition_violations(history, allowed, "case_id", "revision", "status").select("case_id", "revision", "from_status", "to_status")


@query("SELECT 't' || (user_id % 3) AS tenant_id, user_id || ':' || event_type AS idempotency_key, arg_min(event_id, event_id) AS result, count(DISTINCT (props->>'$.k')::BIGINT % 2) > 1 AS conflict, count(*) - 1 AS replays FROM events GROUP BY ALL")
def command_replay(spark, d):
    k = F.get_json_object("props", "$.k").cast("long") % 2
    commands = c.table(spark, d, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), k.alias("request_hash"), F.col("event_id").alias("result"), F.col("event_id").alias("sequence")
    )
    return ops.command_replay(commands)


# Plans: one per order, one slot per line, each slot waiting for the line before it and, every third, for the first.
_SLOTS = f"""{_LINES}, slots AS (SELECT l_orderkey AS plan_id, l_linenumber AS slot_id, list_distinct(CASE WHEN l_linenumber = 1 THEN [] WHEN l_linenumber % 3 = 0 THEN [l_linenumber - 1, 1] ELSE [l_linenumber - 1] END) AS deps, 2 AS max_attempts FROM lines),
    runs AS (SELECT l_orderkey AS plan_id, l_linenumber AS slot_id, a AS attempt, CASE WHEN (l_partkey + a) % 4 = 0 THEN 'failed' WHEN (l_partkey + a) % 9 = 0 THEN 'running' ELSE 'succeeded' END AS status FROM lines, range(1, 3) r(a) WHERE l_partkey % 3 <> 0 AND a <= l_partkey % 2 + 1)"""


def _slots(spark, d):
    n = F.col("l_linenumber").cast("int")
    deps = F.when(n == 1, F.array().cast("array<int>")).when(n % 3 == 0, F.array_distinct(F.array(n - 1, F.lit(1)))).otherwise(F.array(n - 1))
    return _lines(spark, d).select(F.col("l_orderkey").alias("plan_id"), n.alias("slot_id"), deps.alias("depends_on"), F.lit(2).alias("max_attempts"))


def _runs(spark, d):
    p = F.col("l_partkey")
    rows = _lines(spark, d).where(p % 3 != 0).select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").cast("int").alias("slot_id"), p.alias("p"), F.explode(F.sequence(F.lit(1), (p % 2 + 1).cast("int"))).alias("attempt"))
    x = F.col("p") + F.col("attempt")
    return rows.select("plan_id", "slot_id", "attempt", F.when(x % 4 == 0, "failed").when(x % 9 == 0, "running").otherwise("succeeded").alias("status"))


@query(
    f"""WITH {_SLOTS}, last AS (SELECT plan_id, slot_id, arg_max(status, attempt) AS status, max(attempt) AS attempt FROM runs GROUP BY ALL),
    blocked AS (SELECT DISTINCT s.plan_id, s.slot_id FROM (SELECT plan_id, slot_id, unnest(deps) AS dep FROM slots) s LEFT JOIN last l ON l.plan_id = s.plan_id AND l.slot_id = s.dep WHERE coalesce(l.status, '') <> 'succeeded')
    SELECT plan_id, slot_id::INT AS slot_id, coalesce(attempt, 0)::INT + 1 AS next_attempt FROM slots LEFT JOIN last USING (plan_id, slot_id) WHERE (status IS NULL OR (status = 'failed' AND attempt < max_attempts)) AND (plan_id, slot_id) NOT IN (SELECT plan_id, slot_id FROM blocked)"""
)
def dag_ready(spark, d):
    return o.ready_slots(_slots(spark, d), _runs(spark, d))


@query(
    f"""WITH RECURSIVE {_SLOTS}, e AS (SELECT plan_id, slot_id, unnest(deps) AS dep FROM slots), start AS (SELECT plan_id, max(slot_id) AS slot_id FROM slots WHERE slot_id % 2 = 1 GROUP BY ALL),
    c AS (SELECT plan_id, slot_id FROM start UNION SELECT c.plan_id, e.dep FROM c JOIN e USING (plan_id, slot_id)) SELECT plan_id, slot_id::INT AS slot_id FROM c"""
)
def dag_closure(spark, d):
    slots = _slots(spark, d)
    edges = slots.select("plan_id", "slot_id", F.explode("depends_on").alias("dep"))
    return o.closure(edges, slots.where("slot_id % 2 = 1").groupBy("plan_id").agg(F.max("slot_id").alias("slot_id")))


@query(f"WITH {_SLOTS} SELECT plan_id, slot_id::INT AS slot_id, (coalesce(max(attempt), 0) + 1)::INT AS next_attempt, coalesce(max(attempt), 0) + 1 > 2 AS over_limit FROM slots LEFT JOIN runs USING (plan_id, slot_id) GROUP BY ALL")
def next_attempt(spark, d):
    last = _runs(spark, d).groupBy("plan_id", "slot_id").agg(F.max("attempt").alias("last"))
    n = F.coalesce("last", F.lit(0)) + 1
    return _slots(spark, d).join(last, ["plan_id", "slot_id"], "left").select("plan_id", "slot_id", n.alias("next_attempt"), (n > 2).alias("over_limit"))


_FACTS = "facts AS (SELECT 't' || (user_id % 3) AS tenant_id, user_id || '/' || event_type AS fact_key, event_id AS fact_id, ts AS created_at FROM events), v AS (SELECT tenant_id, fact_key, fact_id, row_number() OVER w AS version, lag(fact_id) OVER w AS supersedes_fact_id FROM facts WINDOW w AS (PARTITION BY tenant_id, fact_key ORDER BY created_at, fact_id))"


def _facts(spark, d):
    return c.table(spark, d, "events").select(F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fact_key"), F.col("event_id").alias("fact_id"), F.col("ts").alias("created_at"))


@query(f"WITH {_FACTS} SELECT tenant_id, fact_key, fact_id, version::INT AS version, supersedes_fact_id FROM v")
def fact_chain(spark, d):
    return o.fact_versions(_facts(spark, d))


@query(f"WITH {_FACTS} SELECT tenant_id, fact_key, max(version)::INT AS version, arg_max(fact_id, version) AS fact_id FROM v GROUP BY ALL")
def fact_heads(spark, d):
    return o.fact_heads(o.fact_versions(_facts(spark, d)))


@query(f"WITH {_FACTS}, h AS (SELECT fact_key, arg_max(fact_id, version) AS head FROM v GROUP BY fact_key), x AS (SELECT fact_id AS handoff_id, fact_key, fact_id, (fact_id % 3)::INT AS source FROM facts) SELECT handoff_id, coalesce(fact_id = head, false) AND source IN (0, 1) AS valid FROM x LEFT JOIN h USING (fact_key)")
def handoff_valid(spark, d):
    facts = _facts(spark, d)
    handoffs = facts.select(F.col("fact_id").alias("handoff_id"), "fact_key", "fact_id", (F.col("fact_id") % 3).cast("int").alias("source"), F.array(F.lit(0), F.lit(1)).alias("target_depends_on"))
    return o.valid_handoffs(handoffs, o.fact_heads(o.fact_versions(facts)))


@query(
    """WITH r AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey % 20 AS ref FROM lineitem), c AS (SELECT o_orderkey AS run_id, 1 AS claim_id, CASE WHEN o_orderkey % 7 = 0 THEN [] ELSE [o_custkey % 20, o_orderkey % 4] END AS refs FROM orders)
    SELECT run_id, claim_id, len(refs) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(refs) AS x) WHERE x NOT IN (SELECT ref FROM r WHERE r.run_id = c.run_id)) AS grounded FROM c"""
)
def claims_grounded(spark, d):
    retrieved = c.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 20).alias("ref"))
    k = F.col("o_orderkey")
    claims = c.table(spark, d, "orders").select(k.alias("run_id"), F.lit(1).alias("claim_id"), F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("o_custkey") % 20, k % 4)).alias("refs"))
    return o.grounded_claims(claims, retrieved)


@query(
    """WITH e AS (SELECT l_orderkey AS case_id, 'e' || l_linenumber AS evidence_id, 'p' || (l_partkey % 3) AS locator FROM lineitem), k AS (SELECT DISTINCT case_id, evidence_id AS ref, evidence_id FROM e UNION SELECT case_id, locator, evidence_id FROM e),
    c AS (SELECT DISTINCT o_orderkey AS case_id, unnest(['e2', 'p1', 'fact:9']) AS ref FROM orders) SELECT c.case_id, c.ref, CASE count(DISTINCT evidence_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'bound' ELSE 'ambiguous' END AS verdict, min(evidence_id) AS first_evidence FROM c LEFT JOIN k USING (case_id, ref) WHERE c.ref NOT LIKE 'fact:%' GROUP BY ALL"""
)
def citation_bind(spark, d):
    evidence = c.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("e"), "l_linenumber").alias("evidence_id"), F.concat(F.lit("p"), F.col("l_partkey") % 3).alias("locator"))
    citations = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(*map(F.lit, ("e2", "p1", "fact:9")))).alias("ref"))
    return o.bind_citations(citations, evidence)


@query("SELECT user_id AS run_id, count(*) AS steps, count_if(event_type = 'click')::BIGINT AS tool_calls, count_if(event_type = 'error')::BIGINT AS failures, round(epoch(max(ts)) - epoch(min(ts)), 3) AS elapsed_s, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL")
def runtime_metrics(spark, d):
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    ts = F.col("ts").cast("timestamp")
    return c.table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("steps"), is_("click").alias("tool_calls"), is_("error").alias("failures"),
        F.round((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6, 3).alias("elapsed_s"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"),
    )


@query("WITH r AS (SELECT conv_id, 'src' || (length(text) % 7) AS ref, turn FROM conversations WHERE role = 'assistant') SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, ref)::INT AS pos FROM (SELECT conv_id, ref, min(turn) AS first_at FROM r GROUP BY ALL)")
def retrieved_refs(spark, d):
    rows = c.table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", F.concat(F.lit("src"), F.length("text") % 7).alias("ref"), "turn")
    return o.first_seen(rows, "conv_id", "ref", "turn", 200)


@query("SELECT tenant_id, case_id, updated_at FROM (SELECT 't' || (o_custkey % 3) AS tenant_id, o_orderkey AS case_id, o_orderdate AS updated_at, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE n <= 50")
def case_inbox(spark, d):
    cases = c.table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select(F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("tenant_id"), F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("updated_at"))
    return cases.withColumn("n", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("updated_at"), "case_id"))).where("n <= 50").drop("n")


_RISKS = ("read", "write", "external", "compute")


@query(
    f"""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') OR event_id % 11 = 0 OR (event_id % 2 = 0 AND event_id % 3 = 0) THEN 'deny' WHEN event_id % 13 = 0 OR {list(_RISKS)}[user_id % 4 + 1] IN ('write', 'external', 'destructive') THEN 'approval' ELSE 'allow' END AS decision,
    event_id % 5 = 0 AND coalesce(CASE event_id % 4 WHEN 0 THEN 'policy_denied' WHEN 1 THEN 'timeout' WHEN 2 THEN 'tool_not_allowed' END, '') IN {ops.SAFETY_ERRORS} AS safety FROM events"""
)
def capability_decision(spark, d):
    k = F.col("event_id")
    requests = c.table(spark, d, "events").select(
        k, F.array(*map(F.lit, ("click", "view", "purchase"))).alias("allowed_tools"), F.col("event_type").alias("tool"), (k % 11 != 0).alias("registered"), (k % 2 == 0).alias("side_effecting"),
        F.when(k % 3 != 0, k.cast("string")).alias("idempotency_key"), (k % 13 == 0).alias("requires_approval"), F.element_at(F.array(*map(F.lit, _RISKS)), (F.col("user_id") % 4 + 1).cast("int")).alias("risk"),
    )
    error = F.when(k % 4 == 0, "policy_denied").when(k % 4 == 1, "timeout").when(k % 4 == 2, "tool_not_allowed")
    return ops.capability(requests).select("event_id", "decision", ops.safety_violation(k % 5 != 0, error).alias("safety"))


@query("WITH v AS (SELECT user_id % 50 AS kind, event_type AS provider, event_id, ts FROM events) SELECT kind, provider, arg_max(event_id, ts) AS event_id, max(ts) AS produced_at FROM v GROUP BY ALL")
def verification_latest(spark, d):
    return c.table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("kind"), F.col("event_type").alias("provider")).agg(F.max_by("event_id", "ts").alias("event_id"), F.max("ts").alias("produced_at"))
