"""Plans and their runs, audit rows, validators, request filters: the operators that a service calls between searches."""

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import operations as ops
from ..operators import orchestration as o
from ..operators import scope
from ..operators import retrieval as r
from ..sources import corpus as c
from . import sql
from .catalog import query
from .operations_queries import _LINES, _SLOTS, _lines, _runs, _slots

# Plans of the orders: their state, how many runs they may have, and who owns them.
_PLANS = "plans AS (SELECT o_orderkey AS plan_id, ['ready', 'running', 'completed', 'cancelled'][o_custkey % 4 + 1] AS status, 3 + o_orderkey % 6 AS max_role_runs, 'u' || (o_custkey % 50) AS owner_user_id, 't' || (o_custkey % 3) AS tenant_id, o_custkey % 10 AS conversation_id FROM orders)"


def _plans(spark, d):
    k = F.col("o_custkey")
    status = F.element_at(F.array(*map(F.lit, ("ready", "running", "completed", "cancelled"))), (k % 4 + 1).cast("int"))
    return c.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("plan_id"), status.alias("status"), (3 + F.col("o_orderkey") % 6).alias("max_role_runs"), F.concat(F.lit("u"), k % 50).alias("owner_user_id"), F.concat(F.lit("t"), k % 3).alias("tenant_id"), (k % 10).alias("conversation_id")
    )


@query(
    f"""WITH {_SLOTS}, {_PLANS}, last AS (SELECT plan_id, slot_id, arg_max(status, attempt) AS status, max(attempt) AS attempt FROM runs GROUP BY ALL),
    live AS (SELECT plan_id FROM plans LEFT JOIN (SELECT plan_id, count(*) AS used FROM runs GROUP BY ALL) USING (plan_id) WHERE status IN ('ready', 'running') AND coalesce(used, 0) < max_role_runs),
    blocked AS (SELECT DISTINCT s.plan_id, s.slot_id FROM (SELECT plan_id, slot_id, unnest(deps) AS dep FROM slots) s LEFT JOIN last l ON l.plan_id = s.plan_id AND l.slot_id = s.dep WHERE coalesce(l.status, '') <> 'succeeded')
    SELECT plan_id, slot_id::INT AS slot_id, coalesce(attempt, 0)::INT + 1 AS next_attempt, row_number() OVER (PARTITION BY plan_id ORDER BY 10 - slot_id, slot_id)::INT AS position
    FROM slots LEFT JOIN last USING (plan_id, slot_id) WHERE (status IS NULL OR (status = 'failed' AND attempt < max_attempts)) AND (plan_id, slot_id) NOT IN (SELECT plan_id, slot_id FROM blocked) AND plan_id IN (SELECT plan_id FROM live)"""
)
def dag_next_slots(spark, d):
    slots = _slots(spark, d).withColumn("order", 10 - F.col("slot_id"))
    return o.next_slots(_plans(spark, d), slots, _runs(spark, d))


@query(
    f"""WITH {_SLOTS}, {_PLANS} SELECT owner_user_id, plan_id, slot_id::INT AS slot_id, arg_max(r.status, attempt) AS status, max(attempt)::INT AS attempt
    FROM (SELECT *, 't' || (plan_id % 3) AS tenant_id, plan_id % 10 AS conversation_id FROM runs) r JOIN plans USING (plan_id, tenant_id, conversation_id) GROUP BY ALL"""
)
def owned_latest_runs(spark, d):
    p = F.col("plan_id")
    runs = _runs(spark, d).withColumns({"tenant_id": F.concat(F.lit("t"), p % 3), "conversation_id": p % 10})
    return o.owned_runs(_plans(spark, d), runs)


@query(
    f"""WITH RECURSIVE {_SLOTS}, s AS (SELECT plan_id, slot_id, CASE WHEN slot_id = 1 AND plan_id % 4 = 0 THEN [2] ELSE deps END AS deps FROM slots), e AS (SELECT plan_id, slot_id, unnest(deps) AS dep FROM s),
    e2 AS (SELECT e.* FROM e JOIN s ON s.plan_id = e.plan_id AND s.slot_id = e.dep), reach AS (SELECT plan_id, slot_id, dep FROM e2 UNION SELECT r.plan_id, r.slot_id, e2.dep FROM reach r JOIN e2 ON e2.plan_id = r.plan_id AND e2.slot_id = r.dep),
    loops AS (SELECT DISTINCT plan_id, slot_id FROM reach WHERE slot_id = dep), stuck AS (SELECT plan_id, slot_id FROM loops UNION SELECT reach.plan_id, reach.slot_id FROM reach JOIN loops ON loops.plan_id = reach.plan_id AND loops.slot_id = reach.dep)
    SELECT plan_id, count(*)::INT AS n_stuck FROM stuck GROUP BY ALL"""
)
def cyclic_plans(spark, d):
    """Every fourth plan's first slot waits for its second."""
    slots = _slots(spark, d)
    loop = (F.col("slot_id") == 1) & (F.col("plan_id") % 4 == 0)
    return o.cyclic(slots.withColumn("depends_on", F.when(loop, F.array(F.lit(2))).otherwise(F.col("depends_on"))))


@query(
    f"""WITH RECURSIVE {_SLOTS}, {_PLANS}, last AS (SELECT plan_id, slot_id, arg_max(status, attempt) AS status FROM runs GROUP BY ALL), e AS (SELECT plan_id, slot_id, unnest(deps) AS dep FROM slots),
    need AS (SELECT plan_id, slot_id FROM slots WHERE slot_id <= 2 UNION SELECT n.plan_id, e.dep FROM need n JOIN e USING (plan_id, slot_id)),
    busy AS (SELECT plan_id, count_if(status = 'running') AS n FROM last GROUP BY ALL), miss AS (SELECT n.plan_id, count(*) AS n FROM need n LEFT JOIN last l USING (plan_id, slot_id) WHERE coalesce(l.status, '') <> 'succeeded' GROUP BY ALL)
    SELECT plan_id, CASE WHEN coalesce(busy.n, 0) > 0 THEN 'active' WHEN coalesce(miss.n, 0) > 0 THEN 'missing' ELSE 'complete' END AS verdict FROM plans LEFT JOIN busy USING (plan_id) LEFT JOIN miss USING (plan_id)"""
)
def plan_completion(spark, d):
    return o.completion(_plans(spark, d), _slots(spark, d).withColumn("required", F.col("slot_id") <= 2), _runs(spark, d))


@query(
    """WITH l AS (SELECT l_orderkey AS case_id, l_linenumber AS n, l_suppkey % 8 AS s FROM lineitem), got AS (SELECT DISTINCT case_id, 'src' || s AS ref FROM l WHERE n <= 2 AND s <> 0), peer AS (SELECT DISTINCT case_id, 'src' || s AS ref FROM l WHERE n = 3),
    facts AS (SELECT DISTINCT case_id, 'fact:' || n AS ref FROM l WHERE n >= 3), cited AS (SELECT DISTINCT o_orderkey AS case_id, unnest(['src' || (o_custkey % 8), 'fact:' || (o_custkey % 5 + 1)]) AS ref FROM orders),
    known AS (SELECT * FROM got UNION SELECT * FROM peer UNION SELECT * FROM facts) SELECT case_id, ref FROM cited WHERE case_id NOT IN (SELECT case_id FROM got) OR (case_id, ref) NOT IN (SELECT case_id, ref FROM known)"""
)
def ungrounded_citations(spark, d):
    lines = c.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 8).alias("s")).withColumn("ref", F.concat(F.lit("src"), "s"))
    k = F.col("o_custkey")
    cited = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(F.concat(F.lit("src"), k % 8), F.concat(F.lit("fact:"), k % 5 + 1))).alias("ref"))
    return o.ungrounded(cited, lines.where("n <= 2 AND s != 0"), lines.where("n >= 3").select("case_id", F.col("n").alias("fact_id")), lines.where("n = 3"))


@query(f"WITH {_SLOTS} SELECT plan_id, slot_id::INT AS slot_id, attempt::INT AS attempt, status, row_number() OVER (PARTITION BY plan_id ORDER BY slot_id, attempt)::INT AS position FROM runs WHERE ['planner', 'analyst', 'reviewer'][slot_id % 3 + 1] IN ('planner', 'reviewer')")
def role_run_list(spark, d):
    role = F.element_at(F.array(*map(F.lit, ("planner", "analyst", "reviewer"))), F.col("slot_id") % 3 + 1)
    return o.listed_runs(_runs(spark, d).withColumn("role", role), ["planner", "reviewer"]).select("plan_id", "slot_id", "attempt", "status", "position")


@query("SELECT user_id AS case_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS revision FROM events WHERE event_type <> 'view'")
def case_audit_list(spark, d):
    from pyspark.sql import Window

    e = c.table(spark, d, "events").where("event_type != 'view'")
    return e.select(F.col("user_id").alias("case_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("revision"))


@query("SELECT sha256(user_id || chr(0) || event_id)[:32] AS event_id, user_id AS run_id, event_id AS step, CASE WHEN event_type <> 'purchase' THEN CASE WHEN event_type = 'error' THEN '<unknown>' ELSE event_type END END AS tool, CASE WHEN event_type = 'purchase' THEN 'reused' WHEN value > 50 THEN 'ok' ELSE 'failed' END AS outcome FROM events")
def trajectory_audit(spark, d):
    e = F.col("event_type")
    steps = c.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_id").alias("call_id"), F.when(e != "error", e).alias("tool"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("ok"), (e == "purchase").alias("reused"))
    return ops.tool_audit(steps)


@query("SELECT DISTINCT sha256('terminal' || chr(0) || o_orderkey || chr(0) || s)[:32] AS event_id, o_orderkey AS run_id, 'run.' || s AS action FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS s, o_custkey FROM orders) WHERE s <> 'running' AND o_custkey % 3 <> 0")
def terminal_reconciliation(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("running")
    runs = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), "o_custkey")
    written = ops.reconciled(runs.where("o_custkey % 3 = 0"), runs.select(F.lit("").alias("event_id")).limit(0))
    return ops.reconciled(runs, written)


@query(
    f"""WITH s AS (SELECT user_id AS run_id, event_type AS tool, (ts::DATE - DATE '2024-01-01')::INT AS step, value > 20 AS ok, CASE WHEN event_type = 'purchase' THEN 'timeout' WHEN event_id % 97 = 0 THEN 'policy_denied' END AS error FROM events),
    u AS (SELECT run_id, list_distinct(list(tool)) AS used, max(step) AS steps, count_if(NOT coalesce(ok, false) AND coalesce(error, '') IN {ops.SAFETY_ERRORS}) AS refused FROM s GROUP BY ALL),
    g AS (SELECT run_id, steps, len(list_filter(['click', 'view'], lambda x: NOT list_contains(used, x)))::INT AS missing, (len(list_filter(['purge'], lambda x: list_contains(used, x))) + refused)::BIGINT AS violations, run_id % 5 <> 0 AS status_ok, run_id % 7 <> 0 AS answer_ok FROM u)
    SELECT *, violations > 0 AS hard_fail, missing = 0 AND violations = 0 AND status_ok AND answer_ok AND steps <= 28 AS passed FROM g"""
)
def trajectory_score(spark, d):
    return _scored(spark, d)


def _scored(spark, d):
    e = c.table(spark, d, "events")
    error = F.when(F.col("event_type") == "purchase", "timeout").when(F.col("event_id") % 97 == 0, "policy_denied")
    steps = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("tool"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("step"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("ok"), error.alias("error"))
    words = lambda *w: F.array(*map(F.lit, w))
    u = F.col("run_id")
    rules = e.select(F.col("user_id").alias("run_id")).distinct().select(
        "run_id", words("click", "view").alias("required"), words("purge").alias("forbidden"), F.lit(28).alias("most_steps"), F.when(u % 5 == 0, "failed").otherwise("completed").alias("status"), F.lit("completed").alias("expected_status"),
        F.when(u % 7 == 0, "no result").otherwise("The Answer is 42").alias("answer"), words("answer", "42").alias("expected_parts"),
    )
    return o.score_trajectories(steps, rules)


@query(
    f"""WITH s AS (SELECT user_id AS run_id, event_type AS tool, (ts::DATE - DATE '2024-01-01')::INT AS step, value > 20 AS ok, CASE WHEN event_type = 'purchase' THEN 'timeout' WHEN event_id % 97 = 0 THEN 'policy_denied' END AS error FROM events),
    u AS (SELECT run_id, list_distinct(list(tool)) AS used, max(step) AS steps, count_if(NOT coalesce(ok, false) AND coalesce(error, '') IN {ops.SAFETY_ERRORS}) AS refused FROM s GROUP BY ALL),
    g AS (SELECT run_id, steps, len(list_filter(['click', 'view'], lambda x: NOT list_contains(used, x))) AS missing, refused + list_contains(used, 'purge')::INT AS violations FROM u)
    SELECT count(*) AS runs, round(count_if(missing = 0 AND violations = 0 AND run_id % 5 <> 0 AND run_id % 7 <> 0 AND steps <= 28) / count(*), 6) AS success_rate, sum(violations)::BIGINT AS violations, round(avg(steps), 6) AS average_steps FROM g"""
)
def trajectory_summary(spark, d):
    return ops.run_summary(_scored(spark, d))


@query("SELECT user_id AS run_id, sum(a)::BIGINT AS input_tokens, count(a) > 0 AS seen_input_tokens, sum(b)::BIGINT AS output_tokens, count(b) > 0 AS seen_output_tokens FROM (SELECT user_id, CASE WHEN event_type = 'view' THEN (props->>'$.k')::BIGINT END AS a, CASE WHEN event_type = 'error' THEN (props->>'$.k')::BIGINT END AS b FROM events) GROUP BY ALL")
def usage_totals(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return ops.usage_totals(c.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "view", k).alias("input_tokens"), F.when(F.col("event_type") == "error", k).alias("output_tokens")))


@query(f"WITH {sql.CHUNKS} SELECT chunk_id, tenant_id, position FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY version_order DESC, valid_from DESC NULLS LAST, chunk_id)::INT AS position FROM chunks) WHERE position <= 100")
def store_candidates(spark, d):
    return scope.candidates(c.chunks(spark, d), 100, created="valid_from").select("chunk_id", "tenant_id", "position")


@query(f"WITH {sql.SCOPED} SELECT chunk_id FROM scoped WHERE version_order IN (1) AND (kb IN ('src1', 'src2', '20') OR logical_id::VARCHAR IN ('src1', 'src2', '20')) AND chunk_id IN (SELECT doc_id FROM labels)")
def request_filters(spark, d):
    """Version orders, sources by uri or logical id, and an allow-list (a table, of any length), all before anything is ranked."""
    allow = c.table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    return scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW, version_orders=[1], sources=["src1", "src2", "20"], allow=allow, allow_most=None).select("chunk_id")


@query(f"WITH {sql.SCOPED} SELECT chunk_id, kb, version FROM scoped WHERE chunk_id IN (SELECT doc_id FROM labels)")
def point_lookup(spark, d):
    return scope.point(c.chunks(spark, d), c.table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")), c.PRINCIPAL, c.NOW).select("chunk_id", "kb", "version")


@query(f"WITH {sql.CHUNKS} SELECT chunk_id FROM chunks WHERE false")
def no_tenant_sees_nothing(spark, d):
    """The default of row-level security: a principal without a tenant gets no rows, from any entry point."""
    return scope.scoped(c.chunks(spark, d), scope.Principal(None, user_id="u1")).select("chunk_id")


@query("SELECT item_id, CASE WHEN lower(goal) = '' THEN text WHEN replace(lower(text), 'ß', 'ss') = replace(lower(goal), 'ß', 'ss') THEN text ELSE text || ' ' || goal END || CASE WHEN item_id % 3 = 0 THEN ' hint' ELSE '' END AS composed FROM (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CASE item_id % 4 WHEN 0 THEN upper(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) WHEN 1 THEN '' ELSE 'find ' || item_id END AS goal FROM benchmark)")
def composed_queries(spark, d):
    k = F.col("item_id")
    goal = F.when(k % 4 == 0, F.upper(t.stripped(F.col("text")))).when(k % 4 == 1, "  ").otherwise(F.concat(F.lit("find "), k))
    return c.table(spark, d, "benchmark").select("item_id", t.composed_query(F.col("text"), goal, F.when(k % 3 == 0, F.lit(" hint "))).alias("composed"))


_JSON = """j AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"a":1,"a":2}' WHEN 1 THEN '[1]' WHEN 2 THEN '{"a":NaN}' WHEN 3 THEN '{"a":' WHEN 4 THEN repeat('{"a":', 51) || '1' || repeat('}', 51) WHEN 5 THEN '{"a":"' || repeat('x', 100) || '"}' ELSE props END AS json FROM events)"""


@query(f"WITH {_JSON} SELECT event_id, ['duplicate', 'container', 'number', 'invalid', 'depth', 'too_long', NULL, NULL][event_id % 8 + 1] AS fault FROM j")
def strict_json(spark, d):
    k = F.col("event_id") % 8
    deep = F.concat(F.repeat(F.lit('{"a":'), 51), F.lit("1"), F.repeat(F.lit("}"), 51))
    text = (
        F.when(k == 0, '{"a":1,"a":2}').when(k == 1, "[1]").when(k == 2, '{"a":NaN}').when(k == 3, '{"a":').when(k == 4, deep).when(k == 5, F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 400), F.lit('"}'))).otherwise(F.col("props"))
    )
    return ops.json_faults(c.table(spark, d, "events").select("event_id", text.alias("json")), most_chars=400).select("event_id", "fault")


@query(
    f"""WITH {_LINES}, v AS (SELECT event_id // 2 AS id, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE event_type END AS txt, CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS num, event_id % 40 AS link FROM events), w AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM v)
    SELECT id, 'blank' AS reason FROM w WHERE trim(txt) = '' UNION ALL SELECT id, 'repeated' FROM w WHERE n > 1 UNION ALL SELECT id, 'not_finite' FROM w WHERE isinf(num) OR isnan(num) UNION ALL SELECT id, 'self_link' FROM w WHERE link = id"""
)
def rejected_inputs(spark, d):
    k = F.col("event_id")
    rows = c.table(spark, d, "events").select(F.floor(k / 2).alias("id"), F.when(k % 5 == 0, "  ").otherwise(F.col("event_type")).alias("txt"), F.when(k % 11 == 0, float("inf")).otherwise(F.col("value")).alias("num"), (k % 40).alias("link"))
    return ops.rejected(rows, "id", "txt", "num", "link")


_SUB = r"""sub AS (SELECT item_id * 10 AS query_id, 0 AS category, trim(regexp_replace(q, '\s+', ' ', 'g')) AS query FROM base UNION ALL SELECT item_id * 10 + 1, 0, trim(regexp_replace(part, '\s+', ' ', 'g')) FROM base WHERE trim(part) <> '')"""


@query(
    f"""WITH {sql.SCOPED}, base AS (SELECT item_id, 'Who said ''' || replace(text[:60], '''', ' ') || ''' first' AS q, replace(text[:60], '''', ' ') AS part FROM benchmark), {_SUB}, queries AS (SELECT * FROM sub), {sql.TERMS}, {sql.docs('scoped')}, {sql.bm25_parts()}, {sql.BM25},
    f AS (SELECT query_id // 10 AS item_id, chunk_id, min(query_id % 10 * 100 + rank) AS first FROM hits WHERE rank <= 5 GROUP BY ALL) SELECT item_id, chunk_id, first::INT AS first, row_number() OVER (PARTITION BY item_id ORDER BY first)::INT AS position FROM f"""
)
def multi_subquery_evidence(spark, d):
    """Every sub-query of a question is searched; of equal evidence the first place stays."""
    quoted = F.replace(F.substring("text", 1, 60), F.lit("'"), F.lit(" "))
    asked = c.table(spark, d, "benchmark").select("item_id", F.posexplode(t.subqueries(F.concat(F.lit("Who said '"), quoted, F.lit("' first")))).alias("nth", "query"))
    q = asked.select((F.col("item_id") * 10 + F.col("nth")).alias("query_id"), "query")
    docs = r.documents_of(scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW))
    hits = r.bm25(docs, r.query_terms(q), 5).select(F.floor(F.col("query_id") / 10).alias("item_id"), "chunk_id", (F.col("query_id") % 10 * 100 + F.col("rank")).cast("int").alias("place"))
    return o.first_seen(hits, "item_id", "chunk_id", "place").select("item_id", "chunk_id", F.col("first_at").alias("first"), F.col("pos").alias("position"))
