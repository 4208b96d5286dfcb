"""Review cases, composite retrieval, context, streams."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import cases, chunking
from ..operators import retrieval as r
from ..operators.staging import shared_root
from ..sources import corpus as c
from ..streaming import streams
from . import sql
from .catalog import query
from .graph_queries import GRAPH_VOTES, linked
from .operations_queries import _SLOTS, _runs, _slots
from .retrieval_queries import _LEXICAL, governed


@query(f"WITH {_SLOTS}, last AS (SELECT plan_id, slot_id, arg_max(status, attempt) AS status, max(attempt) AS attempt FROM runs GROUP BY ALL) SELECT plan_id, slot_id::INT AS slot_id, attempt::INT AS attempt FROM slots JOIN last USING (plan_id, slot_id) WHERE status = 'failed' AND attempt >= max_attempts")
def exhausted_attempts(spark, d):
    return cases.exhausted(_slots(spark, d), _runs(spark, d))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def enqueue_new(spark, d):
    stored = c.table(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("run_id"))
    return c.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")).join(stored, "run_id", "left_anti")


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'free' WHEN ts <= TIMESTAMP '2024-01-15' THEN 'expired' ELSE 'held' END AS state, event_id % 7 + CASE WHEN user_id % 4 = 0 OR ts <= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS token FROM events")
def execution_takeover(spark, d):
    e = c.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("owner"), F.col("ts").cast("timestamp").alias("expires_at"), (F.col("event_id") % 7).alias("token"))
    return cases.take_over(e, datetime(2024, 1, 15)).select("event_id", "state", "token")


@query(
    """WITH f AS (SELECT event_type || (user_id % 20) AS fact_key, event_id // 2 AS source_run, row_number() OVER (PARTITION BY event_type || (user_id % 20) ORDER BY event_id) AS version FROM events WHERE event_id % 4 = 0),
    cl AS (SELECT event_type || (user_id % 20) AS fact_key, event_id // 2 AS source_run, event_id AS value FROM events WHERE event_id % 2 = 0), h AS (SELECT fact_key, max(version) AS head FROM f GROUP BY ALL)
    SELECT fact_key, source_run, value, coalesce(head, 0) + row_number() OVER (PARTITION BY fact_key ORDER BY source_run) AS version FROM cl LEFT JOIN h USING (fact_key) WHERE (fact_key, source_run) NOT IN (SELECT fact_key, source_run FROM f)"""
)
def claim_projection(spark, d):
    from pyspark.sql import Window

    e = c.table(spark, d, "events").withColumn("fact_key", F.concat("event_type", F.col("user_id") % 20)).withColumn("source_run", F.floor(F.col("event_id") / 2))
    facts = e.where("event_id % 4 = 0").select("fact_key", "source_run", F.row_number().over(Window.partitionBy("fact_key").orderBy("event_id")).alias("version"))
    return cases.project_claims(e.where("event_id % 2 = 0").select("fact_key", "source_run", F.col("event_id").alias("value")), facts).withColumn("version", F.col("version").cast("long"))


@query(
    """WITH h AS (SELECT o_orderkey AS fact_id, o_custkey % 50 AS fact_key, o_orderkey % 3 AS value_hash, o_orderstatus AS authority FROM orders), rc AS (SELECT o_orderkey AS receipt_id, o_custkey % 50 AS fact_key, o_orderkey % 3 AS value_hash, o_orderstatus AS authority FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 4 <> 0),
    one AS (SELECT * FROM (SELECT fact_id, receipt_id, row_number() OVER (PARTITION BY fact_id ORDER BY receipt_id) AS n FROM h JOIN rc USING (fact_key, value_hash, authority)) WHERE n = 1)
    SELECT fact_id, receipt_id FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY fact_id) AS m FROM one) WHERE m = 1"""
)
def receipt_consumption(spark, d):
    o = c.table(spark, d, "orders")
    k = F.col("o_orderkey")
    key = [(F.col("o_custkey") % 50).alias("fact_key"), (k % 3).alias("value_hash"), F.col("o_orderstatus").alias("authority")]
    receipts = o.where(k % 10 == 0).select(k.alias("receipt_id"), *key, F.when(k % 4 == 0, k).alias("consumed_by"))
    return cases.consume_receipts(o.select(k.alias("fact_id"), *key), receipts)


@query("SELECT role, content_hash, first_at AS \"at\", row_number() OVER (PARTITION BY role ORDER BY first_at, content_hash)::INT AS pos FROM (SELECT role, md5(text[:40]) AS content_hash, min(conv_id * 1000 + turn) AS first_at FROM conversations WHERE conv_id % 5 <> 0 GROUP BY ALL)")
def private_memories(spark, d):
    expires = F.when(F.col("conv_id") % 5 == 0, F.lit(datetime(2024, 1, 1)))
    rows = c.table(spark, d, "conversations").select("role", F.md5(F.substring("text", 1, 40)).alias("content_hash"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), expires.alias("expires_at"))
    return cases.private_memory(rows, c.NOW)


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN '{\"omitted\":true,\"size\":' || length(text) || ',\"sha256\":\"' || sha256(text) || '\"}' ELSE text END AS value, CASE WHEN length(text) <= 80 THEN text ELSE text[:79] || '…' END AS clip FROM conversations")
def bounded_values(spark, d):
    return c.table(spark, d, "conversations").select("conv_id", "turn", cases.bounded_value(F.col("text"), 200).alias("value"), cases.clipped(F.col("text"), 80).alias("clip"))


@query("SELECT s_suppkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE array_to_string(list_sort(list_intersect(string_split(a, ','), string_split(b, ','))), ',') END AS allowed FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'x,y,z' END AS a, CASE WHEN s_suppkey % 4 <> 0 THEN 'y,z' || (s_suppkey % 2) || ',z' END AS b FROM supplier)")
def filter_intersection(spark, d):
    k = F.col("s_suppkey")
    a, b = F.when(k % 3 != 0, F.split(F.lit("x,y,z"), ",")), F.when(k % 4 != 0, F.split(F.concat(F.lit("y,z"), k % 2, F.lit(",z")), ","))
    both = cases.both_or_either(a, b)
    return c.table(spark, d, "supplier").select("s_suppkey", F.when(both.isNotNull(), F.array_join(F.when(a.isNotNull() & b.isNotNull(), F.array_sort(both)).otherwise(both), ",")).alias("allowed"))


@query("SELECT c_custkey, coalesce(u, ud) AS user_id, coalesce(o, od) AS org_id, (u IS NOT NULL AND ud IS NOT NULL AND u <> ud)::INT + (o IS NOT NULL AND od IS NOT NULL AND o <> od)::INT AS conflicts FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END AS u, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 END AS ud, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS o, c_custkey % 2 AS od FROM customer)")
def identity_check(spark, d):
    k = F.col("c_custkey")
    rows = c.table(spark, d, "customer").select("c_custkey", F.when(k % 3 != 0, k % 7).alias("user_id"), F.when(k % 4 != 0, k % 6).alias("user_id_declared"), F.when(k % 5 != 0, F.lit(1).cast("long")).alias("org_id"), (k % 2).alias("org_id_declared"))
    return cases.reconciled(rows, ["user_id", "org_id"])


@query("SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN 'title: ' || lang END, CASE WHEN trim(source) <> '' THEN 'source: ' || trim(source) END, CASE WHEN doc_id % 3 = 0 THEN 'published_at: ' || doc_id END) AS header FROM documents")
def evidence_headers(spark, d):
    k = F.col("doc_id")
    return c.table(spark, d, "documents").select("doc_id", cases.evidence_header(F.when(k % 2 == 0, F.col("lang")), F.col("source"), F.when(k % 3 == 0, k.cast("string")).otherwise(" ")).alias("header"))


@query(
    """WITH l AS (SELECT l_orderkey AS case_id, l_linenumber * 1000 + l_partkey % 10 AS line, ['r' || (l_suppkey % 5), CASE WHEN l_partkey % 2 = 0 THEN 'p' || (l_partkey % 9) ELSE '' END, 's' || (l_suppkey % 5)] AS refs FROM lineitem),
    x AS (SELECT case_id, line, unnest(refs) AS ref, generate_subscripts(refs, 1) AS place FROM l), f AS (SELECT case_id, ref, min(line * 10 + place) AS first FROM x WHERE ref <> '' GROUP BY ALL)
    SELECT case_id, ref, row_number() OVER (PARTITION BY case_id ORDER BY first, ref)::INT AS pos FROM f"""
)
def citation_lists(spark, d):
    line = F.col("l_linenumber") * 1000 + F.col("l_partkey") % 10
    of = lambda name, number: F.concat(F.lit(name), number)
    rows = c.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), line.alias("line"), F.array(of("r", F.col("l_suppkey") % 5)).alias("refs"), F.when(F.col("l_partkey") % 2 == 0, of("p", F.col("l_partkey") % 9)).otherwise("").alias("citation"), of("s", F.col("l_suppkey") % 5).alias("source")
    )
    return cases.citation_list(rows, "case_id", F.col("refs"), ["citation", "source"])


@query("SELECT event_id, list_has_any(list_transform(json_keys(m), lambda k: regexp_replace(lower(k), '[^a-z0-9]', '', 'g')), ['workspaceroot', 'workspacepath', 'artifactroot', 'artifactpath', 'skillpackid', 'baseagentprofileid']) AS reserved FROM (SELECT event_id, '{\"' || CASE event_id % 4 WHEN 0 THEN 'Workspace-Root' WHEN 1 THEN 'note' WHEN 2 THEN 'ARTIFACT path' ELSE 'rooted' END || '\":\"1\"}' AS m FROM events)")
def reserved_metadata(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("Workspace-Root", "note", "ARTIFACT path", "rooted"))), (F.col("event_id") % 4 + 1).cast("int"))
    return c.table(spark, d, "events").select("event_id", cases.reserved_keys(F.concat(F.lit('{"'), name, F.lit('":"1"}'))).alias("reserved"))


@query("SELECT l_orderkey AS block, round(min(least(600.0, greatest(0.0, x - 500))), 3) AS x0, round(min(least(800.0, greatest(0.0, y))), 3) AS top, round(max(least(600.0, greatest(0.0, x))), 3) AS x1, round(max(least(800.0, greatest(0.0, y + 7))), 3) AS bottom FROM (SELECT l_orderkey, (l_partkey % 1300)::DOUBLE AS x, (l_suppkey * 3 % 900)::DOUBLE AS y FROM lineitem) GROUP BY ALL")
def union_boxes(spark, d):
    x, y = (F.col("l_partkey") % 1300).cast("double"), (F.col("l_suppkey") * 3 % 900).cast("double")
    return cases.union_box(c.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), (x - 500).alias("x0"), y.alias("top"), x.alias("x1"), (y + 7).alias("bottom")), "block", 600.0, 800.0)


@query("SELECT doc_id, sha256(text) = CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS intact FROM documents")
def signature_check(spark, d):
    signed = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return c.table(spark, d, "documents").select("doc_id", (F.sha2("text", 256) == signed).alias("intact"))


@query(
    f"""WITH {_LEXICAL}, {GRAPH_VOTES}, lists AS (SELECT 'lexical' AS list, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank FROM lexical
      UNION ALL SELECT 'graph', query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY contribution DESC, document_id) FROM gv),
    f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists WHERE rank <= 12 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f) WHERE rank <= 10"""
)
def graph_lexical_fused(spark, d):
    graph = linked(spark, d).select(F.lit("graph").alias("list"), "query_id", F.col("document_id").alias("chunk_id"), "rank")
    found = r.lexical_top(*governed(spark, d), 12).select(F.lit("lexical").alias("list"), "query_id", "chunk_id", "rank")
    return r.rrf(found.unionByName(graph)).drop("lists")


_END = "CASE WHEN {0} + 800 >= length(text) THEN length(text) WHEN contains(substring(text, {0} + 401, 400), chr(10)) THEN {0} + 400 + length(substring(text, {0} + 401, 400)) - length(regexp_extract(substring(text, {0} + 401, 400), '[^\n]*$')) ELSE {0} + 800 END"


@query(
    f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS a, ({_END.format('0')})::BIGINT AS b FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, text, a2, {_END.format('a2')} FROM (SELECT doc_id, text, greatest(a + 1, b - 100) AS a2, b FROM w) WHERE b < length(text)),
    c AS (SELECT doc_id, a::INT AS start, b::INT AS "end", regexp_replace(substring(text, a + 1, b - a), '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g') AS body FROM w) SELECT doc_id, start, "end", md5(body) AS text_md5 FROM c WHERE body <> ''"""
)
def newline_chunks(spark, d):
    docs = c.table(spark, d, "documents")
    return docs.select("doc_id", F.inline(chunking.newline_chunks(F.col("text"), 800, 100))).withColumn("text_md5", F.md5("text")).drop("text")


def _stream_root(spark) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _drained(spark, d, transform) -> "object":
    """A stream over the folder's events, drained into Parquet in the shared folder and read back."""
    schema = c.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    root = _stream_root(spark)
    out = transform(source)
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("SELECT event_id, event_type FROM events GROUP BY ALL")
def stream_audit_dedup(spark, d):
    return _drained(spark, d, lambda e: streams.idempotent(e.unionByName(e)).select("event_id", "event_type"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL")
def stream_windows(spark, d):
    """Closed windows only: append mode gives a day once the watermark, a day behind the newest event, has passed its end."""
    out = _drained(spark, d, lambda e: streams.rolling_metrics(e))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, coalesce((ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR)::INT, 1) AS opens FROM events)),
    c AS (SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s.n) SELECT user_id, start, n FROM c WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
)
def stream_sessions(spark, d):
    """Closed sessions: those whose end the watermark has passed."""
    out = _drained(spark, d, lambda e: streams.sessions(e, "6 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id AS run_id, (max(ts) + INTERVAL 300 SECOND)::TIMESTAMP AS expired_at FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 300 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_lease_expiry(spark, d):
    """Users as jobs, events as heartbeats: the timers that the watermark, an hour behind the newest event, has passed."""
    out = _drained(spark, d, lambda e: streams.lease_expiry(e.select(F.col("user_id").alias("run_id"), "ts")))
    return out.select("run_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark, d):
    schema, root = c.table(spark, d, "events").schema, _stream_root(spark)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("user_id", "event_id", "event_type")
    q = source.writeStream.foreachBatch(streams.keep_latest(f"{root}/out", "user_id", "event_id", 16)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "event_id", "event_type")


@query("SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events")
def checkpoint_versions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id")
    e = c.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    return e.select("run_id", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("version"), (F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))) == 1).alias("is_latest"))


@query("SELECT o_orderkey || ':' || k AS chunk_id, 'user:' || o_custkey AS acl, 'case-' || o_orderkey AS kb, ('Evidence ' || k || ' of order ' || o_orderkey || ': ' || o_orderpriority)[:40] AS text FROM orders, range(1, 3) x(k)")
def evidence_chunks(spark, d):
    """Evidence references of a case as private chunks of a knowledge base of its own."""
    o = c.table(spark, d, "orders").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.concat(F.lit("Evidence "), "k", F.lit(" of order "), "o_orderkey", F.lit(": "), "o_orderpriority")
    return o.select(F.concat("o_orderkey", F.lit(":"), "k").alias("chunk_id"), F.concat(F.lit("user:"), "o_custkey").alias("acl"), F.concat(F.lit("case-"), "o_orderkey").alias("kb"), F.substring(text, 1, 40).alias("text"))
