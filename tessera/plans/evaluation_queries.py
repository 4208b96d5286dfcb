"""Retrieval metrics, answer metrics, sampling, split checks."""

from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators import orchestration as o
from ..operators import retrieval as r
from ..sources import corpus as c
from . import sql
from .catalog import query
from .retrieval_queries import governed


def _retrieved(spark, d):
    """Ungoverned BM25 over all documents."""
    docs = r.documents_of(c.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    terms = r.query_terms(c.queries(spark, d))
    return r.bm25(docs, terms, 10).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("doc"), "rank")


def _metrics(spark, d):
    """Benchmark items as cases, and one more that nobody answers."""
    lost = spark.range(1).select(F.lit(-1).cast("long").alias("case_id"), F.lit(0).cast("long").alias("category"), F.lit(0).cast("long").alias("doc"))
    cases = c.queries(spark, d).select(F.col("query_id").alias("case_id"), "category").unionByName(lost.drop("doc"))
    return e.case_metrics(cases, _retrieved(spark, d), c.relevance(spark, d).unionByName(lost.drop("category")))


_M = f"""{sql.RELEVANCE.replace('relevant AS (SELECT', 'relevant AS (SELECT -1 AS case_id, 0 AS doc UNION ALL SELECT')}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('(SELECT doc_id AS chunk_id, text FROM documents)')}, {sql.bm25_parts()}, {sql.BM25},
    ret AS (SELECT query_id AS case_id, chunk_id AS doc, rank FROM hits WHERE rank <= 10), nr AS (SELECT case_id, count(*) AS n FROM relevant GROUP BY ALL), hit AS (SELECT case_id, rank FROM ret JOIN relevant USING (case_id, doc)),
    m AS (SELECT case_id, category, case_id IN (SELECT case_id FROM ret) AS answered, {', '.join(f"(SELECT count(*) FROM hit h WHERE h.case_id = nr.case_id AND rank <= {k}) / n AS recall_{k}, coalesce((SELECT 1 / min(rank) FROM hit h WHERE h.case_id = nr.case_id AND rank <= {k}), 0) AS rr_{k}, coalesce((SELECT sum(1 / log2(rank + 1)) FROM hit h WHERE h.case_id = nr.case_id AND rank <= {k}), 0) / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}" for k in (1, 5, 10))}
      FROM nr JOIN (SELECT query_id AS case_id, category FROM queries UNION ALL SELECT -1, 0) USING (case_id))"""


def _rounded(name: str) -> str:
    return ", ".join(f"round({name}_{k}, 6) AS {name}_{k}" for k in (1, 5, 10))


@query(f"WITH {_M} SELECT case_id, category, {_rounded('recall')} FROM m")
def recall_at_k(spark, d):
    return _metrics(spark, d).select("case_id", "category", *(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 5, 10)))


@query(f"WITH {_M} SELECT case_id, {_rounded('rr')} FROM m")
def mrr_at_k(spark, d):
    return _metrics(spark, d).select("case_id", *(F.round(f"rr_{k}", 6).alias(f"rr_{k}") for k in (1, 5, 10)))


@query(f"WITH {_M} SELECT case_id, {_rounded('ndcg')} FROM m")
def ndcg_at_k(spark, d):
    return _metrics(spark, d).select("case_id", *(F.round(f"ndcg_{k}", 6).alias(f"ndcg_{k}") for k in (1, 5, 10)))


@query(f"WITH {_M} SELECT category, count(*) AS cases, count_if(NOT answered)::BIGINT AS missing, round(avg(recall_10), 6) AS recall_10, round(avg(rr_10), 6) AS rr_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM m GROUP BY ROLLUP (category)")
def eval_summary(spark, d):
    return e.summary(_metrics(spark, d), ["recall_10", "rr_10", "ndcg_10"])


def _answers(spark, d):
    t = c.table(spark, d, "conversations").where("role = 'assistant'")
    words = F.split("text", " ")
    gold = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k.alias("candidate_id"), F.array_join(F.slice(words, 1, 4 + k), " ").alias("expected")))
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.array_join(F.slice(words, F.when(F.col("conv_id") % 3 == 0, 1).otherwise(2), 5), " ").alias("prediction"), F.inline(gold))
    return rows


_ANS = r"""t AS (SELECT conv_id * 1000 + turn AS case_id, conv_id, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant'),
    a AS (SELECT case_id, k AS candidate_id, array_to_string(list_slice(w, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END, CASE WHEN conv_id % 3 = 0 THEN 5 ELSE 6 END), ' ') AS prediction, array_to_string(list_slice(w, 1, 4 + k), ' ') AS expected FROM t, range(3) x(k)),
    n AS (SELECT case_id, candidate_id, regexp_extract_all(replace(lower(prediction), ',', ''), '[A-Za-z0-9]+|[\x{3400}-\x{9FFF}]') AS p, regexp_extract_all(replace(lower(expected), ',', ''), '[A-Za-z0-9]+|[\x{3400}-\x{9FFF}]') AS e FROM a),
    s AS (SELECT case_id, (array_to_string(p, ' ') = array_to_string(e, ' '))::INT AS em, CASE WHEN len(p) > 0 AND len(e) > 0 THEN 2.0 * list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(e, lambda y: y = x))))) / (len(p) + len(e)) ELSE 0 END AS f1 FROM n)"""


@query(f"WITH {_ANS} SELECT case_id, max(em) AS exact_match, round(max(f1), 6) AS token_f1 FROM s GROUP BY case_id")
def answer_em_f1(spark, d):
    return e.answer_scores(_answers(spark, d))


@query(f"WITH {_ANS}, c AS (SELECT case_id, max(em) AS em, max(f1) AS f1 FROM s GROUP BY case_id) SELECT case_id % 4 AS category, count(*) AS cases, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS token_f1 FROM c GROUP BY ROLLUP (case_id % 4)")
def answer_summary(spark, d):
    s = e.answer_scores(_answers(spark, d)).withColumn("category", F.col("case_id") % 4)
    return s.rollup("category").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("exact_match"), 6).alias("exact_match"), F.round(F.avg("token_f1"), 6).alias("token_f1"))


@query("SELECT event_type, count(value) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return e.latency_summary(c.table(spark, d, "events"), "event_type", "value")


_CASES = "cases AS (SELECT doc_id AS case_id, lang AS category FROM documents)"


@query(
    f"""WITH {_CASES}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('20260804' || chr(0) || category || chr(0) || case_id), case_id)::INT AS turn, sha256('20260804' || chr(0) || category) AS ck FROM cases)
    SELECT case_id, category, turn FROM t ORDER BY turn, ck, category LIMIT 100"""
)
def stratified_sample(spark, d):
    return e.stratified_sample(c.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category")), 100, "20260804")


@query(f"WITH {_CASES}, m AS (SELECT unnest(range(60)) AS pos, unnest(range(60)) * 17 % 1200 AS case_id) SELECT pos::INT AS pos, case_id, category FROM m LEFT JOIN cases USING (case_id)")
def locked_split(spark, d):
    manifest = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (i * 17 % 1200).cast("long")).alias("case_ids"))
    return e.locked_cases(manifest, c.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category")))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src3')")
def missing_evidence(spark, d):
    return e.missing(c.table(spark, d, "labels"), c.table(spark, d, "documents").where("source != 'src3'"), "doc_id")


@query("SELECT text, count(*) AS n FROM (SELECT md5(text) AS text FROM documents) GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return e.duplicates(c.table(spark, d, "documents").select(F.md5("text").alias("text")), "text")


@query(f"WITH {sql.GOVERNED} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS retrieved, count(*) AS n FROM hits WHERE rank <= 10 GROUP BY ALL")
def prediction_lists(spark, d):
    docs, terms, _ = governed(spark, d)
    hits = r.bm25(docs, terms, 10)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"].cast("string"))
    return hits.groupBy("query_id").agg(F.array_join(ordered, ",").alias("retrieved"), F.count(F.lit(1)).alias("n"))


@query("SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, role)::INT AS pos FROM (SELECT conv_id, role, min(turn) AS first_at FROM conversations GROUP BY ALL)")
def first_seen(spark, d):
    return o.first_seen(c.table(spark, d, "conversations"), "conv_id", "role", "turn")


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def category_counts(spark, d):
    return c.table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"))
