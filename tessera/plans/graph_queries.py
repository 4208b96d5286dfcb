"""Phrase graph, governed paths, gate, fusion with budgets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import phrases as phrases_of
from ..operators import chunking
from ..operators import graph as g
from ..sources import corpus as c
from . import sql
from .catalog import query

_DP = f"dp AS (SELECT DISTINCT doc_id AS document_id, unnest({sql.PHRASES}) AS phrase FROM documents)"


def _doc_phrases(spark, d):
    return g.document_phrases(c.documents(spark, d).select(F.col("doc_id").alias("document_id"), "text"))


@query(f"WITH {_DP} SELECT phrase, count(*) AS n_documents, min(document_id) AS first_document FROM dp GROUP BY phrase")
def phrase_documents(spark, d):
    return _doc_phrases(spark, d).groupBy("phrase").agg(F.count(F.lit(1)).alias("n_documents"), F.min("document_id").alias("first_document"))


@query(f"WITH {_DP} SELECT DISTINCT x.document_id, y.document_id AS neighbour FROM dp x JOIN dp y ON x.phrase = y.phrase AND x.document_id <> y.document_id WHERE x.document_id % 100 = 0")
def cooccur_edges(spark, d):
    """All edges of the stated query set (ids divisible by 100), against all documents."""
    dp = _doc_phrases(spark, d)
    return g.edges_of(dp, dp.where("document_id % 100 = 0"))


@query(f"WITH {_DP}, e AS (SELECT DISTINCT x.document_id AS a, y.document_id AS b FROM dp x JOIN dp y ON x.phrase = y.phrase AND x.document_id < y.document_id) SELECT (SELECT count(*) FROM documents) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_size(spark, d):
    return g.size(c.table(spark, d, "documents").select(F.col("doc_id").alias("document_id")), _doc_phrases(spark, d))


GRAPH_VOTES = f"""{_DP}, gq AS (SELECT DISTINCT item_id AS query_id, unnest({sql.PHRASES}) AS phrase FROM benchmark), seeds AS (SELECT DISTINCT query_id, document_id AS seed FROM gq JOIN dp USING (phrase)),
    adj AS (SELECT DISTINCT x.document_id AS seed, y.document_id FROM dp x JOIN dp y ON y.phrase = x.phrase AND y.document_id <> x.document_id WHERE x.document_id IN (SELECT seed FROM seeds)),
    gv AS (SELECT query_id, document_id, sum(w)::BIGINT AS contribution FROM (SELECT query_id, seed AS document_id, 2 AS w FROM seeds UNION ALL SELECT query_id, document_id, 1 FROM seeds JOIN adj USING (seed)) GROUP BY ALL)"""


def linked(spark, d):
    """Documents of the phrase graph per benchmark item."""
    asked = c.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(phrases_of(F.col("text"))).alias("phrase")).distinct()
    return g.search(_doc_phrases(spark, d), asked)


@query(f"WITH {GRAPH_VOTES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY contribution DESC, document_id)::INT AS rank FROM gv) WHERE rank <= 12")
def cooccur_search(spark, d):
    return linked(spark, d)


_GRAPH = """n AS (SELECT p_partkey AS id, p_partkey % 7 <> 0 AS ok FROM part), e0 AS (SELECT l_orderkey * 10 + l_linenumber AS rel, l_partkey AS s, (l_partkey * 7 + l_linenumber) % (SELECT max(p_partkey) FROM part) + 1 AS t FROM lineitem WHERE l_linenumber <> 4),
    e AS (SELECT rel, s AS u, t AS v FROM e0 UNION ALL SELECT rel, t, s FROM e0), k AS (SELECT e.* FROM e JOIN n a ON a.id = u AND a.ok JOIN n b ON b.id = v AND b.ok),
    s AS (SELECT id AS seed FROM n WHERE ok AND id % 100 = 1), one AS (SELECT seed, v AS target, [rel] AS rels FROM s JOIN k ON seed = u WHERE v <> seed),
    two AS (SELECT seed, k.v AS target, list_append(rels, k.rel) AS rels FROM one JOIN k ON target = u WHERE NOT list_contains(rels, k.rel) AND k.v <> seed)"""


@query(f"WITH {_GRAPH} SELECT seed, target, 1 AS hops, rels[1]::VARCHAR AS relations FROM one UNION ALL SELECT seed, target, 2, array_to_string(rels, '>') FROM two")
def graph_paths_2hop(spark, d):
    parts = c.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"))
    most = parts.agg(F.max("entity_id")).scalar()
    k = F.col("l_partkey")
    relations = c.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relationship_id"), F.when(F.col("l_linenumber") == 4, "MENTIONS").otherwise("CITES").alias("relationship_type"),
        k.alias("source_id"), ((k * 7 + F.col("l_linenumber")) % most + 1).alias("target_id"),
    )
    seeds = parts.where("entity_id % 100 = 1").withColumn("query_id", F.lit(0))
    found = g.paths(parts, relations, seeds, F.col("entity_id") % 7 != 0, F.lit(True))
    return found.select("seed", "target", "hops", F.array_join(F.transform("relations", lambda x: x.cast("string")), ">").alias("relations"))


@query(
    """WITH g AS (SELECT s_suppkey AS id, s_suppkey % 9 <> 0 AS enabled, CASE WHEN s_suppkey % 8 <> 0 THEN s_suppkey % 6 END AS ev, s_suppkey % 5 AS h, s_suppkey % 11 AS safety, (s_suppkey % 10) / 100 AS improvement FROM supplier)
    SELECT id, reason, reason = 'gate_passed' AS opened FROM (SELECT id, CASE WHEN NOT enabled THEN 'config_disabled' WHEN ev IS NULL THEN 'evaluation_missing' WHEN ev = 0 THEN 'evaluation_identity_mismatch' WHEN h = 0 THEN 'evaluation_hash_mismatch'
      WHEN id % 13 = 0 THEN 'metric_mismatch' WHEN safety = 1 THEN 'safety_regression' WHEN improvement + 1e-12 < 0.03 THEN 'improvement_below_threshold' ELSE 'gate_passed' END AS reason FROM g)"""
)
def graph_gate(spark, d):
    k = F.col("s_suppkey")
    evidence = c.table(spark, d, "supplier").select(
        k.alias("id"), (k % 9 != 0).alias("enabled"), F.when(k % 8 != 0, k % 6).alias("evaluation_id"), F.when(k % 6 == 0, -1).otherwise(k % 6).alias("expected_id"), (k % 5).alias("content_hash"),
        F.when(k % 5 == 0, -1).otherwise(k % 5).alias("expected_hash"), F.when(k % 13 == 0, "other").otherwise("recall_at_5").alias("metric"), F.when(k % 11 == 1, 1).otherwise(0).alias("safety_violations"), ((k % 10) / 100).alias("improvement"),
    )
    return g.gate(evidence).select("id", "reason", "opened")


@query(
    """WITH RECURSIVE it AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    w AS (SELECT conv_id, n, CASE WHEN size <= 1000 THEN 1 ELSE 0 END AS kept, CASE WHEN size <= 1000 THEN size ELSE 0 END AS used, size <= 1000 AS take, turn FROM it WHERE n = 1
      UNION ALL SELECT it.conv_id, it.n, w.kept + (w.kept < 10 AND w.used + it.size <= 1000)::INT, w.used + CASE WHEN w.kept < 10 AND w.used + it.size <= 1000 THEN it.size ELSE 0 END, w.kept < 10 AND w.used + it.size <= 1000, it.turn FROM w JOIN it ON it.conv_id = w.conv_id AND it.n = w.n + 1)
    SELECT conv_id, turn FROM w WHERE take"""
)
def fusion_budget(spark, d):
    t = c.table(spark, d, "conversations").select("conv_id", F.struct("turn", F.length("text").alias("size")).alias("item"))
    packed = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("items"))  # one conversation's turns
    return packed.select("conv_id", F.inline(chunking.budget_skip(F.col("items"), "size", 10, 1000))).select("conv_id", "turn")


@query(
    f"""WITH {sql.QUERIES}, b AS (SELECT vec_id AS id, label AS grp, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS ra, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rb FROM embeddings),
    u AS (SELECT grp, id, 'hybrid' AS src, ra AS r FROM b WHERE ra <= 30 UNION ALL SELECT grp, id, 'graph', rb FROM b WHERE rb <= 30)
    SELECT grp, id, round(sum(CASE src WHEN 'hybrid' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END / (60 + r)), 9) AS score, string_agg(src || ':' || r, ' ' ORDER BY src) AS provenance FROM u GROUP BY ALL"""
)
def fusion_provenance(spark, d):
    e = c.table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"))
    ranked = lambda name, order: e.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(order))).where("r <= 30").withColumn("src", F.lit(name))
    both = ranked("hybrid", F.asc("id")).unionByName(ranked("graph", F.desc("id")))
    weight = F.when(F.col("src") == "hybrid", 1.0).otherwise(0.8)
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "r"))), lambda s: F.concat_ws(":", s["src"], s["r"].cast("string"))), " ")
    return both.groupBy("grp", "id").agg(F.round(F.sum(weight / (60 + F.col("r"))), 9).alias("score"), trail.alias("provenance"))
