"""Whole requests in one plan: scope, search, rerank, neighbours; hybrid lists; gated graph retrieval with fusion; cited context of both kinds."""

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import tokens
from ..operators import context, evaluation
from ..operators import graph as g
from ..operators import retrieval as r
from ..operators import scope
from ..operators.staging import staged
from ..sources import corpus as c
from . import sql
from .catalog import query
from .retrieval_queries import _COSINE, _LEX, _LEXICAL, _MEM, _asked_items, _fresh, _own_memory, _vectors, governed


def _passages_in_scope(spark, d):
    """Passages of the visible documents from some sources; staged, as search, reranking and neighbours read them."""
    seen = scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW, sources=["src1", "src2", "src3", "src4"]).select(F.col("chunk_id").alias("document_id"))
    return staged(c.passages(spark, d).join(seen, "document_id", "left_semi").select("chunk_id", "document_id", "idx", "text"), "passages")


@query(
    f"""WITH {sql.SCOPED}, {sql.PASSAGES}, mine AS (SELECT p.* FROM passages p JOIN scoped s ON s.chunk_id = p.document_id WHERE s.kb IN ('src1', 'src2', 'src3', 'src4')), {sql.QUERIES}, {sql.TERMS}, {sql.docs('mine')}, {sql.bm25_parts()}, {sql.BM25},
    c AS (SELECT query_id, chunk_id, score AS base_score FROM hits WHERE rank <= 15), q AS (SELECT query_id, list_distinct({sql.tok('query')}) AS q FROM queries),
    x AS (SELECT query_id, chunk_id, base_score, len(list_intersect(q, list_distinct(tokens))) AS shared, len(q) AS nq, len(list_distinct(tokens)) AS nd FROM c JOIN q USING (query_id) JOIN docs USING (chunk_id)),
    rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, base_score, round(.8::DOUBLE * shared / nq + .2::DOUBLE * shared / (nq + nd - shared), 6) AS score FROM x)), seeds AS (SELECT * FROM rr WHERE rank <= 3),
    f AS (SELECT query_id, chunk_id, score, 0 AS kind, rank, 0 AS side, 0 AS dist FROM seeds UNION ALL SELECT s.query_id, n.chunk_id, s.score * pow(0.75, abs(n.idx - p.idx)), 1, s.rank, CASE WHEN n.idx < p.idx THEN 1 ELSE 2 END, abs(n.idx - p.idx) FROM seeds s JOIN mine p USING (chunk_id) JOIN mine n ON n.document_id = p.document_id AND abs(n.idx - p.idx) = 1),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY kind, rank, side, dist) AS n FROM f) WHERE n = 1)
    SELECT query_id, chunk_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY kind, rank, side, dist)::INT AS position, kind = 0 AS is_seed FROM k"""
)
def scoped_search_with_neighbours(spark, d):
    p = _passages_in_scope(spark, d)
    docs, q = r.documents_of(p), c.queries(spark, d)
    seeds = r.rerank(r.bm25(docs, r.query_terms(q), 15), docs, q, 3)
    return r.neighbours(seeds, p, 1)


_SPARSE = f"""qsp AS (SELECT query_id, b, sum(n)::DOUBLE AS v FROM (SELECT query_id, ('0x' || substring(md5(term), 1, 15))::BIGINT % 2147483647 AS b, 1 AS n FROM (SELECT query_id, unnest({sql.tok('query')}) AS term FROM queries)) GROUP BY ALL),
    dsp AS (SELECT chunk_id, b, sum(n)::DOUBLE AS v FROM (SELECT chunk_id, ('0x' || substring(md5(term), 1, 15))::BIGINT % 2147483647 AS b, 1 AS n FROM (SELECT chunk_id, unnest({sql.tok('text')}) AS term FROM scoped)) GROUP BY ALL),
    sparse AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(q.v * d.v), 6) AS s FROM qsp q JOIN dsp d USING (b) GROUP BY ALL)),
    dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round({_COSINE}, 6) AS s FROM (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT query_id FROM queries)) JOIN (SELECT vec_id AS chunk_id, embedding FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM scoped)) ON true))"""


def _sparse(texts, id_col, text):
    """Sparse vectors of texts with hashed terms as dimensions (MD5, which any SQL engine has; ``retrieval.sparse_vectors`` has the source's own hash)."""
    bucket = t.md5_number(F.col("term")) % 2_147_483_647
    return texts.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(
    f"""WITH {sql.SCOPED}, {sql.QUERIES}, {_SPARSE}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM sparse WHERE rank <= 25 UNION ALL SELECT * FROM dense WHERE rank <= 25) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_scoped(spark, d):
    """Dense and sparse lists over what the principal may see, each cut to the scope before it is ranked, and the fusion checked against it again."""
    seen, q = scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW), c.queries(spark, d)
    ids = seen.select("chunk_id")
    sparse = r.sparse_top(_sparse(seen, "chunk_id", "text"), _sparse(q, "query_id", "query"), 25)
    dense = r.dense_top(_vectors(spark, d).join(ids, "chunk_id", "left_semi"), _asked_items(spark, d, q), 25)
    return r.hybrid({"dense": dense, "sparse": sparse}, ids).drop("lists")


@query(
    f"""WITH {_LEXICAL}, s AS (SELECT query_id, chunk_id, lexical, version_order, valid_from, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, version_order DESC, valid_from DESC NULLS LAST, chunk_id)::INT AS rank FROM lexical JOIN scoped USING (chunk_id))
    SELECT query_id, chunk_id, lexical, rank FROM s WHERE rank <= 10"""
)
def knowledge_hits(spark, d):
    docs, terms, q = governed(spark, d)
    facts = c.chunks(spark, d).select("chunk_id", "version_order", "valid_from")
    return r.top(r.lexical(docs, terms, q).join(facts, "chunk_id"), 10, "lexical", F.desc("version_order"), F.desc_nulls_last("valid_from")).select("query_id", "chunk_id", "lexical", "rank")


_RECALL = f"{_MEM}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('chunks')}, {sql.TF}, {_LEX}, rec AS (SELECT query_id, chunk_id AS memory_id, lexical, importance, updated_at, round(.80::DOUBLE * lexical + .15::DOUBLE * importance + .05::DOUBLE * fresh, 14) AS score FROM lexical JOIN fr USING (chunk_id) JOIN (SELECT chunk_id, updated_at FROM chunks) USING (chunk_id))"


def recalled(spark, d, k: int):
    """Memories per query in their full order: score, lexical, importance, last change, id."""
    q, m = c.queries(spark, d), _own_memory(spark, d)
    lexical = r.lexical(r.documents_of(m.select(F.col("memory_id").alias("chunk_id"), F.col("content").alias("text"))), r.query_terms(q), q).withColumnRenamed("chunk_id", "memory_id")
    both = lexical.join(m.select("memory_id", "content", "scope", "importance", "updated_at", _fresh().alias("fresh")), "memory_id")
    scored = both.withColumn("score", F.round(0.80 * F.col("lexical") + 0.15 * F.col("importance") + 0.05 * F.col("fresh"), r.FINE + 2))
    return r.top(scored, k, "score", F.desc("lexical"), F.desc("importance"), F.desc("updated_at"), id_col="memory_id")


@query(f"WITH {_RECALL} SELECT query_id, memory_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical DESC, importance DESC, updated_at DESC, memory_id)::INT AS rank FROM rec) WHERE rank <= 5")
def memory_hits(spark, d):
    return recalled(spark, d, 5).select("query_id", "memory_id", "score", "rank")


@query(
    f"""WITH RECURSIVE kn AS (WITH {sql.GOVERNED} SELECT query_id, 'knowledge' AS kind, chunk_id::VARCHAR AS item_id, kb AS uri, version, text AS content, score FROM hits JOIN scoped USING (chunk_id) WHERE rank <= 4),
    me AS (WITH {_RECALL} SELECT query_id, 'memory' AS kind, memory_id AS item_id, 'memory:' || scope AS uri, NULL AS version, content, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical DESC, importance DESC, updated_at DESC, memory_id) AS rank FROM rec) JOIN (SELECT memory_id, scope, content FROM memory) USING (memory_id) WHERE rank <= 3),
    it AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, item_id) AS n, count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT * FROM kn UNION ALL SELECT * FROM me)),
    w AS (SELECT DISTINCT query_id, total, 0 AS n, '' AS txt, 0 AS k, 0 AS m, false AS done, false AS cut FROM it
      UNION ALL SELECT query_id, total, n, CASE WHEN done OR stop THEN txt ELSE txt || gap || head || fin END, k + (NOT done AND NOT stop AND kind = 'knowledge')::INT, m + (NOT done AND NOT stop AND kind = 'memory')::INT, done OR stop OR tight, CASE WHEN done THEN cut ELSE cut OR stop OR capped OR tight END
      FROM (SELECT *, room <= 0 OR (tight AND room <= 1) AS stop, CASE WHEN tight THEN left(body, greatest(room - 1, 0)) || '…' ELSE body END AS fin
      FROM (SELECT *, length(body) > room AS tight FROM (SELECT *, 1200 - length(txt) - length(gap) - length(head) AS room, length(content) > cap AS capped, CASE WHEN length(content) > cap THEN left(content, cap - 1) || '…' ELSE content END AS body
      FROM (SELECT w.query_id, w.total, it.n, w.txt, w.k, w.m, w.done, w.cut, it.kind, it.content, CASE WHEN w.txt = '' THEN '' ELSE chr(10) || chr(10) END AS gap, CASE WHEN least(w.total, 4) <= 1 THEN 1200 ELSE greatest(24, 1200 // least(w.total, 4) - 64) END AS cap,
        '[' || CASE WHEN it.kind = 'knowledge' THEN 'K' || (w.k + 1) ELSE 'M' || (w.m + 1) END || '] ' || it.kind || ': ' || left(it.uri, 160) || CASE WHEN it.version IS NULL THEN '' ELSE '; version=' || it.version END || chr(10) AS head FROM w JOIN it ON it.query_id = w.query_id AND it.n = w.n + 1)))))
    SELECT query_id, md5(txt) AS text_md5, length(txt)::INT AS n_chars, (k + m)::INT AS n_items, m::INT AS n_memories, cut OR k + m < total AS truncated FROM w WHERE n = total"""
)
def context_pack(spark, d):
    """Knowledge and memories of each query, packed into 1,200 characters with their labels."""
    docs, terms, _ = governed(spark, d)
    hits = r.bm25(docs, terms, 4)
    texts = c.chunks(spark, d).select("chunk_id", "text", "kb", "version")
    knowledge = hits.join(texts, "chunk_id").select("query_id", F.lit("knowledge").alias("kind"), F.col("chunk_id").cast("string").alias("item_id"), F.col("kb").alias("source_uri"), "version", F.col("text").alias("content"), "score")
    memory = recalled(spark, d, 3).select("query_id", F.lit("memory").alias("kind"), F.col("memory_id").alias("item_id"), F.concat(F.lit("memory:"), "scope").alias("source_uri"), F.lit(None).cast("string").alias("version"), "content", "score")
    packed = context.assemble(knowledge.unionByName(memory), 1200)
    memories = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\[M[0-9]+\] memory: "), F.lit(0)))
    return packed.select("query_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "n_items", memories.alias("n_memories"), "truncated")


_NODES = """n AS (SELECT p_partkey AS id, p_partkey % 7 <> 0 AND p_size >= 3 AND list_has_any(['tenant', 'role:reviewer'], [CASE WHEN p_partkey % 5 = 0 THEN 'user:u9' ELSE 'tenant' END]) AS ok FROM part)"""
_PATHS = f"""{_NODES}, e0 AS (SELECT l_orderkey * 10 + l_linenumber AS rel, l_partkey AS s, (l_partkey * 7 + l_linenumber) % (SELECT max(p_partkey) FROM part) + 1 AS t, (l_quantity / 100)::DOUBLE AS w FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WHERE l_linenumber <> 4 AND l_orderkey % 7 <> 0 AND l_suppkey >= 3 AND l_orderkey % 5 <> 0),
    e AS (SELECT rel, s AS u, t AS v, w FROM e0 UNION ALL SELECT rel, t, s, w FROM e0), k AS (SELECT e.* FROM e JOIN n a ON a.id = u AND a.ok JOIN n b ON b.id = v AND b.ok),
    sd AS (SELECT item_id AS query_id, item_id * 3 + 1 AS seed FROM benchmark WHERE item_id * 3 + 1 IN (SELECT id FROM n WHERE ok)), one AS (SELECT query_id, seed, v AS target, [rel] AS rels, w FROM sd JOIN k ON seed = u WHERE v <> seed),
    two AS (SELECT query_id, seed, k.v AS target, list_append(rels, k.rel) AS rels, one.w * k.w * 0.5 AS w FROM one JOIN k ON target = u WHERE NOT list_contains(rels, k.rel) AND k.v <> seed),
    p AS (SELECT *, 1 AS hops FROM one UNION ALL SELECT *, 2 FROM two), b AS (SELECT * FROM (SELECT *, round(w, 6) AS score, row_number() OVER (PARTITION BY query_id, target ORDER BY round(w, 6) DESC, hops, rels) AS n FROM p) WHERE n = 1),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS rank FROM b) WHERE rank <= 20)"""


def _found_paths(spark, d):
    """Entities and relations with tenant, access list, version and validity; a benchmark item's seed is the part of three times its number."""
    acl = lambda k: F.when(k % 5 == 0, F.array(F.lit("user:u9"))).otherwise(F.array(F.lit("tenant")))
    tenant = lambda k: F.when(k % 7 == 0, "t2").otherwise("t1")
    none = F.lit(None).cast("timestamp")
    parts = c.table(spark, d, "part")
    k = F.col("p_partkey")
    old = lambda x: F.when(x < 3, F.to_timestamp(F.lit("2024-01-01")))
    entities = parts.select(k.alias("entity_id"), tenant(k).alias("tenant_id"), acl(k).alias("acl"), none.alias("valid_from"), old(F.col("p_size")).alias("valid_until"))
    most, o, n = parts.agg(F.max("p_partkey")).scalar(), F.col("l_orderkey"), F.col("l_linenumber")
    lines = c.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(x).alias(x) for x in ("l_partkey", "l_suppkey", "l_quantity")))  # (order, line) repeats
    relations = lines.select(
        (o * 10 + n).alias("relationship_id"), F.when(n == 4, "MENTIONS").otherwise("CITES").alias("relationship_type"), F.col("l_partkey").alias("source_id"), ((F.col("l_partkey") * 7 + n) % most + 1).alias("target_id"),
        (F.col("l_quantity") / 100).cast("double").alias("weight"), tenant(o).alias("tenant_id"), acl(o).alias("acl"), none.alias("valid_from"), old(F.col("l_suppkey")).alias("valid_until"),
    )
    seeds = c.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 3 + 1).alias("entity_id"))
    return g.governed_paths(entities, relations, seeds, scope.visible(c.PRINCIPAL) & scope.valid_at(c.NOW), min(20, 50))


@query(f"WITH {_PATHS} SELECT query_id, seed, target, hops, score, array_to_string(rels, '>') AS relations, rank::INT AS rank FROM found")
def graph_paths_governed(spark, d):
    return _found_paths(spark, d).withColumn("relations", F.array_join(F.transform("relations", lambda x: x.cast("string")), ">"))


@query(
    f"""WITH RECURSIVE g AS (WITH {_PATHS} SELECT query_id, target AS item, rank FROM found), h AS (WITH {sql.GOVERNED} SELECT query_id, chunk_id AS item, rank FROM hits WHERE rank <= 10), op AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 <> 0),
    l AS (SELECT query_id, item, 'hybrid' AS src, rank FROM h UNION ALL SELECT query_id, item, 'graph', rank FROM g WHERE query_id IN (SELECT query_id FROM op)),
    f AS (SELECT query_id, item, round(sum(CASE src WHEN 'hybrid' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END / (60 + rank)), 9) AS score, string_agg(src || ':' || rank, ' ' ORDER BY src) AS provenance FROM l GROUP BY ALL),
    it AS (SELECT f.*, length(text) AS size, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS n FROM f JOIN documents ON doc_id = item),
    w AS (SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS kept, 0::BIGINT AS used, false AS take FROM it GROUP BY ALL UNION ALL SELECT it.query_id, it.n, kept + (kept < 8 AND used + size <= 6000)::INT, used + CASE WHEN kept < 8 AND used + size <= 6000 THEN size ELSE 0 END, kept < 8 AND used + size <= 6000 FROM w JOIN it ON it.query_id = w.query_id AND it.n = w.n + 1)
    SELECT query_id, item, score, provenance, kept::INT AS position FROM w JOIN it USING (query_id, n) WHERE take"""
)
def gated_graph_fusion(spark, d):
    """Hybrid hits and graph paths, where the query's gate is open, fused with their provenance under a budget of 8 items and 6,000 characters."""
    docs, terms, q = governed(spark, d)
    k = F.col("query_id")
    evidence = q.select(
        "query_id", F.lit(True).alias("enabled"), F.lit(1).alias("evaluation_id"), F.lit(1).alias("expected_id"), F.lit("h").alias("content_hash"), F.lit("h").alias("expected_hash"), F.lit("recall_at_5").alias("metric"),
        F.lit(0).alias("safety_violations"), F.when(k % 3 == 0, 0.01).otherwise(0.05).alias("improvement"),
    )
    hits = r.bm25(docs, terms, 10).select("query_id", F.col("chunk_id").alias("item"), "rank")
    paths = _found_paths(spark, d).select("query_id", F.col("target").alias("item"), "rank")
    sizes = c.table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.length("text").alias("size"))
    return g.fuse(hits, paths, g.gate(evidence), sizes, 8, 6000)


_EVAL = """nr AS (SELECT case_id, count(*) AS n FROM relevant GROUP BY ALL), hit AS (SELECT stage, case_id, rank FROM ret JOIN relevant USING (case_id, doc)),
    m AS (SELECT st.stage, nr.case_id, category, (SELECT count(*) FROM hit h WHERE h.stage = st.stage AND h.case_id = nr.case_id) / n AS recall_10, coalesce((SELECT 1 / min(rank) FROM hit h WHERE h.stage = st.stage AND h.case_id = nr.case_id), 0) AS rr_10,
      coalesce((SELECT sum(1 / log2(rank + 1)) FROM hit h WHERE h.stage = st.stage AND h.case_id = nr.case_id), 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_10,
      EXISTS (SELECT 1 FROM ret WHERE ret.stage = st.stage AND ret.case_id = nr.case_id) AS answered FROM nr JOIN (SELECT query_id AS case_id, category FROM queries) USING (case_id) CROSS JOIN (SELECT DISTINCT stage FROM ret) st)"""


@query(
    f"""WITH {sql.RELEVANCE}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('(SELECT doc_id AS chunk_id, text FROM documents)')}, {sql.bm25_parts()}, {sql.BM25}, {_LEX}, q AS (SELECT query_id, list_distinct({sql.tok('query')}) AS q FROM queries),
    x AS (SELECT query_id, chunk_id, score AS base_score, len(list_intersect(q, list_distinct(tokens))) AS shared, len(q) AS nq, len(list_distinct(tokens)) AS nd FROM hits JOIN q USING (query_id) JOIN docs USING (chunk_id) WHERE rank <= 25),
    ret AS (SELECT 'bm25' AS stage, query_id AS case_id, chunk_id AS doc, rank FROM hits WHERE rank <= 10 UNION ALL
      SELECT 'bm25_rerank', query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(.8::DOUBLE * shared / nq + .2::DOUBLE * shared / (nq + nd - shared), 6) DESC, base_score DESC, chunk_id) AS rank FROM x) WHERE rank <= 10 UNION ALL
      SELECT 'lexical', query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) AS rank FROM lexical) WHERE rank <= 10), {_EVAL}
    SELECT stage AS category, count(*) AS cases, count_if(NOT answered)::BIGINT AS missing, round(avg(recall_10), 6) AS recall_10, round(avg(rr_10), 6) AS rr_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM m GROUP BY stage"""
)
def ablation_matrix(spark, d):
    """Stages times cases with one relevance: macro metrics per stage."""
    docs = r.documents_of(c.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    q = c.queries(spark, d)
    terms = r.query_terms(q)
    first = staged(r.bm25(docs, terms, 25), "first-pass")
    stages = {"bm25": first, "bm25_rerank": r.rerank(first, docs, q, 10), "lexical": r.lexical_top(docs, terms, q, 10)}
    hits = None
    for name, found in stages.items():
        part = found.where("rank <= 10").select(F.concat(F.lit(f"{name}/"), F.col("query_id")).alias("case_id"), F.col("chunk_id").alias("doc"), "rank")
        hits = part if hits is None else hits.unionByName(part)
    names = F.array(*map(F.lit, stages))
    everywhere = lambda df, key: df.withColumn("stage", F.explode(names)).withColumn("case_id", F.concat("stage", F.lit("/"), key))
    m = evaluation.case_metrics(everywhere(q, "query_id").select("case_id", F.col("stage").alias("category")), hits, everywhere(c.relevance(spark, d), "case_id").select("case_id", "doc"))
    return evaluation.summary(m, ["recall_10", "rr_10", "ndcg_10"]).where("category IS NOT NULL")


@query(
    f"""WITH {sql.RELEVANCE}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('(SELECT doc_id AS chunk_id, text FROM documents)')}, {sql.bm25_parts(1.2)}, h AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL),
    a AS (SELECT queries.query_id, docs.chunk_id, coalesce(h.score, 0) AS score FROM queries CROSS JOIN docs LEFT JOIN h ON h.query_id = queries.query_id AND h.chunk_id = docs.chunk_id),
    lock AS (SELECT case_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('7' || chr(0) || category || chr(0) || case_id), case_id) AS turn, sha256('7' || chr(0) || category) AS ck FROM (SELECT query_id AS case_id, category FROM queries)) ORDER BY turn, ck, category LIMIT 24),
    ret AS (SELECT 'baseline' AS stage, query_id AS case_id, chunk_id AS doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM a) WHERE rank <= 10 AND query_id IN (SELECT case_id FROM lock)), {_EVAL}
    SELECT category, count(*) AS cases, count_if(NOT answered)::BIGINT AS missing, round(avg(recall_10), 6) AS recall_10, round(avg(rr_10), 6) AS rr_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM m WHERE case_id IN (SELECT case_id FROM lock) GROUP BY ROLLUP (category)"""
)
def baseline_run(spark, d):
    """The baseline over a locked sample: stratified cases, padded BM25, metrics."""
    q = c.queries(spark, d)
    locked = staged(evaluation.stratified_sample(q.select(F.col("query_id").alias("case_id"), "category"), 24, "7").select("case_id", "category"), "locked")
    mine = q.join(locked.select(F.col("case_id").alias("query_id")), "query_id", "left_semi")
    docs = r.documents_of(c.documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    hits = r.bm25_padded(docs, r.query_terms(mine), mine, 10).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("doc"), "rank")
    return evaluation.summary(evaluation.case_metrics(locked, hits, c.relevance(spark, d)), ["recall_10", "rr_10", "ndcg_10"])
