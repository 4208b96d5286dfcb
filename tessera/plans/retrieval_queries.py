"""Governed search: BM25 in its forms, lexical, memory, dense, fusion, reranking, neighbours, feedback."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import tokens
from ..operators import retrieval as r
from ..operators import scope
from ..operators.staging import staged
from ..sources import corpus as c
from . import sql
from .catalog import query
from .scope_queries import _MINE, MEMBER


def governed(spark, d):
    """(docs, terms, queries) for the principal of the queries."""
    q = c.queries(spark, d)
    return r.documents_of(scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW)), r.query_terms(q), q


@query(f"WITH {sql.GOVERNED} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits WHERE rank <= 10")
def bm25_topk(spark, d):
    docs, terms, _ = governed(spark, d)
    return r.bm25(docs, terms, 10).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {sql.GOVERNED} SELECT term, df FROM df")
def term_df(spark, d):
    docs, terms, _ = governed(spark, d)
    return r.matches(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {sql.SCOPED}, {sql.docs('scoped')} SELECT count(*) AS n, round(avg(length), 6) AS average, max(length)::INT AS longest FROM docs")
def doc_stats(spark, d):
    return governed(spark, d)[0].agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 6).alias("average"), F.max("length").alias("longest"))


@query(
    f"WITH {sql.GOVERNED} SELECT query_id, chunk_id, string_agg(p.term || ':' || p.tf || ':' || printf('%.4f', round(part, 4)), ' ' ORDER BY p.term) AS explanation FROM hits JOIN parts p USING (query_id, chunk_id) WHERE rank <= 3 GROUP BY ALL"
)
def bm25_explain(spark, d):
    docs, terms, _ = governed(spark, d)
    best = r.bm25(docs, terms, 3).select("query_id", "chunk_id")
    parts = r.bm25_parts(docs, terms).join(best, ["query_id", "chunk_id"])
    one = F.concat_ws(":", "term", F.col("tf").cast("string"), F.format_string("%.4f", F.round("part", 4)))
    return parts.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", one.alias("x")))), lambda s: s["x"]), " ").alias("explanation"))


@query(
    f"""WITH {sql.CHUNKS}, {sql.QUERIES}, {sql.TERMS}, docs AS (SELECT chunk_id, tenant_id AS scope, {sql.tok('text')} AS tokens, len({sql.tok('text')}) AS length FROM chunks WHERE list_has_any(acl, ['tenant', 'user:u1'])),
    tf AS (SELECT chunk_id, scope, length, term, count(*) AS tf FROM (SELECT chunk_id, scope, length, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT scope, count(*) AS n, avg(length) AS a FROM docs GROUP BY ALL),
    s AS (SELECT tf.scope, query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score
        FROM qt JOIN tf USING (term) JOIN df ON df.term = tf.term AND df.scope = tf.scope JOIN st ON st.scope = tf.scope GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 5"""
)
def bm25_scopes(spark, d):
    ch = c.chunks(spark, d).where(F.arrays_overlap("acl", F.array(F.lit("tenant"), F.lit("user:u1"))))
    docs = ch.select("chunk_id", F.col("tenant_id").alias("scope"), tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    return r.bm25_by_scope(docs, r.query_terms(c.queries(spark, d)), 5)


@query(
    f"""WITH {sql.SCOPED}, {sql.QUERIES}, {sql.TERMS}, docs AS (SELECT chunk_id, tokens, len(tokens) AS length FROM (SELECT chunk_id, list_concat({sql.tok('text')}, {sql.tok('kb')}, {sql.tok('kb')}, {sql.tok('kb')}) AS tokens FROM scoped)),
    {sql.bm25_parts()}, {sql.BM25} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits WHERE rank <= 5"""
)
def bm25_field_weighted(spark, d):
    ch = scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW)
    kb = tokens(F.col("kb"))  # a field of weight 3 counts three times, in term frequency, length and document frequency
    return r.bm25(r.documents_of(ch, token_expr=F.concat(tokens(F.col("text")), kb, kb, kb)), r.query_terms(c.queries(spark, d)), 5).select("query_id", "chunk_id", "score", "rank")


@query(
    f"""WITH {sql.CHUNKS}, {sql.QUERIES}, q2 AS (SELECT * FROM queries UNION ALL SELECT -1, 0, 'zzzz'), {sql.TERMS.replace('FROM queries', 'FROM q2')}, {sql.docs('chunks')}, {sql.bm25_parts(1.2)},
    h AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL), a AS (SELECT q2.query_id, docs.chunk_id, coalesce(h.score, 0) AS score FROM q2 CROSS JOIN docs LEFT JOIN h ON h.query_id = q2.query_id AND h.chunk_id = docs.chunk_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM a) WHERE rank <= 20"""
)
def bm25_baseline_padded(spark, d):
    q = c.queries(spark, d).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit(0).cast("long").alias("category"), F.lit("zzzz").alias("query")))  # one without any hit
    return r.bm25_padded(r.documents_of(c.chunks(spark, d)), r.query_terms(q), q, 20)


_COSINE = "list_dot_product(embedding::DOUBLE[], qv::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])))"
_LEX = f"""lex AS (SELECT qt.query_id, tf.chunk_id, count(*) AS matched, sum(least(tf.tf, 3) / 3.0::DOUBLE) AS capped FROM qt JOIN tf USING (term) GROUP BY ALL),
    qs AS (SELECT query_id, len(x) AS n, array_to_string(list_sort(x, 'ASC'), ' ') AS unused FROM (SELECT query_id, list_distinct({sql.tok('query')}) AS x FROM queries)),
    qj AS (SELECT query_id, string_agg(term, ' ' ORDER BY pos) AS joined FROM qt GROUP BY ALL),
    lexical AS (SELECT query_id, chunk_id, round(least(1.0, 0.60::DOUBLE * matched / n + 0.25::DOUBLE * capped / n + 0.15::DOUBLE * contains(array_to_string(tokens, ' '), joined)::INT), 12) AS lexical
        FROM lex JOIN qs USING (query_id) JOIN qj USING (query_id) JOIN docs USING (chunk_id))"""
_LEXICAL = f"{sql.SCOPED}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('scoped')}, {sql.TF}, {_LEX}"


@query(f"WITH {_LEXICAL} SELECT * FROM (SELECT query_id, chunk_id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id)::INT AS rank FROM lexical) WHERE rank <= 10")
def lexical_topk(spark, d):
    return r.lexical_top(*governed(spark, d), 10)


@query(
    f"""WITH {_LEXICAL}, sem AS (SELECT query_id, chunk_id, score AS semantic FROM (SELECT query_id, chunk_id, {_COSINE} AS score FROM (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT query_id FROM queries)) JOIN (SELECT vec_id AS chunk_id, embedding FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM scoped)) ON true)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) <= 50),
    b AS (SELECT query_id, chunk_id, coalesce(lexical, 0) AS lexical, greatest(0, least(1, coalesce(round(semantic, 6), 0))) AS semantic FROM lexical FULL JOIN sem USING (query_id, chunk_id)),
    s AS (SELECT *, round((0.7::DOUBLE * lexical + 0.3::DOUBLE * semantic) / (0.7::DOUBLE + 0.3::DOUBLE), 14) AS score FROM b) SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
)
def lexical_semantic_blend(spark, d):
    """Lexical scores of all matched chunks with the semantic scores of the 50 visible chunks nearest to each query."""
    docs, terms, q = governed(spark, d)
    near = r.dense_top(_vectors(spark, d).join(docs.select("chunk_id"), "chunk_id", "left_semi"), _asked_items(spark, d, q), 50)
    return r.top(r.blend(r.lexical(docs, terms, q), near.select("query_id", "chunk_id", F.col("score").alias("semantic"))), 10).select("query_id", "chunk_id", "score", "rank")


_MEM = f"""{sql.MEMORY}, chunks AS (SELECT memory_id AS chunk_id, content AS text, importance, updated_at FROM memory WHERE {_MINE} AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-15')),
    fr AS (SELECT chunk_id, importance, 1 / (1 + greatest(0, epoch(TIMESTAMP '2024-02-15') - epoch(updated_at)) / 86400.0 / 30) AS fresh FROM chunks)"""


@query(
    f"""WITH {_MEM}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('chunks')}, {sql.TF}, {_LEX}, s AS (SELECT query_id, chunk_id AS memory_id, round(.80::DOUBLE * lexical + .15::DOUBLE * importance + .05::DOUBLE * fresh, 14) AS score FROM lexical JOIN fr USING (chunk_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id)::INT AS rank FROM s) WHERE rank <= 5"""
)
def memory_recall(spark, d):
    q = c.queries(spark, d)
    m = _own_memory(spark, d)
    lexical = r.lexical(r.documents_of(m.select(F.col("memory_id").alias("chunk_id"), F.col("content").alias("text"))), r.query_terms(q), q).withColumnRenamed("chunk_id", "memory_id")
    both = lexical.join(m.select("memory_id", "importance", _fresh().alias("fresh")), "memory_id")
    return r.top(both.select("query_id", "memory_id", F.round(0.80 * F.col("lexical") + 0.15 * F.col("importance") + 0.05 * F.col("fresh"), r.FINE + 2).alias("score")), 5, id_col="memory_id")


@query(f"WITH {_MEM} SELECT * FROM (SELECT chunk_id AS memory_id, round(.75::DOUBLE * importance + .25::DOUBLE * fresh, 6) AS score FROM fr) ORDER BY score DESC, memory_id LIMIT 10")
def memory_recall_blank(spark, d):
    m = _own_memory(spark, d)
    return m.select("memory_id", F.round(0.75 * F.col("importance") + 0.25 * _fresh(), 6).alias("score")).orderBy(F.desc("score"), "memory_id").limit(10)


def _own_memory(spark, d):
    return c.memory(spark, d).where(scope.memory_visible(MEMBER) & scope.unexpired(c.NOW))


def _fresh():
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(c.NOW)) - F.unix_micros("updated_at")) / 86.4e9)
    return 1 / (1 + age / 30)


@query(
    f"""WITH {sql.GOVERNED}, c AS (SELECT query_id, chunk_id, score AS base_score FROM hits WHERE rank <= 25), q AS (SELECT query_id, list_distinct({sql.tok('query')}) AS q FROM queries),
    x AS (SELECT query_id, chunk_id, base_score, len(list_intersect(q, list_distinct(tokens))) AS shared, len(q) AS nq, len(list_distinct(tokens)) AS nd FROM c JOIN q USING (query_id) JOIN docs USING (chunk_id)),
    s AS (SELECT query_id, chunk_id, base_score, round(.8::DOUBLE * shared / nq + .2::DOUBLE * shared / (nq + nd - shared), 6) AS score FROM x)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 10"""
)
def rerank_lexical(spark, d):
    docs, terms, q = governed(spark, d)
    return r.rerank(r.bm25(docs, terms, 25), docs, q, 10)


def passage_docs(spark, d):
    return c.passages(spark, d)


_PASSAGE_HITS = f"{sql.PASSAGES}, {sql.QUERIES}, {sql.TERMS}, {sql.docs('passages')}, {sql.bm25_parts()}, {sql.BM25}"


@query(
    f"""WITH {_PASSAGE_HITS}, seeds AS (SELECT query_id, chunk_id, score, rank FROM hits WHERE rank <= 3),
    f AS (SELECT query_id, chunk_id, score, 0 AS kind, rank, 0 AS side, 0 AS dist FROM seeds
      UNION ALL SELECT s.query_id, n.chunk_id, s.score * pow(0.75, abs(n.idx - p.idx)), 1, s.rank, CASE WHEN n.idx < p.idx THEN 1 ELSE 2 END, abs(n.idx - p.idx) FROM seeds s JOIN passages p USING (chunk_id) JOIN passages n ON n.document_id = p.document_id AND abs(n.idx - p.idx) BETWEEN 1 AND 2),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY kind, rank, side, dist) AS n FROM f) WHERE n = 1)
    SELECT query_id, chunk_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY kind, rank, side, dist)::INT AS position, kind = 0 AS is_seed FROM k"""
)
def neighbors_expand(spark, d):
    p = passage_docs(spark, d)
    seeds = r.bm25(r.documents_of(p), r.query_terms(c.queries(spark, d)), 3)
    return r.neighbours(seeds, p, 2)


@query(
    f"""WITH {_PASSAGE_HITS}, u AS (SELECT query_id, split_part(chunk_id, '::chunk::', 1)::BIGINT AS document_id, min(rank) AS first_rank FROM hits WHERE rank <= 25 GROUP BY ALL)
    SELECT * FROM (SELECT query_id, document_id, first_rank::INT AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY first_rank)::INT AS rank FROM u) WHERE rank <= 10"""
)
def chunk_to_doc(spark, d):
    hits = r.bm25(r.documents_of(passage_docs(spark, d)), r.query_terms(c.queries(spark, d)), 25)
    return r.roll_up(hits, F.substring_index("chunk_id", "::chunk::", 1).cast("long"), 10)


_PRF = f"""{sql.GOVERNED}, w AS (SELECT query_id, rank, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS place FROM hits JOIN docs USING (chunk_id) WHERE rank <= 5),
    cn AS (SELECT query_id, term, count(*) AS n_seen, min(rank * 1000000 + place) AS first FROM w WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = w.query_id AND qt.term = w.term) GROUP BY ALL),
    prf AS (SELECT * FROM (SELECT query_id, term, n_seen, row_number() OVER (PARTITION BY query_id ORDER BY n_seen DESC, first)::INT AS pos FROM cn) WHERE pos <= 6)"""


@query(f"WITH {_PRF} SELECT * FROM prf")
def prf_terms(spark, d):
    docs, terms, _ = governed(spark, d)
    return r.feedback_terms(r.bm25(docs, terms, 5), docs, terms)


@query(
    f"""WITH {_PRF}, q2 AS (SELECT query_id, term FROM qt UNION SELECT query_id, term FROM prf), tf2 AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, length, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM q2) GROUP BY ALL),
    df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term), s2 AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf2.tf * 2.5 / (tf2.tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score FROM q2 JOIN tf2 USING (term) JOIN df2 USING (term) CROSS JOIN st GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s2) WHERE rank <= 10"""
)
def prf_bm25(spark, d):
    docs, terms, _ = governed(spark, d)
    more = staged(r.feedback_terms(r.bm25(docs, terms, 5), docs, terms).select("query_id", "term"), "feedback")  # six rows a query
    return r.bm25(docs, terms.select("query_id", "term").unionByName(more), 10)


_DENSE = f"dense AS (SELECT query_id, chunk_id, round({_COSINE}, 6) AS score FROM (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0) CROSS JOIN (SELECT vec_id AS chunk_id, embedding FROM embeddings))"


def _vectors(spark, d):
    return c.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _asked_items(spark, d, q):
    """The vectors that stand for benchmark items: those with their numbers."""
    return _vectors(spark, d).withColumnRenamed("chunk_id", "query_id").join(q.select("query_id"), "query_id", "left_semi")


def _asked(spark, d):
    return _vectors(spark, d).where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@query(f"WITH {_DENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM dense) WHERE rank <= 10")
def dense_topk(spark, d):
    return r.dense_top(_vectors(spark, d), _asked(spark, d), 10)


_HE = f"""h AS (SELECT item_id AS id, term, count(*) AS tf, ('0x' || substring(md5(term), 1, 15))::BIGINT AS h FROM (SELECT item_id, unnest({sql.tok('text')}) AS term FROM benchmark) GROUP BY ALL),
    e AS (SELECT id, h % 64 AS bucket, sum(CASE WHEN (h >> 40) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + ln(tf))) AS value FROM h GROUP BY ALL)"""


@query(f"WITH {_HE} SELECT id, bucket, round(CASE WHEN n > 0 THEN value / n ELSE 0 END, 6) AS value FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY id)) AS n FROM e)")
def hash_embed_md5(spark, d):
    terms = c.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return r.hash_embedding(terms)


_LISTS = f"""{_LEXICAL}, st AS (SELECT count(*) AS n, avg(length) AS a FROM docs), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
    lists AS (SELECT 'bm25' AS list, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b
      UNION ALL SELECT 'lexical', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) FROM lexical)"""


def _lists(spark, d):
    docs, terms, q = governed(spark, d)
    named = lambda hits, name: hits.select(F.lit(name).alias("list"), "query_id", "chunk_id", "rank")
    return named(r.bm25(docs, terms, 25), "bm25").unionByName(named(r.lexical_top(docs, terms, q, 25), "lexical"))


def _fused(w: str) -> str:
    return f"WITH {_LISTS}, f AS (SELECT query_id, chunk_id, round(sum({w} / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists FROM lists WHERE rank <= 25 GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f) WHERE rank <= 10"


@query(_fused("1.0::DOUBLE"))
def rrf_fuse(spark, d):
    return r.rrf(_lists(spark, d)).withColumn("lists", F.array_join("lists", ","))


@query(_fused("CASE list WHEN 'bm25' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END"))
def weighted_rrf(spark, d):
    return r.rrf(_lists(spark, d), weights={"bm25": 2.0, "lexical": 0.5}).withColumn("lists", F.array_join("lists", ","))


@query(
    f"""WITH {_DENSE}, a AS (SELECT 'dense' AS list, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense),
    l AS (SELECT 'label' AS list, q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 100 = 0),
    f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 25 UNION ALL SELECT * FROM l WHERE rank <= 25) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM f) WHERE rank <= 10"""
)
def hybrid_dense_sparse(spark, d):
    e = c.table(spark, d, "embeddings").select("vec_id", "label")
    dense = r.dense_top(_vectors(spark, d), _asked(spark, d), 25).select(F.lit("dense").alias("list"), "query_id", "chunk_id", "rank")
    first = e.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rank <= 25")  # the list of a label is the same for all its queries
    label = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(first, "label").select(F.lit("label").alias("list"), "query_id", F.col("vec_id").alias("chunk_id"), "rank")
    return r.rrf(dense.unionByName(label)).drop("lists")


@query("SELECT greatest(1, k // (1 + 2 * w)) AS seeds, least(500, greatest(greatest(1, k // (1 + 2 * w)), k, greatest(1, k // (1 + 2 * w)) * 5)) AS candidates, k, w FROM (SELECT l_linenumber * 7 AS k, l_orderkey % 6 AS w FROM lineitem GROUP BY ALL)")
def adaptive_budget(spark, d):
    rows = c.table(spark, d, "lineitem").select((F.col("l_linenumber") * 7).alias("k"), (F.col("l_orderkey") % 6).alias("w")).distinct()
    seeds = F.greatest(F.lit(1), F.floor(F.col("k") / (1 + 2 * F.col("w"))))
    return rows.select(seeds.alias("seeds"), F.least(F.lit(500), F.greatest(seeds, "k", seeds * 5)).alias("candidates"), "k", "w")


@query("SELECT vec_id, round(greatest(0, least(1, x)), 6) AS score FROM (SELECT vec_id, embedding[1]::DOUBLE * 3 AS x FROM embeddings)")
def bounded_score(spark, d):
    return c.table(spark, d, "embeddings").select("vec_id", F.round(scores.bounded(F.col("embedding")[0].cast("double") * 3), 6).alias("score"))


@query(
    f"""WITH {_PASSAGE_HITS}, seeds AS (SELECT query_id, chunk_id, score, rank FROM hits WHERE rank <= 3),
    f AS (SELECT query_id, chunk_id, score, 0 AS kind, 0 AS dist, rank, 0 AS side FROM seeds
      UNION ALL SELECT s.query_id, n.chunk_id, s.score * pow(0.75, abs(n.idx - p.idx)), 1, abs(n.idx - p.idx), s.rank, CASE WHEN n.idx < p.idx THEN 1 ELSE 2 END FROM seeds s JOIN passages p USING (chunk_id) JOIN passages n ON n.document_id = p.document_id AND abs(n.idx - p.idx) BETWEEN 1 AND 2),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY kind, CASE WHEN kind = 0 THEN rank ELSE dist END, rank, side) AS n FROM f) WHERE n = 1),
    q AS (SELECT query_id, chunk_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY kind, CASE WHEN kind = 0 THEN rank ELSE dist END, rank, side)::INT AS position, kind = 0 AS is_seed FROM k) SELECT * FROM q WHERE position <= 7"""
)
def neighbors_breadth_first(spark, d):
    p = passage_docs(spark, d)
    seeds = r.bm25(r.documents_of(p), r.query_terms(c.queries(spark, d)), 3)
    return r.neighbours(seeds, p, 2, breadth_first=True, most=7)


@query(f"WITH {sql.GOVERNED} SELECT query_id, chunk_id, CASE WHEN chunk_id % 10 = 9 THEN 'unknown' ELSE 'changed' END AS fault FROM hits WHERE rank <= 10 AND (chunk_id % 10 = 9 OR chunk_id % 10 = 4)")
def catalog_attestation(spark, d):
    docs, terms, _ = governed(spark, d)
    texts = c.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("payload"))
    returned = texts.withColumn("payload", F.when(F.col("chunk_id") % 10 == 4, "other").otherwise(F.col("payload")))
    hits = r.bm25(docs, terms, 10).select("query_id", "chunk_id").join(returned, "chunk_id")
    return scope.attested(hits, texts.where("chunk_id % 10 != 9"))


@query(f"WITH {sql.GOVERNED} SELECT query_id, rank::INT AS rank, chunk_id::VARCHAR AS chunk_id, round_even(score, 4) AS score, md5(text[:2000]) AS text_md5 FROM hits JOIN scoped USING (chunk_id) WHERE rank <= 5")
def tool_hits(spark, d):
    """Search hits as a tool returns them: text cut to 2,000 characters, score rounded half to even."""
    docs, terms, _ = governed(spark, d)
    seen = scope.scoped(c.chunks(spark, d), c.PRINCIPAL, c.NOW)
    hits = r.bm25(docs, terms, 5).join(seen.select("chunk_id", "text", "tenant_id", "acl"), "chunk_id")
    return scope.guarded(hits, scope.visible(c.PRINCIPAL)).select("query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.bround("score", 4).alias("score"), F.md5(F.substring("text", 1, 2000)).alias("text_md5"))
