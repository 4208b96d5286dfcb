"""The dataset readers on files in their published shapes, written from the test tables as JSON lines."""

from pyspark.sql import functions as F

from ..functions.arithmetic import evaluate
from ..operators.staging import shared_root
from ..sources import corpus as c
from ..sources import datasets
from .catalog import query


def _written(spark, rows, name):
    """``rows`` as JSON lines in the shared folder."""
    import uuid

    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.json(path)
    return path


def _contexts(spark, d):
    """A context per order: its lines as a table, its priority and date as paragraphs, a question on either."""
    lines = c.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    tables = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))), lambda x: F.array(F.concat(F.lit(" "), x["l_linenumber"].cast("string")), x["p"].cast("string"))).alias("rows"))
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    question = F.struct(
        F.concat(F.lit("q"), text(k)).alias("uid"), F.lit(" Which priority? ").alias("question"), F.col("o_orderpriority").alias("answer"), F.when(k % 3 == 0, "count").otherwise("span").alias("answer_type"),
        F.when(k % 2 == 0, "table-text").otherwise("text").alias("answer_from"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("9"))).alias("rel_paragraphs"),
    )
    paragraphs = F.array(*(F.struct(F.lit(str(i)).alias("order"), F.concat(F.lit(f"p{i}-"), text(k)).alias("uid"), F.concat(F.lit(" "), x, F.lit("\n")).alias("text")) for i, x in ((1, F.col("o_orderpriority")), (2, F.col("o_orderstatus")))))
    return c.table(spark, d, "orders").join(tables, k == F.col("l_orderkey")).select(F.struct(text(k).alias("uid"), F.col("rows").alias("table")).alias("table"), paragraphs.alias("paragraphs"), F.array(question).alias("questions"))


_HELD = "(SELECT DISTINCT l_orderkey FROM lineitem)"


@query(
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey IN {_HELD}), l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
    SELECT 'tatqa:' || l_orderkey || ':table' AS document_id, md5(string_agg(l_linenumber || ' | ' || p, chr(10) ORDER BY l_linenumber)) AS text_md5, 'table' AS kind FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY l_orderkey
    UNION ALL SELECT 'tatqa:' || o_orderkey || ':paragraph:1', md5(o_orderpriority), 'paragraph' FROM o UNION ALL SELECT 'tatqa:' || o_orderkey || ':paragraph:2', md5(o_orderstatus), 'paragraph' FROM o"""
)
def tatqa_documents(spark, d):
    docs, _ = datasets.tatqa(spark, _written(spark, _contexts(spark, d), "tatqa"), lines=True)
    return docs.select("document_id", F.md5("text").alias("text_md5"), "kind")


@query(
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey IN {_HELD} AND NOT (o_orderkey % 2 = 1 AND o_orderkey % 5 = 0)) SELECT 'tatqa:q' || o_orderkey AS case_id, 'Which priority?' AS "query",
    concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'tatqa:' || o_orderkey || ':table' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'tatqa:' || o_orderkey || ':paragraph:1' END) AS relevant, CASE WHEN o_orderkey % 3 = 0 THEN 'count' WHEN o_orderkey % 2 = 0 THEN 'table' ELSE 'text' END AS category FROM o"""
)
def tatqa_cases(spark, d):
    _, cases = datasets.tatqa(spark, _written(spark, _contexts(spark, d), "tatqa"), lines=True)
    return cases.select("case_id", "query", F.array_join("relevant_ids", ",").alias("relevant"), "category")


_KEY = "'multihop:' || sha256('http://x/' || {0})[:24]"


@query(
    f"""SELECT item_id AS item, CASE WHEN item_id % 2 = 0 THEN {_KEY.format('item_id')} || ',' || {_KEY.format('(item_id + 1)')} ELSE {_KEY.format('item_id')} END AS relevant, CASE item_id % 3 WHEN 1 THEN 'inference' ELSE 'comparison' END AS category FROM benchmark WHERE item_id % 3 <> 0 AND item_id + 1 <= (SELECT max(doc_id) FROM documents)"""
)
def multihop_cases(spark, d):
    """Evidence of each benchmark item: the documents of its number and, every second, of the next one, one of them twice."""
    docs = c.table(spark, d, "documents").select(F.concat(F.lit(" http://x/"), "doc_id").alias("url"), F.col("text").alias("body"), F.col("lang").alias("title"), "source")
    i, most = F.col("item_id"), c.table(spark, d, "documents").agg(F.max("doc_id")).scalar()
    fact = lambda n: F.struct(F.concat(F.lit("http://x/"), n).alias("url"), F.lit("f").alias("fact"))
    asked = c.table(spark, d, "benchmark").where(i + 1 <= most).select(
        F.concat(F.lit("item "), i).alias("query"), F.lit("a").alias("answer"), F.when(i % 3 == 0, "null_query").when(i % 3 == 1, "inference").otherwise("comparison").alias("question_type"),
        F.when(i % 2 == 0, F.array(fact(i), fact(i + 1), fact(i))).otherwise(F.array(fact(i))).alias("evidence_list"),
    )
    _, cases = datasets.multihop(spark, _written(spark, asked, "multihop-q"), _written(spark, docs, "multihop-c"), lines=True)
    return cases.select(F.substring_index("query", " ", -1).cast("long").alias("item"), F.array_join("relevant_ids", ",").alias("relevant"), "category")


@query(
    """SELECT page_id, 'mmlongbench:d' || page_id || ':page:' || (page_id % 9) || CASE WHEN page_id % 2 = 0 THEN ',mmlongbench:d' || page_id || ':page:' || (page_id % 9 + 1) ELSE '' END AS relevant,
    CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'cross-page-table' WHEN page_id % 3 = 0 THEN 'table' WHEN page_id % 2 = 0 THEN 'cross-page' ELSE 'single-page' END AS category FROM pages WHERE page_id % 7 <> 0"""
)
def mmlongbench_cases(spark, d):
    p = F.col("page_id")
    pages = F.when(p % 7 == 0, "[]").when(p % 2 == 0, F.concat(F.lit("["), p % 9, F.lit(", "), p % 9 + 1, F.lit("]"))).otherwise(F.concat(F.lit("["), p % 9, F.lit("]")))
    rows = c.table(spark, d, "pages").select(F.concat(F.lit("d"), p).alias("doc_id"), F.concat(F.lit("Q "), p).alias("question"), F.lit("a").alias("answer"), pages.alias("evidence_pages"), F.when(p % 3 == 0, "['Table']").otherwise("['Text']").alias("evidence_sources"))
    cases = datasets.mmlongbench(spark, _written(spark, rows, "mmlongbench"), lines=True)
    return cases.select(F.substring_index("query", " ", -1).cast("long").alias("page_id"), F.array_join("relevant_ids", ",").alias("relevant"), "category")


@query("SELECT 'n' || n_nationkey || ':page:' || k AS document_id, 'Title' || chr(10) || n_name || chr(10) || 'a | b' || chr(10) || n_regionkey || ' | ' || k AS text FROM nation, range(1, 3) r(k)")
def page_suite_documents(spark, d):
    s = lambda x: x.cast("string")
    page = lambda k: F.struct(
        F.lit(k).alias("page"), F.lit("Title").alias("title"), F.array("n_name").alias("paragraphs"), F.array(F.struct(F.array(F.lit("a"), F.lit("b")).alias("headers"), F.array(F.array(s(F.col("n_regionkey")), F.lit(str(k)))).alias("rows"))).alias("tables")
    )
    none = F.from_json(F.lit("[]"), "array<struct<case_id:string,question:string,category:string,answer:string,evidence:array<struct<document_id:string,pages:array<int>>>>>")
    rows = c.table(spark, d, "nation").select(F.array(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("document_id"), F.array(page(1), page(2)).alias("pages"))).alias("documents"), none.alias("cases"))
    docs, _ = datasets.page_suite(spark, _written(spark, rows, "suite"), lines=True)
    return docs


@query("SELECT count(*) AS n, sha256(string_agg(h, '' ORDER BY p)) AS sha256 FROM (SELECT p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT h, h[:4] AS p FROM (SELECT sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS h FROM nation)) GROUP BY p)")
def dataset_fingerprint(spark, d):
    return datasets.fingerprint(c.table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT l_orderkey, l_linenumber, round((q * 2 + 3) / 4 - q % 7, 6) AS value FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS q FROM lineitem GROUP BY ALL)")
def arithmetic_values(spark, d):
    lines = c.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("q"))
    expression = F.concat(F.lit("("), "q", F.lit(" * 2 + 3) / 4 - "), "q", F.lit(" % 7"))
    return lines.select("l_orderkey", "l_linenumber", F.round(evaluate(expression), 6).alias("value"))
