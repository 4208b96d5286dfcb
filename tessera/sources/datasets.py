"""Evaluation datasets in their published JSON shapes, normalised to documents and cases; text files; sinks.

Schemas are given, never inferred: one pass over the files, and rows that break the format end the job where the
dataset is strict about it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped

TATQA = (
    "table struct<uid:string,table:array<array<string>>>, paragraphs array<struct<order:string,uid:string,text:string>>, questions array<struct<uid:string,question:string,"
    "answer:string,answer_type:string,answer_from:string,rel_paragraphs:array<string>,derivation:string,scale:string>>"
)
MULTIHOP_CORPUS = "title string, author string, source string, published_at string, category string, url string, body string"
MULTIHOP_QUERIES = "query string, answer string, question_type string, evidence_list array<struct<url:string,fact:string>>"
MMLONGBENCH = "doc_id string, doc_type string, question string, answer string, evidence_pages string, evidence_sources string, answer_format string"
PAGE_SUITE = (
    "documents array<struct<document_id:string,pages:array<struct<page:int,title:string,paragraphs:array<string>,tables:array<struct<headers:array<string>,rows:array<array<string>>>>>>>>, "
    "cases array<struct<case_id:string,question:string,category:string,answer:string,evidence:array<struct<document_id:string,pages:array<int>>>>>"
)


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Files that hold one JSON value each, or one a line (which split)."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def table_text(rows: Column) -> Column:
    """Cells stripped and joined by bars, rows by line feeds."""
    return stripped(F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: stripped(F.coalesce(c, F.lit("None")))), " | ")), "\n"))


def tatqa(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, cases): a table and its paragraphs are documents; a case lists those that answer it."""
    raw = _json(spark, path, TATQA, lines).withColumn("uid", stripped(F.col("table.uid")))
    prefix = F.concat(F.lit("tatqa:"), "uid", F.lit(":"))
    tables = raw.select(F.concat(prefix, F.lit("table")).alias("document_id"), table_text(F.col("table.table")).alias("text"), F.lit("table").alias("kind"))
    paragraphs = raw.select(prefix.alias("p"), F.inline("paragraphs")).select(F.concat("p", F.lit("paragraph:"), stripped(F.col("order"))).alias("document_id"), stripped(F.col("text")).alias("text"), F.lit("paragraph").alias("kind"))
    known = F.transform("paragraphs", lambda p: stripped(p["order"]))
    q = raw.select(prefix.alias("p"), known.alias("known"), F.inline("questions"))
    in_table = F.contains(F.coalesce("answer_from", F.lit("")), F.lit("table"))
    cited = F.transform(F.array_distinct(F.filter(F.coalesce("rel_paragraphs", F.array().cast("array<string>")), lambda o: F.array_contains("known", o))), lambda o: F.concat("p", F.lit("paragraph:"), o))
    relevant = F.concat(F.when(in_table, F.array(F.concat("p", F.lit("table")))).otherwise(F.array().cast("array<string>")), cited)
    category = F.when(F.col("answer_type").isin("arithmetic", "count", "multi-span"), F.col("answer_type")).when(in_table, "table").otherwise("text")
    cases = q.select(F.concat(F.lit("tatqa:"), stripped(F.col("uid"))).alias("case_id"), stripped(F.col("question")).alias("query"), relevant.alias("relevant_ids"), category.alias("category"), "answer", "answer_from")
    return tables.unionByName(paragraphs), cases.where("NOT (size(relevant_ids) = 0 AND answer_from = 'text')").drop("answer_from")


def multihop(spark: SparkSession, queries: str, corpus: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, cases): evidence is joined by address; queries without an answer in the corpus are left out."""
    key = lambda url: F.concat(F.lit("multihop:"), F.substring(F.sha2(url, 256), 1, 24))
    docs = _json(spark, corpus, MULTIHOP_CORPUS, lines).select(key(stripped(F.col("url"))).alias("document_id"), stripped(F.col("body")).alias("text"), stripped(F.col("url")).alias("source_uri"), "title", "source", "published_at")
    q = _json(spark, queries, MULTIHOP_QUERIES, lines).withColumn("case_id", F.concat(F.lit("multihop:q"), F.monotonically_increasing_id())).where("question_type != 'null_query'")
    evidence = q.select("case_id", F.posexplode("evidence_list").alias("pos", "e")).select("case_id", "pos", stripped(F.col("e.url")).alias("source_uri"))
    found = evidence.join(docs.select("source_uri", "document_id"), "source_uri", "left")
    found = found.withColumn("document_id", F.when(F.col("document_id").isNull(), F.raise_error(F.concat(F.lit("evidence names an unknown address: "), "source_uri"))).otherwise(F.col("document_id")))
    firsts = found.groupBy("case_id", "document_id").agg(F.min("pos").alias("pos")).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "document_id"))), lambda s: s["document_id"]).alias("relevant_ids"))
    cases = q.join(firsts, "case_id").select("case_id", stripped(F.col("query")).alias("query"), "relevant_ids", F.col("question_type").alias("category"), "answer")
    return docs, cases


def page_list(value: Column) -> Column:
    """Page numbers from a list, or from a quoted one."""
    pages = F.transform(F.from_json(F.replace(stripped(value), F.lit("'"), F.lit('"')), "array<string>"), lambda p: p.cast("int"))
    return F.when(F.exists(pages, lambda p: p < 0), F.raise_error(F.lit("evidence pages must not be negative")).cast("array<int>")).otherwise(pages)


def mmlongbench(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cases over pages; those without a document, question or page are left out."""
    raw = _json(spark, path, MMLONGBENCH, lines).withColumn("i", F.monotonically_increasing_id()).withColumn("pages", page_list(F.col("evidence_pages")))
    many, table = F.size("pages") > 1, F.contains(F.coalesce("evidence_sources", F.lit("")), F.lit("Table"))
    category = F.when(table & many, "cross-page-table").when(table, "table").when(many, "cross-page").otherwise("single-page")
    doc = stripped(F.col("doc_id"))
    ids = F.transform("pages", lambda p: F.concat(F.lit("mmlongbench:"), doc, F.lit(":page:"), p.cast("string")))
    return raw.where((doc != "") & (stripped(F.col("question")) != "") & (F.size("pages") > 0)).select(F.concat(F.lit("mmlongbench:"), F.col("i").cast("string"), F.lit(":"), doc).alias("case_id"), stripped(F.col("question")).alias("query"), ids.alias("relevant_ids"), category.alias("category"), "answer")


def page_suite(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents: one per page, cases: evidence flattened to page ids)."""
    raw = _json(spark, path, PAGE_SUITE, lines)
    pid = lambda d, p: F.concat(d, F.lit(":page:"), p.cast("string"))
    pages = raw.select(F.inline("documents")).select("document_id", F.inline("pages"))
    drawn = F.transform("tables", lambda t: table_text(F.concat(F.array(t["headers"]), t["rows"])))
    docs = pages.select(pid(F.col("document_id"), F.col("page")).alias("document_id"), F.concat_ws("\n", F.array("title"), F.col("paragraphs"), drawn).alias("text"))
    ids = F.flatten(F.transform("evidence", lambda e: F.transform(e["pages"], lambda p: pid(e["document_id"], p))))
    return docs, raw.select(F.inline("cases")).select("case_id", F.col("question").alias("query"), "category", "answer", F.array_distinct(ids).alias("relevant_ids"))


def text_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 2_000_000, strict: bool = True) -> DataFrame:
    """UTF-8 text files with their hash. A file that is too large, holds a null byte early on, or is not UTF-8 ends the job, or is left out if not ``strict``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    text = F.col("content").cast("string")
    fault = F.when(F.col("length") > most_bytes, "too large").when(F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*?00"), "not a text").when(~F.is_valid_utf8(text), "not UTF-8")
    refused = F.raise_error(F.concat(F.lit("refused, "), fault, F.lit(": "), F.col("path"))).cast("boolean")
    return raw.where(F.when(fault.isNull(), F.lit(True)).otherwise(refused if strict else F.lit(False))).select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"))


#: Folders and names that a walk over a workspace does not enter or read.
SKIPPED = r"(?:^|/)(?:\.git|\.hg|\.venv|node_modules|__pycache__)/|(?:^|/)(?:\.env[^/]*|id_rsa[^/]*|[^/]*\.(?:pem|key|p12|pfx))$"


def workspace_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 2_000_000) -> DataFrame:
    """The readable text files of a workspace tree: no tool folders, no files that usually hold secrets."""
    return text_files(spark, path, glob, most_bytes, strict=False).where(~F.col("path").rlike(SKIPPED))


def docs_files(spark: SparkSession, path: str, allowed: list[str], most_chars: int = 40_000) -> DataFrame:
    """Allowlisted files (by name) as chunks, cut to ``most_chars`` characters."""
    files = text_files(spark, path).withColumn("name", F.substring_index("path", "/", -1)).where(F.col("name").isin(allowed))
    return files.select(F.concat(F.lit("docs:"), "name").alias("chunk_id"), F.substring("text", 1, most_chars).alias("text"))


def strict_json(column: Column, schema: str) -> Column:
    """A struct from JSON, null for rows that do not parse: corrupt rows drop, healthy ones stay."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})


def canonical_lines(df: DataFrame) -> DataFrame:
    """One ``value`` column of JSON objects with sorted keys, for a text sink."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n and the sha256 over the sorted hashes of the canonical rows; the same for any order or partitioning.

    Row hashes are summed up per prefix first, so no task holds more than a 65,536th of them, and the driver none.
    """
    hashed = canonical_lines(df).select(F.sha2("value", 256).alias("h"))
    parts = hashed.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]), ""), 256).alias("sha256"))


def publish(df: DataFrame, path: str) -> None:
    """Write JSON lines beside the target and rename them once whole; an existing result is never overwritten."""
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(to):
        raise FileExistsError(path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    canonical_lines(df).write.text(beside.toString())
    if store.exists(to) or not store.rename(beside, to):
        store.delete(beside, True)
        raise FileExistsError(path)
