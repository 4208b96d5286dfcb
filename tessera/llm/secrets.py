"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every historical version of a text is addressed by the hash of its content. The ledger is a table of (blob, rule
version) pairs that have been scanned, with their findings; a scan reads each unseen pair once, however many paths or
revisions share the blob, appends it to the ledger, and joins findings back to all paths.

Positions come from the JVM's own regular expressions: the text split by a pattern, and the pattern's matches, alternate, so
the lengths of what came before give each match its start, in code points.

Defined results: a null text is the empty blob; very long texts are scanned whole (a text with k matches is walked k times when it is masked);
spans that start together come in the order of the rules; repeated rows, and several texts under one id, each get their own findings; an
empty table gives an empty result and leaves the ledger as it is; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Bump when a rule changes: blobs scanned under another version count as unseen.
RULE_VERSION = 1


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` (0: the match itself) must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base kinds, in the order that breaks ties, then well-known token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{59,})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind_no, kind, end>> of a rule's matches, leftmost and non-overlapping, in code points."""
    no = next(i for i, r in enumerate(RULES) if r.kind == rule.kind) if rule in RULES else len(RULES)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # parts[i], found[i], parts[i + 1], ... make up the text
    pairs = F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)),
        F.arrays_zip(found.alias("m"), values.alias("v")),
        lambda part, match: F.struct(F.length(part).alias("gap"), F.length(match["m"]).alias("size"), F.length(match["v"]).alias("value")),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start:int,kind_no:int,kind:string,end:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), (begin + p["size"]).alias("end"))
        return F.struct((begin + p["size"]).alias("at"), F.when(p["value"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    none = F.expr("cast(array() AS array<struct<start:int,kind_no:int,kind:string,end:int>>)")
    return F.when(text.rlike(rule.pattern), F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(none)


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans by start, then by the order of the rules."""
    return F.array_sort(F.concat(*(spans_of(text, r) for r in rules)))


def scan(versions: DataFrame, ledger: str, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan what the ledger has not seen, add it there, and return (id, blob, spans) for every row of ``versions``.

    ``ledger`` is a folder (a Parquet table of blob, rule_version and spans, partitioned by nothing), made if absent.
    Only small rows are grouped: a blob is scanned at the one row that represents it.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = versions.select(F.col(id_col).alias("path_id"), text.alias("body"))
    paths = ws.stage(source.select("path_id", F.unhex(F.sha2("body", 256)).alias("blob"), F.monotonically_increasing_id().alias("row_tag")), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path_id").alias("path_id"))
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.parquet(ledger).where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    todo = ws.stage(blobs.select("path_id", F.col("blob").alias("want")), "todo")
    # One representative row per unseen blob; a repeated path_id is settled by comparing the content again.
    texts = source.join(todo.withColumnRenamed("path_id", "at"), F.col("path_id").eqNullSafe(F.col("at"))).where(F.unhex(F.sha2("body", 256)) == F.col("want"))
    fresh = texts.select(F.col("want").alias("blob"), F.lit(rule_version).alias("rule_version"), all_spans(F.col("body"), rules).alias("spans")).dropDuplicates(["blob"])
    fresh.write.mode("append").option("compression", "zstd").parquet(ledger)
    # a pair that two runs appended at the same time counts once
    known = spark.read.parquet(ledger).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    # Copies of one blob may be a third of all rows: findings reach them through (blob, salt) parts. Blobs without any finding need no join.
    parts = F.pmod(F.xxhash64("row_tag"), F.lit(1024)).cast("int")
    salted = paths.withColumn("salt", parts)
    hit = salted.select("blob", "salt").distinct().join(known, "blob")
    return salted.join(hit, ["blob", "salt"], "left").select(
        F.col("path_id").alias(id_col), "blob", F.coalesce("spans", F.expr("cast(array() AS array<struct<start:int,kind_no:int,kind:string,end:int>>)")).alias("spans")
    )


def report(findings: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, from the output of ``scan``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [r.kind for r in rules if r.base]
    only_base = F.filter("spans", lambda s: s["kind"].isin(base))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return findings.select(F.col(id_col), *counts, F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_spans(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """``text`` with its spans replaced by ``mask`` (overlapping spans by one)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def scan_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Scan all documents against a ledger (a new one, if none is named) and report per document."""
    ws = Workspace(docs.sparkSession, "secrets")
    return report(scan(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ledger or f"{ws.path}/ledger", ws))
