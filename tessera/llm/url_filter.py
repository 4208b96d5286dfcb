"""URL filters: a list of host-and-path rules, and a path-template tree for what no rule decides.

Rules come first: the longest that fits wins. Pages that a rule decides are the labelled examples of the tree.
Per host, paths become templates, level by level from the root: segments with digits, hex or many values are wildcards. A host's
templates are counted by executors, pre-aggregated per template (a host may hold a third of all pages), and only per-template counts are
shuffled. Every prefix of a template is a branch, of its host and, as a pattern, of all hosts of the suffix. A branch's parent is its pattern
if that has labels, else the branch above it. A branch that a two-proportion test cannot tell from the rest of its parent's labels is merged:
it has the parent's purity, so one without labels has that of the next branch with some. Any other has its own, smoothed towards the parent's.
A suffix is smoothed towards none blocked, so a few labels decide nothing on their own.

Defined results: a null URL, or one without ``://``, has an empty host and path and is allowed; very long URLs are judged whole; of rules that tie
in length the first by name wins; a purity of exactly REJECT_OVER is allowed; an empty table gives an empty result; repeated rows are judged
alike; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, group_facts

#: Fixed values: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Pseudo-labels with which a template starts, at the purity of its parent.
SMOOTHING = 8.0
#: A template is rejected if its smoothed share of blocked labels is over this.
REJECT_OVER = 0.5
#: Distinct values under one parent from which a segment counts as variable, if no value is common.
VARIABLE_FROM = 16
#: A branch whose purity differs from its siblings' by fewer standard errors is merged with them.
MERGE_Z = 1.96


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for name, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, start = name.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def shape_of(segment: Column) -> Column:
    """A wildcard for a segment that looks generated: it has a digit, is a long hex or opaque word, or is very long."""
    return F.when(segment.rlike(r"[0-9]"), "*").when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), "*").when(F.length(segment) > 40, "*").otherwise(segment)


def _smoothed(n: Column, blocked: Column, of_n: Column, of_blocked: Column, purity: Column) -> Column:
    """The purity of a branch with ``n`` labels below a parent with ``of_n`` (its own among them) and the given purity."""
    rest, share = of_n - n, F.try_divide(of_blocked, of_n)
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest)))
    alike = F.abs(F.try_divide(blocked, n) - F.try_divide(of_blocked - blocked, rest)) <= MERGE_Z * error
    merged = (n == 0) | ((of_n > 0) & ((rest <= 0) | alike))
    return F.when(merged, purity).otherwise((blocked + SMOOTHING * purity) / (n + SMOOTHING))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, and its labels and smoothed purity.

    ``labels`` (page_id, says: block or allow; one row a page) adds labelled pages to those that a rule decides.
    """
    ws = Workspace(pages.sparkSession, "url-filter")
    url = F.col(url_col)
    split = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row_tag"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    shaped = split.withColumns({"rule": rule, "ruled": verdict, "shape": F.concat(F.lit("/"), F.array_join(F.transform(segments, shape_of), "/"))})
    shaped = shaped.join(labels.select("page_id", "says"), "page_id", "left") if labels is not None else shaped.withColumn("says", F.lit(None).cast("string"))
    shaped = shaped.withColumn("label", F.coalesce("ruled", "says"))
    rows = ws.stage(shaped, "rows")

    # The tree, as (host, shape) counts: one row per template, whatever the number of pages.
    leaves = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked"))
    tree = ws.stage(leaves.withColumn("branch", F.filter(F.split("shape", "/"), lambda s: s != "")), "tree")
    # A level can have a variable segment if a host has enough shapes that deep; deeper levels need no look.
    deep = tree.groupBy("host", F.size("branch").alias("depth")).agg(F.count(F.lit(1)).alias("shapes"))
    deep = deep.withColumn("shapes", F.sum("shapes").over(Window.partitionBy("host").orderBy(F.desc("depth"))))
    for level in range(deep.where(F.col("shapes") >= VARIABLE_FROM).agg(F.max("depth")).first()[0] or 0):
        # A parent with many children, none of them common, has a variable next segment.
        at = tree.withColumns({"parent": F.array_join(F.slice("branch", 1, level), "/"), "next": F.get("branch", F.lit(level))})
        children = at.where("next IS NOT NULL").groupBy("host", "parent", "next").agg(F.sum("pages").alias("pages"))
        below = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("children"), F.max("pages").alias("largest"), F.sum("pages").alias("all_pages"))
        variable = below.where((F.col("children") >= VARIABLE_FROM) & (F.col("largest") * VARIABLE_FROM < F.col("all_pages") * 2)).select("host", "parent", F.lit(True).alias("variable"))
        merged = F.when(F.col("variable"), F.concat(F.slice("branch", 1, level), F.array(F.lit("*")), F.slice("branch", level + 2, F.size("branch")))).otherwise(F.col("branch"))
        tree = ws.stage(at.join(variable, ["host", "parent"], "left").select("host", "shape", "pages", "labelled", "blocked", merged.alias("branch")), f"tree-{level}")
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("branch", "/")))
    by_template = tree.groupBy("host", "template", "branch").agg(*(F.sum(c).alias(c) for c in ("labelled", "blocked")))
    # Every prefix of a template, with the labels below it on its host and on all hosts of the suffix.
    depths = by_template.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("branch"))))
    prefixes = ws.stage(depths.select(F.substring_index("host", ".", -1).alias("suffix"), "host", "template", "depth", F.array_join(F.expr("slice(branch, 1, depth)"), "/").alias("prefix"), "labelled", "blocked"), "prefixes")
    total = lambda to: [(f"{to}_{c}", F.sum(c), F.sum(f"{to}_{c}")) for c in ("labelled", "blocked")]
    on_host = ws.stage(group_facts(prefixes, ["host", "prefix"], ["template"], total("host")), "on-host")
    known = group_facts(on_host, ["suffix", "prefix"], ["host", "template"], total("suffix"))
    known = known.withColumn("node", F.struct("depth", *(F.col(f"{w}_{c}").cast("double").alias(f"{w}_{c}") for w in ("host", "suffix") for c in ("labelled", "blocked"))))
    chains = known.groupBy("host", "template").agg(F.array_sort(F.collect_list("node")).alias("chain"), F.first("labelled").alias("labelled"))

    def down(above: Column, node: Column) -> Column:
        s, h = (node["suffix_labelled"], node["suffix_blocked"]), (node["host_labelled"], node["host_blocked"])
        pattern = _smoothed(*s, above["sn"], above["sb"], above["sp"])
        of = [F.when(s[0] > 0, x).otherwise(above[y]) for x, y in ((s[0], "hn"), (s[1], "hb"), (pattern, "hp"))]
        return F.struct(s[0].alias("sn"), s[1].alias("sb"), pattern.alias("sp"), h[0].alias("hn"), h[1].alias("hb"), _smoothed(*h, *of).alias("hp"))

    none = F.struct(*(F.lit(0.0).alias(c) for c in ("sn", "sb", "sp", "hn", "hb", "hp")))
    judged = chains.select("host", "template", "labelled", F.aggregate("chain", none, down)["hp"].alias("blocked_share"))
    facts = tree.select("host", "shape", "template").join(judged, ["host", "template"])
    # Back to pages in (host, shape, salt) parts: a hot host is spread.
    salt = F.pmod(F.xxhash64("row_tag"), F.lit(1024)).cast("int")
    salted = rows.withColumn("salt", salt)
    parts = ws.stage(salted.select("host", "shape", "salt").distinct().join(facts, ["host", "shape"]), "parts")
    out = salted.join(parts, ["host", "shape", "salt"])
    learned = F.when((F.col("host") != "") & (F.col("blocked_share") > REJECT_OVER), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "labelled", "blocked_share")
