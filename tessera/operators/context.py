"""Cited context: candidates packed into a character budget, as a fold over one request's ordered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELLIPSIS = "…"


def assemble(candidates: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """(by, text, n_items, truncated) from candidates (by, kind, item_id, source_uri, version, content, score).

    Items come by score, knowledge before memory, then id. One of several items may take at most its share of the budget; an
    item whose heading does not fit ends the context, as does one that had to be cut to what was left.
    """
    order = F.struct((-F.col("score")).alias("less"), F.when(F.col("kind") == "knowledge", 0).otherwise(1).alias("first"), "item_id", "kind", "source_uri", "version", "content")
    items = candidates.groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("items"))
    slots = F.least(F.size("items"), F.lit(4))
    cap = F.when(slots <= 1, budget).otherwise(F.greatest(F.lit(24), F.floor(F.lit(budget) / slots).cast("int") - 64))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("k"), F.lit(0).alias("m"), F.lit(False).alias("done"), F.lit(False).alias("cut"))

    def state(text: Column, k: Column, m: Column, done: Column, cut: Column) -> Column:
        return F.struct(text.alias("text"), k.alias("k"), m.alias("m"), done.alias("done"), cut.alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        knowledge = x["kind"] == "knowledge"
        label = F.when(knowledge, F.concat(F.lit("K"), acc["k"] + 1)).otherwise(F.concat(F.lit("M"), acc["m"] + 1))
        version = F.when(x["version"].isNotNull(), F.concat(F.lit("; version="), x["version"])).otherwise("")
        head = F.concat(F.lit("["), label, F.lit("] "), x["kind"], F.lit(": "), F.substring(x["source_uri"], 1, 160), version, F.lit("\n"))
        gap = F.when(acc["text"] == "", "").otherwise("\n\n")
        room = F.lit(budget) - F.length(acc["text"]) - F.length(gap) - F.length(head)
        clip = lambda text, n: F.concat(F.call_function("substring", text, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(ELLIPSIS))
        capped = F.length(x["content"]) > cap
        body = F.when(capped, clip(x["content"], cap)).otherwise(x["content"])
        tight = F.length(body) > room
        last = F.when(tight, clip(body, room)).otherwise(body)
        stop = (room <= 0) | (tight & (room <= 1))
        taken = state(F.concat(acc["text"], gap, head, last), acc["k"] + knowledge.cast("int"), acc["m"] + (~knowledge).cast("int"), tight, acc["cut"] | capped | tight)
        return F.when(acc["done"], acc).when(stop, state(acc["text"], acc["k"], acc["m"], F.lit(True), F.lit(True))).otherwise(taken)

    packed = items.select(by, F.size("items").alias("n"), F.aggregate("items", start, step).alias("s"))
    return packed.select(by, F.col("s.text").alias("text"), (F.col("s.k") + F.col("s.m")).alias("n_items"), (F.col("s.cut") | (F.col("s.k") + F.col("s.m") < F.col("n"))).alias("truncated"))
