"""Plans, facts, handoffs and trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest attempt per (plan, slot)."""
    return runs.groupBy("plan_id", "slot_id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))


def ready_slots(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Slots (plan_id, slot_id, depends_on, max_attempts) that may start: every dependency's latest run succeeded, attempts
    are left, and the slot is neither active nor done."""
    last = latest_runs(runs)
    deps = slots.select("plan_id", "slot_id", F.explode("depends_on").alias("dep"))
    done = last.select("plan_id", F.col("slot_id").alias("dep"), F.col("status").alias("dep_status"))
    blocked = deps.join(done, ["plan_id", "dep"], "left").where("coalesce(dep_status, '') != 'succeeded'").select("plan_id", "slot_id").distinct()
    state = slots.join(last, ["plan_id", "slot_id"], "left")
    open_ = state.where("status IS NULL OR (status = 'failed' AND attempt < max_attempts)")
    return open_.join(blocked, ["plan_id", "slot_id"], "left_anti").select("plan_id", "slot_id", (F.coalesce("attempt", F.lit(0)) + 1).alias("next_attempt"))


#: The states of a run that is not over, and of a plan that may start runs.
ACTIVE = ("pending", "queued", "running", "waiting_approval")
OPEN_PLANS = ("ready", "running")


def next_slots(plans: DataFrame, slots: DataFrame, runs: DataFrame) -> DataFrame:
    """(plan_id, slot_id, next_attempt, position): what may start now.

    ``plans`` (plan_id, status, max_role_runs), ``slots`` (plan_id, slot_id, order, depends_on, max_attempts), ``runs`` (plan_id, slot_id, attempt,
    status). The plan is open and has runs left; the slot's latest run is none or failed, attempts are left, and all it waits for succeeded.
    """
    last = latest_runs(runs)
    used = runs.groupBy("plan_id").agg(F.count(F.lit(1)).alias("used"))
    plan = plans.join(used, "plan_id", "left").where(F.col("status").isin(list(OPEN_PLANS)) & (F.coalesce("used", F.lit(0)) < F.col("max_role_runs"))).select("plan_id")
    ready = ready_slots(slots.join(plan, "plan_id", "left_semi"), runs.join(plan, "plan_id", "left_semi"))
    never = last.where(F.col("status").isin([*ACTIVE, "succeeded", "cancelled"])).select("plan_id", "slot_id")
    numbered = ready.join(never, ["plan_id", "slot_id"], "left_anti").join(slots.select("plan_id", "slot_id", "order"), ["plan_id", "slot_id"])
    return numbered.select("plan_id", "slot_id", "next_attempt", F.row_number().over(Window.partitionBy("plan_id").orderBy("order", "slot_id")).alias("position"))


def owned_runs(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest run of each slot, of plans with an owner (plan_id, owner_user_id, tenant_id, conversation_id) in the run's tenant and conversation."""
    own = plans.select("plan_id", "owner_user_id", "tenant_id", "conversation_id")
    mine = runs.join(own, ["plan_id", "tenant_id", "conversation_id"])
    return mine.groupBy("owner_user_id", "plan_id", "slot_id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))


def cyclic(slots: DataFrame) -> DataFrame:
    """Plans (plan_id, n_stuck) whose slots (plan_id, slot_id, depends_on) do not form an acyclic graph: a fold that peels ready layers off each plan's row."""
    # only dependencies on slots of the plan hold a slot back
    held = slots.groupBy("plan_id").agg(F.collect_list(F.struct("slot_id", "depends_on")).alias("slots"))
    left = F.transform("slots", lambda s: s["slot_id"])
    peel = lambda rest, _: F.transform(F.filter("slots", lambda s: F.array_contains(rest, s["slot_id"]) & F.arrays_overlap(s["depends_on"], rest)), lambda s: s["slot_id"])
    stuck = F.aggregate(F.sequence(F.lit(1), F.size("slots")), left, peel)
    return held.select("plan_id", F.size(stuck).alias("n_stuck")).where("n_stuck > 0")


def completion(plans: DataFrame, slots: DataFrame, runs: DataFrame) -> DataFrame:
    """(plan_id, verdict): whether a plan may complete: no latest run is active, and all that its required slots (plan_id, slot_id, required, depends_on) need succeeded."""
    last = latest_runs(runs)
    busy = last.groupBy("plan_id").agg(F.count_if(F.col("status").isin(list(ACTIVE))).alias("busy"))
    needed = closure(slots.select("plan_id", "slot_id", F.explode("depends_on").alias("dep")), slots.where("required").select("plan_id", "slot_id"))
    missing = needed.join(last.where("status = 'succeeded'"), ["plan_id", "slot_id"], "left_anti").groupBy("plan_id").agg(F.count(F.lit(1)).alias("missing"))
    both = plans.select("plan_id").join(busy, "plan_id", "left").join(missing, "plan_id", "left")
    return both.select("plan_id", F.when(F.coalesce("busy", F.lit(0)) > 0, "active").when(F.coalesce("missing", F.lit(0)) > 0, "missing").otherwise("complete").alias("verdict"))


def ungrounded(cited: DataFrame, retrieved: DataFrame, facts: DataFrame, peers: DataFrame) -> DataFrame:
    """(case_id, ref) of citations that are neither retrieved, nor a shared fact (``fact:`` and its id), nor a source that a peer retrieved.

    All sides are (case_id, ref), facts (case_id, fact_id). A case that retrieved nothing has all its citations refused.
    """
    some = retrieved.select("case_id").distinct()
    known = retrieved.select("case_id", "ref").unionByName(facts.select("case_id", F.concat(F.lit("fact:"), F.col("fact_id").cast("string")).alias("ref"))).unionByName(peers.select("case_id", "ref"))
    asked = cited.select("case_id", "ref").distinct()
    return asked.join(known.join(some, "case_id", "left_semi"), ["case_id", "ref"], "left_anti")


def listed_runs(runs: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """Runs of each plan in the order of slot and attempt; ``roles`` restricts them, None does not."""
    some = runs if roles is None else runs.where(F.col("role").isin(list(roles)))
    return some.withColumn("position", F.row_number().over(Window.partitionBy("plan_id").orderBy("slot_id", "attempt")))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Everything that ``starts`` (plan_id, slot_id) need, themselves included, over edges (plan_id, slot_id, dep).

    A plan has few slots, so it fits a row: one shuffle by plan, and a fold that widens the reached set, without rounds.
    """
    graph = edges.groupBy("plan_id").agg(F.collect_list(F.struct("slot_id", "dep")).alias("edges"))
    begin = starts.groupBy("plan_id").agg(F.collect_set("slot_id").alias("reached"))
    both = begin.join(graph, "plan_id", "left").withColumn("edges", F.coalesce("edges", F.filter(F.array(F.struct(F.col("reached")[0].alias("slot_id"), F.col("reached")[0].alias("dep"))), lambda e: F.lit(False))))
    widen = lambda reached: F.array_union(reached, F.transform(F.filter("edges", lambda e: F.array_contains(reached, e["slot_id"])), lambda e: e["dep"]))
    rounds = F.sequence(F.lit(1), F.size("edges") + 1)
    return both.select("plan_id", F.explode(F.aggregate(rounds, F.col("reached"), lambda acc, _: widen(acc))).alias("slot_id"))


def fact_versions(facts: DataFrame) -> DataFrame:
    """Version number and superseded id of each proposed fact (tenant_id, fact_key, fact_id, created_at)."""
    chain = Window.partitionBy("tenant_id", "fact_key").orderBy("created_at", "fact_id")
    return facts.select("tenant_id", "fact_key", "fact_id", F.row_number().over(chain).alias("version"), F.lag("fact_id").over(chain).alias("supersedes_fact_id"))


def fact_heads(versions: DataFrame) -> DataFrame:
    return versions.groupBy("tenant_id", "fact_key").agg(F.max("version").alias("version"), F.max_by("fact_id", "version").alias("fact_id"))


def grounded_claims(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Claims (run_id, claim_id, refs) whose references were all retrieved (run_id, ref); claims without any are not grounded."""
    cited = claims.select("run_id", "claim_id", F.explode("refs").alias("ref")).distinct()
    lost = cited.join(retrieved.select("run_id", "ref").distinct(), ["run_id", "ref"], "left_anti").groupBy("run_id", "claim_id").agg(F.count(F.lit(1)).alias("lost"))
    return claims.join(lost, ["run_id", "claim_id"], "left").select("run_id", "claim_id", ((F.size("refs") > 0) & F.col("lost").isNull()).alias("grounded"))


def bind_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (case_id, ref) to submitted evidence (case_id, evidence_id, locator): bound, missing or ambiguous."""
    keys = evidence.select("case_id", F.explode(F.array("evidence_id", "locator")).alias("ref"), "evidence_id").where("ref IS NOT NULL").distinct()
    found = citations.where("NOT startswith(ref, 'fact:')").distinct().join(keys, ["case_id", "ref"], "left")
    n = F.count_distinct("evidence_id")
    return found.groupBy("case_id", "ref").agg(F.when(n == 0, "missing").when(n == 1, "bound").otherwise("ambiguous").alias("verdict"), F.min(F.col("evidence_id")).alias("first_evidence"))


def valid_handoffs(handoffs: DataFrame, heads: DataFrame) -> DataFrame:
    """Handoffs (handoff_id, fact_key, fact_id, source, target_depends_on) whose fact is its key's head and whose target waits for the source."""
    head = heads.select("fact_key", F.col("fact_id").alias("head_id"))
    return handoffs.join(head, "fact_key", "left").select("handoff_id", (F.coalesce(F.col("fact_id") == F.col("head_id"), F.lit(False)) & F.array_contains("target_depends_on", F.col("source"))).alias("valid"))


def score_trajectories(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Per run: steps, missing and forbidden tools, and whether it passed.

    ``steps`` (run_id, step, tool, ok, error); ``rules`` (run_id, required, forbidden, most_steps, status, expected_status, answer, expected_parts).
    A run passes if all required tools and no forbidden one were used within the step budget, it ended in the expected state, and the answer
    holds every expected part. A failed step whose error is a refusal is a violation too, and any violation fails the run hard.
    """
    from .operations import safety_violation

    used = steps.groupBy("run_id").agg(F.collect_set("tool").alias("used"), F.max("step").alias("steps"), F.count_if(safety_violation(F.col("ok"), F.col("error"))).alias("refused"))
    both = rules.join(used, "run_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>"))).withColumn("steps", F.coalesce("steps", F.lit(0)))
    missing, bad = F.size(F.array_except("required", "used")), F.size(F.array_intersect("forbidden", "used")) + F.coalesce("refused", F.lit(0))
    answered = F.forall("expected_parts", lambda p: F.contains(F.lower("answer"), F.lower(p)))
    scored = both.withColumns({"missing": missing, "violations": bad, "hard_fail": bad > 0, "status_ok": F.col("status") == F.col("expected_status"), "answer_ok": F.coalesce(answered, F.lit(False))})
    passed = (F.col("missing") == 0) & ~F.col("hard_fail") & F.col("status_ok") & F.col("answer_ok") & (F.col("steps") <= F.col("most_steps"))
    return scored.select("run_id", "steps", "missing", F.col("violations").cast("long").alias("violations"), "hard_fail", "status_ok", "answer_ok", passed.alias("passed"))


def first_seen(rows: DataFrame, group: str, key: str, order: str, most: int | None = None) -> DataFrame:
    """Distinct keys per group in the order first seen, optionally the first ``most`` of them (a top-k report)."""
    firsts = rows.groupBy(group, key).agg(F.min(order).alias("first_at"))
    numbered = firsts.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("first_at", key)))
    return numbered if most is None else numbered.where(F.col("pos") <= most)
