"""Operators on hand-made rows with known results."""

import math
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import chunking, evaluation, operations, orchestration, retrieval, scope


def column(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_tokens_follow_the_exact_folding(spark):
    for t in ("Straße HELLO_world x-1", "中文 text", "ABC déf", "", "ıI"):
        exact = unicodedata.normalize("NFKC", t).casefold()
        import re

        want = re.findall("[a-z0-9_ı]+|[㐀-䶿一-鿿]", exact)
        assert column(spark, t, "string", text.tokens) == want
    assert column(spark, "ﬁne Ⅳ", "string", text.fold_exact) == "fine iv"


def test_answer_scores(spark):
    rows = [(1, 1, "$1,496.5", "1496.5"), (1, 2, "$1,496.5", "x"), (2, 1, "fixed price contract", "fixed contract"), (3, 1, "", "a")]
    got = {r.case_id: (r.exact_match, r.token_f1) for r in evaluation.answer_scores(spark.createDataFrame(rows, "case_id int, candidate_id int, prediction string, expected string")).collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.8), 3: (0, 0.0)}


def test_retrieval_metrics_with_a_missing_case(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, category string")
    relevant = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "case_id int, doc string")
    retrieved = spark.createDataFrame([(1, "n", 1), (1, "x", 2), (1, "y", 3)], "case_id int, doc string, rank int")
    m = evaluation.case_metrics(cases, retrieved, relevant, (1, 2, 3))
    s = evaluation.summary(m, ["recall_1", "recall_2", "recall_3", "rr_2", "ndcg_3"]).where("category IS NULL").first()
    assert (s.recall_1, s.recall_2, s.recall_3, s.rr_2, s.missing) == (0.0, 0.25, 0.5, 0.25, 1)
    assert s.ndcg_3 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)) / 2, abs=1e-6)


def test_bm25_counts_only_what_is_in_scope(spark):
    now = datetime(2024, 1, 1)
    rows = [(1, "t", "alpha beta", "k", 1, "1", ["tenant"]), (2, "t", "alpha", "k", 1, "1", ["user:other"]), (3, "u", "alpha", "k", 1, "1", ["tenant"]), (4, "t", "gamma", "k", 1, "1", ["tenant"])]
    chunks = spark.createDataFrame(rows, "chunk_id int, tenant_id string, text string, kb string, version_order int, version string, acl array<string>")
    chunks = chunks.withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp")})
    seen = scope.scoped(chunks, scope.Principal("t", user_id="me"), now)
    terms = retrieval.query_terms(spark.createDataFrame([(9, "alpha alpha")], "query_id int, query string"))
    (hit,) = retrieval.bm25(retrieval.documents_of(seen), terms).collect()
    idf, norm = math.log(1 + 1.5 / 1.5), 1.5 * (0.25 + 0.75 * 2 / 1.5)
    assert hit.chunk_id == 1 and hit.score == pytest.approx(idf * 2.5 / (1 + norm), abs=1e-6)
    assert scope.scoped(chunks, scope.Principal(None), now).count() == 0


def test_validity_is_half_open(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, at, None), (2, None, at), (3, None, None)], "i int, valid_from timestamp, valid_until timestamp")
    assert [r.i for r in rows.where(scope.valid_at(at)).collect()] == [1, 3]


def test_versions_order_naturally_and_ties_all_stay(spark):
    rows = [("a", 1, 1, "1.9"), ("b", 1, 1, "1.10"), ("c", 1, 1, "1.10"), ("d", 1, 0, "9")]
    df = spark.createDataFrame(rows, "id string, logical_id int, version_order int, version string")
    assert sorted(r.id for r in scope.latest_natural(df).collect()) == ["b", "c"]


def test_lexical_reranker(spark):
    df = spark.createDataFrame([(["alpha", "beta"], ["alpha"]), (["alpha", "beta"], ["alpha", "beta"])], "q array<string>, d array<string>")
    assert [r.s for r in df.select(scores.overlap_score(F.col("q"), F.col("d")).alias("s")).collect()] == [0.5, 1.0]


def test_neighbours_stop_at_the_document(spark):
    links = spark.createDataFrame([("l", "D", None, "c"), ("c", "D", "l", "r"), ("r", "D", "c", "x"), ("x", "E", "r", None)], "chunk_id string, document_id string, previous_id string, next_id string")
    seeds = spark.createDataFrame([(1, "c", 1.0, 1)], "query_id int, chunk_id string, score double, rank int")
    got = retrieval.neighbours(seeds, links, 3).orderBy("position").collect()
    assert [(r.chunk_id, r.score, r.is_seed) for r in got] == [("c", 1.0, True), ("l", 0.75, False), ("r", 0.75, False)]


def test_paragraph_chunks_overlap_and_split(spark):
    t = "\n\n".join(["a" * 300, "b" * 250, "c" * 200, "d" * 1300])
    got = column(spark, t, "string", lambda c: chunking.paragraph_chunks(c, 600, 100))
    assert got[0] == "a" * 300 + "\n" + "b" * 250 and got[1] == "b" * 100 + "\n" + "c" * 200
    assert [len(x) for x in got[2:]] == [600, 600, 300] and got[3][:100] == got[2][-100:]


def test_audit_metrics(spark):
    rows = [(1, "r", "run.done", "failed", None, 10.0, 5, False), (2, "r", "run.done", "OK", None, 70.0, None, False), (3, "r", "tool.execute", "ok", "t", 130.0, 7, False), (4, "r", "tool.execute", "error", "t", 300.0, None, True)]
    df = spark.createDataFrame(rows, "sequence int, run_id string, action string, outcome string, tool string, duration_ms double, total_tokens int, safety_violation boolean").withColumn("occurred_at", F.col("sequence"))
    m = operations.audit_metrics(df).first()
    assert (m.events, m.runs, m.runs_ok, m.tools, m.tools_ok, m.total_tokens, m.safety, m.p50) == (4, 1, 1, 2, 1, 12, 1, 100.0)
    nothing = operations.audit_metrics(df.where("false")).first()
    assert nothing.run_rate is None and nothing.total_tokens is None


def test_append_once(spark):
    stored = spark.createDataFrame([(1, "h")], "event_id int, content_hash string")
    incoming = spark.createDataFrame([(1, "h", 1), (1, "g", 2), (2, "k", 3), (2, "k", 4), (2, "m", 5)], "event_id int, content_hash string, arrival int")
    assert [r.verdict for r in operations.append_once(stored, incoming).orderBy("arrival").collect()] == ["replayed", "conflict", "inserted", "replayed", "conflict"]


def test_readiness_and_closure(spark):
    slots = spark.createDataFrame([(1, "a", [], 2), (1, "b", ["a"], 2), (1, "c", ["a", "b"], 2), (1, "d", [], 2)], "plan_id int, slot_id string, depends_on array<string>, max_attempts int")
    runs = spark.createDataFrame([(1, "a", 1, "failed"), (1, "a", 2, "succeeded"), (1, "d", 1, "failed")], "plan_id int, slot_id string, attempt int, status string")
    assert sorted((r.slot_id, r.next_attempt) for r in orchestration.ready_slots(slots, runs).collect()) == [("b", 1), ("d", 2)]
    edges = slots.select("plan_id", "slot_id", F.explode("depends_on").alias("dep"))
    start = spark.createDataFrame([(1, "c"), (2, "z")], "plan_id int, slot_id string")
    assert sorted(tuple(r) for r in orchestration.closure(edges, start).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "z")]


def test_budget_skips_what_does_not_fit(spark):
    items = [(1, 500), (2, 600), (3, 400), (4, 101), (5, 100)]
    df = spark.createDataFrame([(items,)], "items array<struct<id:int,size:int>>")
    assert [x.id for x in df.select(chunking.budget_skip(F.col("items"), "size", 10, 1000).alias("k")).first().k] == [1, 3, 5]


def test_redaction(spark):
    assert column(spark, "Bearer abcdefgh1 and password: x9 ok", "string", operations.redacted) == "[REDACTED] and [REDACTED] ok"
