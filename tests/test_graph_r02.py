"""The phrase graph against brute force, and what it shuffles."""

import random

from pyspark.sql import functions as F

from tessera.operators import graph


def _made(spark, n, seed):
    r = random.Random(seed)
    held = {i * 7 - 100: {f"p{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randint(0, 6))} | ({f"own{i}"} if i % 3 == 0 else set()) for i in range(n)}
    return held, spark.createDataFrame([(d, p) for d, ps in held.items() for p in ps], "document_id long, phrase string")


def test_search_edges_and_size_in_small_blocks(spark, monkeypatch):
    """Several blocks, parts, strong documents and a sample that is not everyone."""
    for name, value in (("BLOCK", 64), ("STRONG", 16), ("SAMPLE", 100), ("DENSE", 4)):
        monkeypatch.setattr(graph, name, value)
    held, dp = _made(spark, 500, 1)
    docs = spark.createDataFrame([(d,) for d in held], "document_id long")
    pairs = {(a, b) for a in held for b in held if a != b and held[a] & held[b]}
    assert tuple(graph.size(docs, dp).first()) == (500, len(pairs) // 2)
    some = [d for d in held if d % 10 == 0]
    found = [tuple(x) for x in graph.edges_of(dp, dp.where(F.col("document_id") % 10 == 0)).collect()]
    assert sorted(found) == sorted(p for p in pairs if p[0] in some)
    asked = {q: {f"p{q}", f"p{q * 3}", "nowhere"} for q in range(12)} | {99: {"nowhere"}}
    got = {}
    for x in graph.search(dp, spark.createDataFrame([(q, p) for q, ps in asked.items() for p in ps], "query_id long, phrase string")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.document_id, x.contribution))
    for q, ps in asked.items():
        seeds = {d for d in held if held[d] & ps}
        votes = {d: 2 * (d in seeds) + sum((s, d) in pairs for s in seeds) for d in held}
        want = sorted((-v, d) for d, v in votes.items() if v)[:12]
        assert sorted(got.get(q, [])) == [(i + 1, d, -v) for i, (v, d) in enumerate(want)], q


def test_blocks_meet_without_a_shuffle(spark):
    """Postings were copied to every part of the other side (blocks times parts) before."""
    _, dp = _made(spark, 60, 2)
    plan = graph.edges_of(dp, dp)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
