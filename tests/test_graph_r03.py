"""What round 3 found: a search that counted most documents against all others, once the sample was a small part of them."""

import random

from tessera.operators import graph


def test_search_counts_few_documents_in_full(spark, monkeypatch):
    """Every document ties for the first query, and a sample of 100 of 2,000 rules nobody out: all of them were counted before."""
    monkeypatch.setattr(graph, "STRONG", 16)
    monkeypatch.setattr(graph, "SAMPLE", 100)
    r = random.Random(3)
    held = {i: {"common", *(f"p{r.randint(0, 300)}" for _ in range(r.randint(1, 5)))} | ({"rare"} if i % 70 == 69 else set()) for i in range(0, 4000, 2)}
    held |= {5001 + i: {f"p{i}", f"p{i + 1}"} for i in range(0, 40, 2)}
    dp = spark.createDataFrame([(d, p) for d, ps in held.items() for p in ps], "document_id long, phrase string")
    asked = {1: {"common"}, 2: {"rare", "common", "p7"}, 3: {"p7", "p8"}, 4: {"nowhere"}}
    counted, staged = [], graph.staged

    def noted(df, name="stage"):
        made = staged(df, name)
        counted.extend([made] * (name == "parts"))
        return made

    monkeypatch.setattr(graph, "staged", noted)
    got = {}
    for x in graph.search(dp, spark.createDataFrame([(q, p) for q, ps in asked.items() for p in ps], "query_id long, phrase string")).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.document_id, x.contribution))
    for q, ps in asked.items():
        seeds = {d for d in held if held[d] & ps}
        votes = {d: 2 * (d in seeds) + sum(s != d and bool(held[s] & held[d]) for s in seeds) for d in held}
        want = sorted((-v, d) for d, v in votes.items() if v)[:12]
        assert sorted(got.get(q, [])) == [(i + 1, d, -v) for i, (v, d) in enumerate(want)], q
    assert sum(len(x.docs) // 8 for part in counted for x in part.select("docs").collect()) < len(held) // 2


def test_edges_come_neighbour_by_neighbour(spark):
    """Rows changed their neighbour every time before, which columnar files cannot hold in runs."""
    held = {i: {f"p{i % 3}", f"own{i}"} for i in range(300)}
    dp = spark.createDataFrame([(d, p) for d, ps in held.items() for p in ps], "document_id long, phrase string")
    found = [tuple(x) for x in graph.edges_of(dp, dp.where("document_id % 10 = 0")).collect()]
    assert sorted(found) == sorted((a, b) for a in held if a % 10 == 0 for b in held if a != b and held[a] & held[b])
    assert sum(x[1] != y[1] for x, y in zip(found, found[1:])) < len(found) // 2
