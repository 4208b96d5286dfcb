"""Dataset readers, sinks, arithmetic and context on small files and rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.arithmetic import evaluate, value_of
from tessera.operators import chunking, context
from tessera.sources import datasets


def write(path, data):
    path.write_text(json.dumps(data), encoding="utf-8")
    return str(path)


def test_tatqa(spark, tmp_path):
    q = {"uid": "q1", "question": " What? ", "answer": ["5"], "answer_type": "span", "answer_from": "table-text", "rel_paragraphs": ["2", "9"], "derivation": "", "scale": ""}
    raw = [{"table": {"uid": "T", "table": [[" a ", "b"], ["1", "2"]]}, "paragraphs": [{"order": 2, "uid": "p", "text": " para "}], "questions": [q, {**q, "uid": "q2", "answer_from": "text", "rel_paragraphs": []}, {**q, "uid": "q3", "answer_type": "count"}]}]
    docs, cases = datasets.tatqa(spark, write(tmp_path / "t.json", raw))
    assert {r.document_id: r.text for r in docs.collect()} == {"tatqa:T:table": "a | b\n1 | 2", "tatqa:T:paragraph:2": "para"}
    assert {r.case_id: (r.relevant_ids, r.category) for r in cases.collect()} == {"tatqa:q1": (["tatqa:T:table", "tatqa:T:paragraph:2"], "table"), "tatqa:q3": (["tatqa:T:table", "tatqa:T:paragraph:2"], "count")}


def test_multihop(spark, tmp_path):
    corpus = write(tmp_path / "c.json", [{"url": "u1", "body": "one"}, {"url": "u2", "body": "two"}])
    e = [{"url": "u2", "fact": "x"}, {"url": "u1", "fact": "y"}, {"url": "u2", "fact": "z"}]
    queries = write(tmp_path / "q.json", [{"query": "q", "question_type": "inference", "answer": "a", "evidence_list": e}, {"query": "n", "question_type": "null_query", "evidence_list": []}])
    docs, cases = datasets.multihop(spark, queries, corpus)
    ids = {r.source_uri: r.document_id for r in docs.collect()}
    (case,) = cases.collect()
    assert case.relevant_ids == [ids["u2"], ids["u1"]] and case.category == "inference"
    bad = write(tmp_path / "b.json", [{"query": "q", "question_type": "i", "evidence_list": [{"url": "zz"}]}])
    with pytest.raises(Exception, match="unknown address"):
        datasets.multihop(spark, bad, corpus)[1].collect()


def test_mmlongbench(spark, tmp_path):
    rows = [{"doc_id": "d", "question": "q", "evidence_pages": "[1, 2]", "evidence_sources": "['Table']"}, {"doc_id": "d", "question": "q", "evidence_pages": "[]"}, {"doc_id": "e", "question": "q", "evidence_pages": "['3']"}]
    got = {tuple(r.relevant_ids): r.category for r in datasets.mmlongbench(spark, write(tmp_path / "m.json", rows)).collect()}
    assert got[("mmlongbench:d:page:1", "mmlongbench:d:page:2")] == "cross-page-table" and got[("mmlongbench:e:page:3",)] == "single-page" and len(got) == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("häuser", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_bytes(b"nul\x00byte")
    assert [r.text for r in datasets.text_files(spark, str(tmp_path), "*.txt", strict=False).collect()] == ["häuser"]
    for name, reason in (("b.txt", "not UTF-8"), ("c.txt", "not a text")):
        with pytest.raises(Exception, match=reason):
            datasets.text_files(spark, str(tmp_path), name).collect()
    with pytest.raises(Exception, match="too large"):
        datasets.text_files(spark, str(tmp_path), "a.txt", most_bytes=3).collect()


def test_workspace_and_docs_files(spark, tmp_path):
    for name in ("a.md", "sub/b.py", ".git/config", ".env", "key.pem", "node_modules/x.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("0123456789")
    assert sorted(r.path.split(str(tmp_path))[1] for r in datasets.workspace_files(spark, str(tmp_path)).collect()) == ["/a.md", "/sub/b.py"]
    assert [(r.chunk_id, r.text) for r in datasets.docs_files(spark, str(tmp_path), ["a.md"], 4).collect()] == [("docs:a.md", "0123")]


def test_strict_json_drops_corrupt_rows_only(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":',), ('{"a":"x"}',), (None,)], "j string")
    assert [r.v and r.v.a for r in df.select(datasets.strict_json(F.col("j"), "a int").alias("v")).collect()] == [1, None, None, None]


def test_plugged_in_embedders_and_rerankers(spark):
    """What is plugged in must keep its contract: a finite vector of the right size per text, a finite score per text."""
    from tessera.operators import retrieval as r

    texts = spark.createDataFrame([(1, "aa"), (2, "b")], "id long, text string")
    assert {x.id: x.vector for x in r.embed_with(texts, lambda ts: [[len(t), 1.0] for t in ts], 2).collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    for bad in (lambda ts: [[1.0] for _ in ts], lambda ts: [[1.0, float("nan")] for _ in ts], lambda ts: []):
        with pytest.raises(Exception, match="embedder broke"):
            r.embed_with(texts, bad, 2).collect()
    hits = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.9)], "query_id long, chunk_id long, score double")
    queries = spark.createDataFrame([(7, "q")], "query_id long, query string")
    held = texts.withColumnRenamed("id", "chunk_id")
    assert [(x.chunk_id, x.rank) for x in r.rerank_with(hits, held, queries, lambda q, ts: [len(t) for t in ts], 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="reranker broke"):
        r.rerank_with(hits, held, queries, lambda q, ts: [float("inf")] * len(ts), 2).collect()


def test_hashed_vectors_have_the_published_hash(spark):
    """Against hashlib and math, term by term."""
    import hashlib
    import math
    from collections import Counter

    from tessera.operators import retrieval as r

    words = ["alpha", "beta", "beta", "gamma", "中"]
    terms = spark.createDataFrame([(1, w, n) for w, n in Counter(words).items()], "id long, term string, tf long")
    sparse, dense = Counter(), Counter()
    for w, n in Counter(words).items():
        sparse[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 2_147_483_647] += n
        h = hashlib.blake2b(w.encode(), digest_size=16).digest()
        dense[int.from_bytes(h[:8], "big") % 64] += (1 if h[8] & 1 else -1) * (1 + math.log(n))
    assert {int(x.bucket): x.value for x in r.sparse_vectors(terms).collect()} == sparse
    norm = math.sqrt(sum(v * v for v in dense.values()))
    assert {int(x.bucket): x.value for x in r.dense_hash_embedding(terms).collect()} == {b: round(v / norm, 6) for b, v in dense.items()}


def test_publish_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(2, None)], "b int, a string")
    datasets.publish(df, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":null,"b":2}']
    with pytest.raises(FileExistsError):
        datasets.publish(df, f"{tmp_path}/out")


def test_arithmetic(spark):
    cases = {"1 + 2*3": 7, "-2**2": -4, "2**-1": 0.5, "2**3**2": 512, "(1+2)*3": 9, "7//2 % 2": 1, "- -3": 3, "1/0": None, "2**13": None, "a+1": None, "": None, "1e101": None, "(1": None, "1 2": None}
    assert {k: value_of(k) for k in cases} == cases
    assert spark.createDataFrame([("1+1",)], "e string").select(evaluate("e").alias("v")).first().v == 2.0


def test_newline_chunks(spark):
    t = "a" * 70 + "\n" + "b" * 60 + "\n" + "c" * 30
    rows = spark.createDataFrame([(t,)], "t string").select(chunking.newline_chunks(F.col("t"), 100, 10).alias("c")).first().c
    assert [(r.start, r.end) for r in rows] == [(0, 71), (61, 132), (122, 162)] and all(t[r.start : r.end].strip() == r.text for r in rows)


def test_context(spark):
    rows = [(1, "memory", "m", "mem", None, "y" * 10, 0.9), (1, "knowledge", "k", "src", "2", "x" * 300, 0.9), (2, "knowledge", "k", "s", None, "z" * 5, 0.1)]
    df = spark.createDataFrame(rows, "query_id int, kind string, item_id string, source_uri string, version string, content string, score double")
    got = {r.query_id: r for r in context.assemble(df, 200).collect()}
    assert got[1].text.startswith("[K1] knowledge: src; version=2\n" + "x" * 35 + "…\n\n[M1] memory: mem\nyyy") and got[1].truncated and got[1].n_items == 2
    assert (got[2].text, got[2].truncated) == ("[K1] knowledge: s\nzzzzz", False)
