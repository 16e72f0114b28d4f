import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirestone.operators import search
from quirestone.operators.candidates import drop_reasons, drop_summary, exact_duplicates, merged_neighbours, refined, reranked, score_gaps, without_near_duplicates
from quirestone.operators.context import budgeted, citation_line, context_statistics, history_line, prompts, routed
from quirestone.operators.embed import embedded, is_valid_vector, mock_embedding
from quirestone.operators.index import invalid_points, not_yet_indexed, package_diff, upsert_counts, upserted
from quirestone.operators import vector_index
from quirestone.operators.search import nearest, similarity


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_nearest_against_all_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 6)).round(1)
    vectors[5] = vectors[6]
    rows = [(i, vectors[i].tolist(), i % 3, "x") for i in range(120)] + [(None, [1.0] * 6, 0, "x"), (500, None, 0, "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int, score string").repartition(5)
    monkeypatch.setattr(search, "QUERIES_A_PASS", 4)

    def score(a, b):
        return {"cosine": a @ b / np.sqrt((a @ a) * (b @ b)), "dot": a @ b, "euclid": -np.sqrt(((a - b) ** 2).sum())}[metric]

    for match in (None, "label"):
        got = nearest(df, df.filter("id % 20 = 0"), id="id", vector="v", query_id="id", query_vector="v", k=7, metric=metric, match=match).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        assert sorted(by) == [0, 20, 40, 60, 80, 100]
        for q, found in by.items():
            pool = [i for i in range(120) if match is None or i % 3 == q % 3]
            want = sorted(pool, key=lambda i: (-round(float(score(vectors[q], vectors[i])), 9), i))[:7]
            assert [i for _, i, _ in sorted(found)] == want
            assert all(math.isclose(abs(s), abs(float(score(vectors[q], vectors[i]))), abs_tol=1e-6) for _, i, s in found)


def test_threshold_expression_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, v array<float>")
    q = df.filter("id = 1")
    ask = lambda rows, queries, **m: nearest(rows, queries, id="id", vector="v", query_id="id", query_vector="v", **m).collect()
    assert [(r.id, round(r.score, 6)) for r in ask(df, q, threshold=0.5)] == [(1, 1.0), (2, 0.6)]
    assert ask(df.limit(0), q) == [] and ask(df, q.limit(0)) == []
    v = df.crossJoin(q.select(F.col("v").alias("w"))).filter("id = 2")
    assert [round(v.select(similarity(F.col("v"), F.col("w"), m)).first()[0], 6) for m in ("cosine", "dot", "euclid")] == [0.6, 0.6, round(math.sqrt(0.8), 6)]
    with pytest.raises(ValueError):
        ask(df, q, metric="manhattan")


def test_embedding(spark):
    import hashlib

    row = spark.sql("select '  A\n\nB ' as t").select(mock_embedding(F.col("t"), 40)).first()[0]
    raw = hashlib.sha256(b"A B:0").digest() + hashlib.sha256(b"A B:1").digest()
    assert row == [b / 255 for b in raw[:40]]
    bad = [[1.0, 2.0], [1.0, math.nan, 3.0], [1.0, math.inf, 3.0], [1.0, None, 3.0], None]
    df = spark.createDataFrame([(v,) for v in bad + [[1.0, 2.0, 3.0]]], "v array<double>")
    assert [r[0] for r in df.select(is_valid_vector(F.col("v"), 3)).collect()] == [False] * 5 + [True]


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Provider:
        dimensions = 2

        def embed(self, texts):
            for t in texts:
                (log / f"{abs(hash(t))}-{random.random()}").write_text(t)
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("duplicate",), ("duplicate",), ("other",), (None,), ("cached",)], "t string")
    from quirestone.functions.text import content_hash

    cache = spark.createDataFrame([("cached",)], "t string").select(content_hash(F.col("t")).alias("hash"), F.array(F.lit(9.0), F.lit(9.0)).alias("vector"))
    got = sorted((str(r.t), r.vector, r.cache_hit) for r in embedded(df, text="t", provider=Provider, cache=cache).collect())
    assert got == [("None", None, None), ("cached", [9.0, 9.0], True), ("duplicate", [9.0, 1.0], False), ("duplicate", [9.0, 1.0], False), ("other", [5.0, 1.0], False)]
    assert sorted(p.read_text() for p in log.iterdir()) == ["duplicate", "other"]


def test_threshold_and_blank(spark):
    df = spark.createDataFrame([("q", 0.79, "x"), ("q", 0.8, "x"), ("q", 0.9, " "), ("q", math.nan, "x"), ("q", None, "x")], "q string, s double, t string")
    marked = drop_reasons(df, score="s", text="t", threshold=0.8)
    assert drop_summary(marked, ["q"]).first().asDict() == {"q": "q", "total": 5, "below_threshold": 3, "blank_text": 1, "kept": 1}


def test_exact_duplicates(spark):
    df = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, None), ("q", 4, None), ("r", 1, "a")], "q string, r int, t string")
    got = exact_duplicates(df, group=["q"], same=["t"], order=["r"]).filter("duplicate").collect()
    assert sorted((r.q, r.r) for r in got) == [("q", 2), ("q", 4)]


def test_near_duplicates_compare_with_accepted_only(spark):
    rng = random.Random(1)
    rows = [("chain", 1, "doc1", "h1"), ("chain", 2, "doc1", "h2"), ("chain", 3, "doc2", "h2")]
    rows += [(f"q{q}", r, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", "w", None])) for q in range(60) for r in range(rng.randrange(12))]
    want = []
    for q in {r[0] for r in rows}:
        accepted = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[1])[:8]:
            if not any((r[2] is not None and r[2] == a[2]) or (r[3] is not None and r[3] == a[3]) for a in accepted):
                accepted.append(r)
        want += [a[:2] for a in accepted]
    df = spark.createDataFrame(rows, "q string, r int, a string, b string")
    got = without_near_duplicates(df, group=["q"], rank="r", identities=["a", "b"], budget=8).collect()
    assert sorted((r.q, r.r) for r in got) == sorted(want) and ("chain", 3) in want


def test_merge(spark):
    p = ["H"]
    rows = [("q", 1, "d", p, 4, "x", 0.9), ("q", 2, "d", p, 5, "y", 0.5), ("q", 3, "e", p, 6, "z", 0.4), ("q", 4, "e", p, 5, "before", 0.3), ("r", 1, "d", None, 1, "n", 0.1), ("r", 2, "d", None, 2, "m", 0.2)]
    df = spark.createDataFrame(rows, "q string, r int, d string, p array<string>, i int, t string, s double")
    got = merged_neighbours(df, group=["q"], rank="r", document="d", path="p", index="i", text="t", score="s").collect()
    assert sorted((r.q, r.first_rank, r.merged, r.t, r.s) for r in got) == [("q", 1, 2, "x\n\ny", 0.9), ("q", 3, 1, "z", 0.4), ("q", 4, 1, "before", 0.3), ("r", 1, 2, "n\n\nm", 0.1)]


def test_rerank(spark):
    rows = [("q", 0, 0.1), ("q", 1, 0.9), ("q", 2, 0.5), ("q", 3, 1.0), ("q", 1, 0.2), ("q", 2, math.inf), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "q string, i int, s double")
    assert [(r.i, r["rank"]) for r in reranked(df, group="q", index="i", score="s", budget=3, top_k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    g = score_gaps(spark.createDataFrame([("full", 0), ("full", 1), ("gap", 0), ("gap", 2), ("twice", 0), ("twice", 0)], "q string, i int"), group="q", index="i").collect()
    assert {r.q: r.complete for r in g} == {"full": True, "gap": False, "twice": False}


def test_budget(spark):
    rows = [("q", 1, "one two three four"), ("q", 2, "  "), ("q", 3, " five  six seven"), ("q", 4, "eight"), ("r", 1, None)]
    c = budgeted(spark.createDataFrame(rows, "q string, r int, t string"), query="q", rank="r", text="t", budget=6)
    assert [(r.citation_id, r.t, r.tokens, r.truncated) for r in c.orderBy("r").collect()] == [("c1", "one two three four", 4, False), ("c3", " five  six", 2, True)]
    assert context_statistics(c, "q").first().asDict() == {"q": "q", "citations": 2, "used_tokens": 6, "truncated": True}


def test_prompts(spark):
    c = spark.createDataFrame([("q", 1, "c1", "doc", 3, ["A", "B"], "one two"), ("q", 3, "c3", "doc", None, None, "three")], "q string, rank int, citation_id string, document_id string, page int, header_path array<string>, text string")
    p = {r.q: r for r in prompts(c, spark.createDataFrame([("q", "Why?"), ("none", "How?")], "q string, question string"), query="q").collect()}
    assert p["q"].context_block == "Context:\none two\n\nthree\n\nCitations:\n[c1] doc page 3 A > B\n[c3] doc" and p["none"].context_block == ""
    assert p["q"].user_prompt == "Question: Why?" and p["q"].prompt_tokens == p["q"].system_tokens + p["q"].context_tokens + p["q"].user_tokens
    assert "markdown format" in p["q"].system_prompt
    line = spark.sql("select 'uSER' as r").select(history_line(F.col("r"), F.lit("hi")), citation_line(F.lit("c1"), F.lit("d"), F.lit(None).cast("int"), F.array().cast("array<string>"))).first()
    assert line[:] == ("User: hi", "[c1] d")


def test_routing(spark):
    rows = [("slow", 1, "low", "high", True, "a"), ("down", 0, "low", "low", False, "a"), ("fast", 1, "low", "low", True, "a"), ("none", None, "7", "x", True, "b"), ("dear", 1, "high", "low", True, "a")]
    df = spark.createDataFrame(rows, "name string, priority int, cost_tier string, latency_tier string, healthy boolean, security string")
    names = lambda **m: [r.name for r in routed(df, **m).orderBy("attempt").collect()]
    assert names() == ["fast", "slow", "dear", "none"] and names(preferred="none")[0] == "none" and names(security="b") == ["none"]


def test_index_operators(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert upsert_counts(old, new, id="id").first()[:] == (1, 1) and upsert_counts(upserted(old, new, id="id"), new, id="id").first()[:] == (0, 2)
    assert sorted(map(tuple, upserted(old, new, id="id").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.id for r in not_yet_indexed(new, old, fingerprint="id").collect()] == ["c"]
    points = spark.createDataFrame([("p", [1.0]), ("p", [1.0]), ("q", [1.0, 2.0])], "id string, v array<double>")
    assert sorted(map(tuple, invalid_points(points, id="id", vector="v", dimensions=1).collect())) == [("p", "duplicate_id"), ("q", "invalid_vector")]
    parts = lambda *r: spark.createDataFrame(r, "part string, content string")
    assert sorted(map(tuple, package_diff(parts(("a", "1"), ("b", "1"), ("c", None)), parts(("b", "2"), ("c", None), ("d", "1")), part="part", content="content").collect())) == [("a", "removed"), ("b", "changed"), ("d", "added")]


def test_index_of_vectors(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    vectors = np.concatenate([c + rng.normal(scale=0.1, size=(50, 8)) for c in centers])
    df = spark.createDataFrame([(f"v{i:04}", v.tolist(), "x") for i, v in enumerate(vectors)] + [(None, [1.0] * 8, "x"), ("null", None, "x")], "id string, v array<double>, cell string")
    queries = df.filter("id like '%0'")
    found = vector_index.centroids(df, vector="v", cells=12)
    index = vector_index.indexed(df, found, id="id", vector="v")
    assert index.count() == 600 and found.shape == (12, 8)
    ask = lambda **m: vector_index.nearest_by_index(index, found, queries, query_id="id", query_vector="v", k=10, **m)
    exact = nearest(df, queries, id="id", vector="v", query_id="id", query_vector="v", k=10)
    some, r = vector_index.recall(ask(probes=2), exact).first(), vector_index.recall(ask(probes=12), exact).first()
    assert some.queries == 60 and some.recall >= 0.9 and r.recall == 1.0
    assert sorted(map(tuple, ask(probes=99).collect())) == sorted(map(tuple, exact.collect()))
    assert vector_index.nearest_by_index(index, found, queries.limit(0), query_id="id", query_vector="v").count() == 0
    with pytest.raises(ValueError):
        vector_index.centroids(df.limit(0), vector="v")


def test_filters_all_hold_and_null_filters_nothing(spark):
    df = spark.createDataFrame([(i, [1.0, i * 0.1], i % 2, "ab"[i % 4 // 2]) for i in range(8)] + [(8, [1.0, 0.0], None, "a")], "id long, v array<double>, n int, s string")
    q = spark.createDataFrame([(100, [1.0, 0.0], 1, "a"), (101, [1.0, 0.0], None, "b"), (102, [1.0, 0.0], None, None), (103, [1.0, 0.0], 7, None)], "id long, v array<double>, n int, s string")
    got = {}
    for r in nearest(df, q, id="id", vector="v", query_id="id", query_vector="v", k=9, match=["n", "s"]).collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {100: [1, 5], 101: [2, 3, 6, 7], 102: list(range(9))}


def test_refinement_counts(spark):
    rows = [("q", 1, "a", "d", 0, "x", 0.9, "d"), ("q", 1, "a", "d", 0, "x", 0.9, "d"), ("q", 2, "b", "d", 1, "y", 0.8, None), ("q", 3, "a", "e", 7, "z", 0.7, "e"), ("q", 4, "c", "d", 5, " ", 0.6, "d"), ("q", 5, "e", "d", 6, "u", 0.1, "d"), ("q", 6, "f", "d", 9, "v", 0.6, "other"), ("n", 1, "g", "d", 0, None, None, None)]
    df = spark.createDataFrame(rows, "q string, rank int, id string, doc string, at int, text string, score double, has string").withColumn("path", F.array(F.lit("p")))
    kept, counts = refined(df, group="q", rank="rank", id="id", identities=["id"], document="doc", path="path", index="at", text="text", score="score", threshold=0.5, budget=20, payload={"doc": "has"})
    assert [(r.q, r.first_rank, r.merged, r.text, r.merged_ids) for r in kept.collect()] == [("q", 1, 2, "x\n\ny", ["a", "b"])]
    assert {r.q: tuple(r)[1:] for r in counts.collect()} == {"q": (8 - 1, 1, 1, 1, 1, 1, 1, 1), "n": (1, 0, 1, 0, 0, 0, 0, 0)}
