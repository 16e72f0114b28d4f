import random

import numpy as np

from quirestone.llm import leaks
from quirestone.llm.leaks import FMIndex, leaked_spans, suffix_order


def test_suffix_order():
    rng = random.Random(2)
    for n in (1, 2, 50, 400):
        codes = np.array([rng.randrange(4) for _ in range(n - 1)] + [0])
        assert suffix_order(codes).tolist() == sorted(range(n), key=lambda i: codes[i:].tolist())
    assert suffix_order(np.array([1] * 200 + [0])).tolist() == list(range(200, -1, -1))


def test_index_finds_every_occurrence():
    rng = random.Random(4)
    codes = np.array([rng.randrange(5) for _ in range(3000)] + [0])
    phrases = np.array([[rng.randrange(1, 7) for _ in range(4)] for _ in range(300)])
    which, at = FMIndex(codes).search(phrases)
    want = [(p, i) for p in range(len(phrases)) for i in range(len(codes) - 3) if (codes[i : i + 4] == phrases[p]).all()]
    assert sorted(zip(which.tolist(), at.tolist())) == want


def found(spark, docs, items, k=4):
    d = spark.createDataFrame(docs, "id long, text string, key string, item_ids string")
    i = spark.createDataFrame(items, "item long, text string, key int")
    rows = leaked_spans(d, i, key="id", text="text", item_key="item", item_text="text", k=k).collect()
    return sorted((r.id, r.start_word, r.end_word, tuple(r.item_ids)) for r in rows)


def brute(docs, items, k):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for i, s, *_ in items:
            v = words(s)
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            if any(tuple(w[j : j + k]) in grams for j in range(len(w) - k + 1)):
                out.add((d, i))
    return out


def test_spans(spark):
    docs = [(1, "x A b, c D e f y a b c d", "z", None), (2, None, None, None), (3, "", None, None), (4, "a b c", None, None), (5, "a b c. D", None, None)]
    items = [(10, "a b c d e f", 1), (11, "c d e f", 1), (12, "a b", 1), (13, None, 1), (14, "", 1)]
    assert found(spark, docs, items) == [(1, 1, 7, (10, 11)), (1, 8, 12, (10,)), (5, 0, 4, (10,))]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "é", "я", "7", "ж2"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 30, 300])), None, None) for i in range(60)]
    items = [(i, text(rng.choice([2, 6, 12])), 1) for i in range(40)] + [(0, text(8), 1)]
    want = brute(docs, items, 5)
    assert want
    for shard, a_pass in ((10**9, 10**9), (500, 15)):
        monkeypatch.setattr(leaks, "SHARD_CHARS", shard)
        monkeypatch.setattr(leaks, "ITEMS_A_PASS", a_pass)
        assert {(d, i) for d, _, _, ids in found(spark, docs, items, 5) for i in ids} == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c d", 1)]) == [] and found(spark, [(1, "a b c d", None, None)], []) == []


def test_boilerplate_of_many_items_at_many_places(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_A_STEP", 64)
    rng = random.Random(6)
    common = "terms and conditions apply to all of the offers"
    docs = [(d, " ".join(f"{rng.choice('abc')}{i} {common}" if rng.random() < 0.7 else f"w{rng.randrange(9)}" for i in range(rng.randrange(40))), "", "") for d in range(25)]
    items = [(n, f"item {n} {common} end", 0) for n in range(50)] + [(n, " ".join(docs[n % 25][1].split()[3:11]) or "x", 0) for n in range(50, 60)]
    got = found(spark, docs, items)
    assert {(d, i) for d, *_, ids in got for i in ids} == brute(docs, items, 4)
    spans = sorted((d, a, b) for d, a, b, _ in got)
    assert all(d != e or b < x for (d, _, b), (e, x, _) in zip(spans, spans[1:]))
