import math
import random

import numpy as np
import pytest

from quirestone.llm import topn
from quirestone.llm.topn import score_code, top_n


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or not math.isfinite(s):
            continue
        best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    return sorted((g, i, s + 0.0) for g, d in best.items() for i, s in sorted(d.items(), key=lambda x: (-x[1], x[0] if isinstance(x[0], int) else x[0].encode()))[:n])


def run(spark, rows, n, kind):
    df = spark.createDataFrame(rows, f"q string, i {kind}, s double").selectExpr("*", "'x' as g0", "1 as item", "2 as score")
    return sorted((r.q, r.i, r.s + 0.0) for r in top_n(df, groups=["q"], score="s", item="i", n=n).collect())


def test_codes_keep_the_order():
    values = np.array([-math.inf, -5e300, -1.0, -1e-300, -0.0, 0.0, 1e-300, 0.5, 1.0, 5e300, math.inf])
    codes = score_code(values)
    assert (np.diff(codes.astype(object)) >= 0).all() and codes[4] == codes[5] and len(set(codes.tolist())) == 10


def test_against_sorting(spark, monkeypatch):
    rng = random.Random(1)
    scores = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -2.5] + [round(rng.random(), 1) for _ in range(8)]
    ids = ["", "a", "ab", "a\0", "é", "z" * 9, "z" * 8, "z" * 17, "Z"] + [f"item-{i}" for i in range(30)]
    rows = [(rng.choice(["g", "h", "i", None]), rng.choice([*ids, None]), rng.choice(scores)) for _ in range(1500)] + [("one", "x", 1.0)]
    for n in (1, 3, 50):
        assert run(spark, rows, n, "string") == brute(rows, n)
    numbers = [(g, None if i is None else hash(i) % 50 - 25, s) for g, i, s in rows]
    assert run(spark, numbers, 4, "int") == brute(numbers, 4)
    monkeypatch.setattr(topn, "BUFFER_ROWS", 7)
    assert run(spark, rows, 3, "string") == brute(rows, 3)


def test_hot_group_with_equal_scores(spark):
    rows = [("hot", i, 0.5) for i in range(20000)] + [(str(i), 1, 0.1) for i in range(50)]
    got = run(spark, rows, 5, "int")
    assert [r for r in got if r[0] == "hot"] == [("hot", i, 0.5) for i in range(5)] and len(got) == 55


def test_empty(spark):
    assert run(spark, [], 3, "int") == []


def test_numbers_with_fractions_and_other_types(spark):
    rows = [("g", 1.2, 1.0), ("g", 1.7, 1.0), ("g", -3.5, 1.0), ("g", 1.2, 0.5), ("h", 0.0, 2.0)]
    assert run(spark, rows, 2, "double") == [("g", -3.5, 1.0), ("g", 1.2, 1.0), ("h", 0.0, 2.0)]
    df = spark.createDataFrame([("g", "1", 1.0)], "q string, i string, s double").selectExpr("q", "cast(i as decimal(10,2)) as i", "s")
    with pytest.raises(ValueError):
        top_n(df, groups=["q"], score="s", item="i", n=1)


def test_one_very_long_identifier(spark):
    rows = [("g", "x" * 2_000_000, 1.0)] + [("g", f"i{n:05}", 1.0) for n in range(20_000)]
    assert [i[:6] for _, i, _ in run(spark, rows, 2, "string")] == ["i00000", "i00001"]
    assert [len(i) for _, i, _ in run(spark, [("g", "x" * 2_000_000, 2.0), *rows[1:]], 1, "string")] == [2_000_000]
