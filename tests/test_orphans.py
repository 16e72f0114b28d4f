import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirestone.operators.orphans import orphan_references, orphan_report

REFS = "k string, at timestamp, owner string, extra string"
PARENTS = "k string, f timestamp, u timestamp, owner string"


def day(n):
    return datetime(2024, 1, n)


def run(spark, refs, parents, **more):
    found = orphan_references(
        spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), keys=["k"], at="at", valid_from="f", valid_to="u", keep=["owner"], **more
    )
    return sorted((r.owner, r.status) for r in found.collect())


def test_each_status(spark):
    refs = [("a", day(5), "open", None), ("a", day(1), "late", None), ("b", day(5), "deleted", None), ("c", day(5), "missing", "x"), ("b", day(3), "at-end", None), ("a", day(2), "at-start", None)]
    parents = [("a", day(2), None, "p"), ("b", day(1), day(3), "p")]
    assert run(spark, refs, parents) == [("at-end", "deleted"), ("deleted", "deleted"), ("late", "late"), ("missing", "missing")]


def test_gap_between_two_lives_of_a_record(spark):
    parents = [("a", day(1), day(3), "p"), ("a", day(7), day(9), "p")]
    refs = [("a", day(n), str(n), None) for n in range(1, 11)]
    assert run(spark, refs, parents) == [("10", "deleted"), ("3", "deleted"), ("4", "deleted"), ("5", "deleted"), ("6", "deleted"), ("9", "deleted")]


def test_a_long_life_outlasts_a_later_short_one(spark):
    parents = [("a", day(1), day(20), "p"), ("a", day(2), day(3), "p")]
    assert run(spark, [("a", day(10), "x", None)], parents) == []


def test_nulls_repeats_and_empty_tables(spark):
    refs = [(None, day(5), "null-key", None), ("a", None, "no-time", None), ("a", day(5), "x", None), ("a", day(5), "x", None), ("b", None, "none", None)]
    parents = [(None, day(1), None, None), ("a", day(6), None, None), ("a", None, None, None)]
    assert run(spark, refs, parents) == [("no-time", "undated"), ("none", "missing"), ("null-key", "missing"), ("x", "late"), ("x", "late")]
    assert run(spark, [], parents) == []
    assert run(spark, [("a", day(1), "x", None)], []) == [("x", "missing")]


def test_hot_key_gives_the_same(spark):
    refs = [("hot", day(1 + i % 20), str(i), None) for i in range(400)] + [("cold", day(3), "c", None)]
    parents = [("hot", day(4), day(9), "p"), ("hot", day(12), None, "p")]
    plain = run(spark, refs, parents)
    assert run(spark, refs, parents, hot_rows=10) == plain
    assert len([o for o, s in plain if s == "late"]) == 60


def test_hot_parents_against_brute_force(spark):
    rng = random.Random(4)
    lives = lambda k, n: [(k, day(1) + timedelta(minutes=rng.randrange(20000)), None, "p") for _ in range(n)]
    parents = [(k, f, f + timedelta(minutes=rng.randrange(1, 90)) if rng.random() < 0.99 else f + timedelta(days=2), p) for k, f, _, p in lives("a", 900) + lives("b", 700) + lives("c", 3)]
    refs = [(rng.choice("aabc"), day(1) + timedelta(minutes=rng.randrange(-50, 21000)), str(i), None) for i in range(900)]
    refs += [("a", day(3), f"same{i}", None) for i in range(300)] + [("b", None, "none", None)]
    want = []
    for k, at, owner, _ in refs:
        mine = [(f, u) for p, f, u, _ in parents if p == k]
        if at is None:
            want.append((owner, "undated"))
        elif min(f for f, _ in mine) > at:
            want.append((owner, "late"))
        elif not any(f <= at < u for f, u in mine):
            want.append((owner, "deleted"))
    assert run(spark, refs, parents) == sorted(want)
    assert run(spark, refs, parents, hot_rows=50) == sorted(want)


def test_a_parent_of_a_million_intervals(spark):
    at = F.timestamp_seconds(F.col("id") * 10)
    parents = spark.range(1_000_000).select(F.lit("a").alias("k"), at.alias("f"), F.timestamp_seconds(F.col("id") * 10 + 5).alias("u"))
    refs = spark.range(1000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 9973 + 4).alias("at"), "id")
    found = orphan_references(refs, parents, keys=["k"], at="at", valid_from="f", valid_to="u", keep=["id"])
    assert sorted(r.id for r in found.collect()) == [i for i in range(1000) if (i * 9973 + 4) % 10 >= 5]
    assert orphan_references(refs, parents, keys=["k"], at="at", valid_from="f", keep=["id"]).count() == 0


def test_status_column_clash_is_refused(spark):
    with pytest.raises(ValueError):
        orphan_references(spark.createDataFrame([], "k string, at timestamp, status string"), spark.createDataFrame([], PARENTS), keys=["k"], at="at", valid_from="f", keep=["status"])


def test_report(spark):
    rows = spark.createDataFrame([("t", "2024-01", "late"), ("t", "2024-01", "late"), ("t", "2024-02", "late")], "f string, period string, status string")
    assert sorted(map(tuple, orphan_report(rows, ["f", "period"]).collect())) == [("t", "2024-01", 2), ("t", "2024-02", 1)]
