import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quirestone.operators.skew import hot_keys, join_spread
from quirestone.session import clear_written, shared_folder, written


def test_hot_keys_have_more_than_an_even_share(spark):
    df = spark.range(30_000).select((F.col("id") % 3000).alias("k")).unionByName(spark.range(500).select(F.lit(-1).cast("long").alias("k")))
    assert {(r.k, r["__parts"]) for r in hot_keys(df, ["k"], 100, tasks=1000).collect()} == {(-1, 5)}
    assert hot_keys(df, ["k"], 5, tasks=10).count() == 0  # 500 rows are less than a tenth
    assert {(r.k, r["__parts"]) for r in hot_keys(df, ["k"], 5, tasks=100).collect()} == {(-1, 2)}
    assert hot_keys(df.limit(0), ["k"]).count() == 0


def test_five_thousand_hot_keys(spark):
    rows = spark.range(40_000).select("id", (F.col("id") % 5000).alias("k"))
    hot = hot_keys(rows, ["k"], 2, tasks=20_000)
    assert hot.count() == 5000 and {r["__parts"] for r in hot.collect()} == {4}
    right = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = join_spread(rows, right, ["k"], ["id"], hot=hot)
    assert out.count() == 40_000 and out.filter("v <> 2 * k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_the_plain_one(spark, how):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d")], "k long, v string")
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(join_spread(left, right, ["k"], ["id"], how, rows=50)) == key(left.join(right, "k", how))


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        join_spread(spark.range(1), spark.range(1), ["id"], ["id"], "full")


def test_written_tables(spark):
    clear_written(spark)
    df = written(spark.range(5), "five")
    paths = [urlparse(f).path for f in df.inputFiles()]
    assert df.count() == 5 and all(p.startswith(urlparse(shared_folder(spark)).path + "/") and os.path.exists(p) for p in paths)
    assert clear_written(spark) == 1 and not any(map(os.path.exists, paths))
