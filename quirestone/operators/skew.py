"""Finding the few keys that hold very many rows, and spreading their rows over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key up to which its rows are never spread.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS, tasks: int | None = None) -> DataFrame:
    """The keys that are too large for one task, and the number of parts each is to be cut into.

    Columns: the keys and ``__parts``. A key is hot if it has more than ``rows`` rows and more than an
    even share, all rows over ``tasks`` (default: the session's shuffle partitions); each part is
    then as large as the larger of the two. As the shares of all keys add up to ``tasks``, fewer keys
    than ``tasks`` can be hot, so the result can always be broadcast. The counts are combined on the map
    side: a hot key reaches the shuffle as one row a task.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    share = F.greatest(F.lit(float(rows)), counted.agg(F.sum("__n").alias("__all")).scalar() / tasks)
    return counted.filter(F.col("__n") > rows).withColumn("__share", share).filter("__n > __share").select(*keys, F.ceil(F.col("__n") / F.col("__share")).cast("int").alias("__parts"))


def spread(df: DataFrame, hot: DataFrame, keys: Sequence[str], over: Sequence[str]) -> DataFrame:
    """Add ``__salt``: 0 for ordinary keys, for hot ones a part chosen by the hash of ``over``."""
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    return df.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.pmod(F.xxhash64(*over), parts).cast("int")).drop("__parts")


def repeat(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``__salt``: each row once for every part of its key."""
    last = F.coalesce(F.col("__parts"), F.lit(1)) - 1
    return df.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("__parts")


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], over: Sequence[str], how: str = "inner", rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Join on ``keys``; a key that very many rows of ``left`` have is spread by the columns ``over``.

    ``right`` should have few rows a key: those of a hot key go to each of its parts. ``how`` is
    ``inner``, ``left`` or ``left_semi``. The hot keys are counted in ``left``, unless they are given;
    so ``left`` should be cheap to read.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"can't spread a join of type {how}")
    hot = hot_keys(left, keys, rows) if hot is None else hot
    return spread(left, hot, keys, over).join(repeat(right, hot, keys), [*keys, "__salt"], how).drop("__salt")
