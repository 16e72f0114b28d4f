"""References to records that do not exist, were deleted, or came later.

References and the validity intervals of the records they name go into one stream, partitioned and
sorted alike. One linear pass over each key, a running maximum of the interval ends seen so far,
tells for every reference whether an interval was open at its time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirestone.operators.skew import HOT_ROWS, hot_keys
from quirestone.session import written

_NEVER = "9999-12-31 23:59:59.999999"


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    *,
    keys: Sequence[str],
    at: str,
    valid_from: str,
    valid_to: str | None = None,
    keep: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """References without a parent that is valid at their time.

    ``references`` has the columns ``keys``, ``at`` and ``keep``; ``parents`` has ``keys``,
    ``valid_from`` and, if records can be deleted, ``valid_to`` (null: not deleted). A parent is
    valid from ``valid_from`` on and until just before ``valid_to``.

    Returns ``keep`` and ``status``:

    * ``missing``: no parent has this key,
    * ``deleted``: parents began before the reference, all had ended by then,
    * ``late``: the first parent began after the reference,
    * ``undated``: parents exist, but the reference has no time.

    Repeated rows come back as often as they came in. A null in a key equals nothing, so that such
    a reference is ``missing``; parents with a null key or a null ``valid_from`` are never valid and
    don't count. Other columns of either side are ignored. Empty inputs are allowed.

    One shuffle of references and parents together. Parents are reduced before it: to the first one of a key
    where there are no ends, else to distinct intervals. A key that is too large for one task, by its
    references or its parents, is cut into ranges of time, which the merges of the ranges before pass their open
    intervals on to.
    """
    if "status" in keep:
        raise ValueError("keep may not have a column named status")
    ks = [f"__k{i}" for i in range(len(keys))]
    refs = references.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.col(at).cast("timestamp").alias("__at"), F.struct(*keep).alias("__row"))
    never = F.lit(_NEVER).cast("timestamp")
    begun = parents.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.col(valid_from).cast("timestamp").alias("__at"), (F.coalesce(F.col(valid_to).cast("timestamp"), never) if valid_to else never).alias("__until")).dropna(subset=[*ks, "__at"])
    if valid_to:
        spans = begun.groupBy(*ks, "__at").agg(F.max("__until").alias("__until"))
    else:
        spans = begun.groupBy(*ks).agg(F.min("__at").alias("__at")).withColumn("__until", never)
    unmatched = F.lit(False)
    for k in ks:
        unmatched = unmatched | F.col(k).isNull()
    stream = refs.filter(~unmatched).select(*ks, "__at", F.lit(1).alias("__kind"), F.lit(None).cast("timestamp").alias("__until"), "__row").unionByName(
        spans.select(*ks, "__at", F.lit(0).alias("__kind"), "__until", F.lit(None).cast(refs.schema["__row"].dataType).alias("__row"))
    )
    stream = written(stream, "references_and_parents")
    hot = written(hot_keys(stream, ks, hot_rows), "hot")
    found = _merged(stream.join(F.broadcast(hot), ks, "left_anti"), ks)
    if not hot.isEmpty():
        found = found.unionByName(_merged_in_ranges(stream.join(F.broadcast(hot), ks, "left_semi"), ks))
    return found.unionByName(refs.filter(unmatched).select("__row", F.lit("missing").alias("status"))).select("__row.*", "status")


def _merged(stream: DataFrame, ks: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """The merge: ``__row`` and ``status`` of the references that no interval is open for.

    ``before`` has, for each ``__range`` of each key, the last end of the intervals of earlier ranges and
    the begin of the key's first interval.
    """
    parts = [*ks, "__range"] if before is not None else ks
    merged = Window.partitionBy(*parts).orderBy("__at", "__kind")
    so_far = merged.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = merged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = stream.withColumn("__open", F.max("__until").over(so_far))
    if before is None:
        seen = seen.withColumn("__first", F.min(F.when(F.col("__kind") == 0, F.col("__at"))).over(whole))
    else:
        seen = seen.join(F.broadcast(before), parts).withColumn("__open", F.greatest("__open", "__carried"))
    status = (
        F.when(F.col("__first").isNull(), "missing")
        .when(F.col("__at").isNull(), "undated")
        .when(F.col("__first") > F.col("__at"), "late")
        .when(F.col("__open") <= F.col("__at"), "deleted")
    )
    return seen.filter("__kind = 1").select("__row", status.alias("status")).filter("status is not null")


def _merged_in_ranges(stream: DataFrame, ks: Sequence[str]) -> DataFrame:
    """The same for keys of any size: rows in ranges of key and time, equal times cut by a hash.

    Fewer keys than tasks are that large, and each range ends with one key, so what passes from range to range
    is as small as the number of both together.
    """
    ranges = stream.repartitionByRange(*ks, "__at", "__kind", F.xxhash64("__row")).withColumn("__range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    each = ranges.groupBy(*ks, "__range").agg(F.max("__until").alias("__last"), F.min(F.when(F.col("__kind") == 0, F.col("__at"))).alias("__begin"))
    of_key = Window.partitionBy(*ks)
    earlier = of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*ks, "__range", F.max("__last").over(earlier).alias("__carried"), F.min("__begin").over(of_key).alias("__first"))
    return _merged(ranges, ks, before)


def orphan_report(orphans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of distinct orphans for each combination of ``by``, as ``orphans``."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("orphans"))
