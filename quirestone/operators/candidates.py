"""Candidates of retrieval: thresholds, duplicates, merging of neighbours, reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestone.functions.text import is_blank
from quirestone.session import written


def drop_reasons(candidates: DataFrame, *, score: str, text: str, threshold: float) -> DataFrame:
    """Add ``drop_reason``: ``below_threshold`` (also for null and NaN), ``blank_text``, or null."""
    low = F.col(score).isNull() | F.isnan(score) | (F.col(score) < threshold)
    return candidates.withColumn("drop_reason", F.when(low, "below_threshold").when(is_blank(F.col(text)), "blank_text"))


def contradictory(candidates: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Candidates of which a column says otherwise than the payload's: ``pairs`` of columns, the payload's nulls agree."""
    wrong = F.lit(False)
    for column, of_payload in pairs.items():
        wrong = wrong | (F.col(of_payload).isNotNull() & ~F.col(of_payload).eqNullSafe(F.col(column)))
    return candidates.filter(wrong)


def drop_summary(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Counts of ``drop_reasons`` for each group: ``total``, ``below_threshold``, ``blank_text``, ``kept``."""
    return candidates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(F.col("drop_reason") == r, F.lit(False))).alias(r) for r in ("below_threshold", "blank_text")],
        F.count_if(F.col("drop_reason").isNull()).alias("kept"),
    )


def exact_duplicates(candidates: DataFrame, *, group: list[str], same: list[str], order: list[str]) -> DataFrame:
    """Add ``duplicate``: true for all but the first, by ``order``, of the rows of a group that agree in ``same``."""
    first = Window.partitionBy(*group, *same).orderBy(*order)
    return candidates.withColumn("duplicate", F.row_number().over(first) > 1)


def without_near_duplicates(candidates: DataFrame, *, group: list[str], rank: str, identities: list[str], budget: int) -> DataFrame:
    """Accepted candidates of each group, in rank order.

    A candidate is dropped if one that was accepted before it has the same value in any of ``identities``
    (null equals nothing). The first ``budget`` of a group take part, so the arrays that are folded are
    bounded; further ones aren't candidates of the query.
    """
    ranked = candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(rank, *identities))).filter(F.col("__r") <= budget)
    row = F.struct("__r", *[F.col(c).cast("string").alias(c) for c in identities])
    folded = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("__rows"))

    def same(a: Column, x: Column) -> Column:
        hit = F.lit(False)
        for c in identities:
            hit = hit | F.coalesce(a[c] == x[c], F.lit(False))
        return hit

    none = F.filter("__rows", lambda x: F.lit(False))
    kept = F.aggregate("__rows", none, lambda acc, x: F.when(F.exists(acc, lambda a: same(a, x)), acc).otherwise(F.array_append(acc, x)))
    places = folded.select(*group, F.explode(F.transform(kept, lambda x: x["__r"])).alias("__r"))
    return ranked.join(places, [*group, "__r"]).drop("__r")


def merged_neighbours(candidates: DataFrame, *, group: list[str], rank: str, document: str, path: str, index: str, text: str, score: str, id: str | None = None) -> DataFrame:
    """Candidates that follow each other in rank and in their document become one.

    Same document and path, and the index goes on by one. Returns the group, ``first_rank``, document,
    path, ``first_index``, ``last_index``, ``merged`` (how many), the text joined by blank lines, the first's score, and with ``id`` ``merged_ids``.
    """
    order = Window.partitionBy(*group).orderBy(rank, index)
    goes_on = (
        F.lag(document).over(order).eqNullSafe(F.col(document)) & F.lag(path).over(order).eqNullSafe(F.col(path)) & (F.col(index) == F.lag(index).over(order) + 1)
    )
    island = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = candidates.withColumn("__island", island)
    part = F.struct(F.col(rank).alias("r"), F.col(index).alias("i"), F.col(text).alias("t"))
    ids = [F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(index).alias("i"), F.col(c).alias("id")))), lambda p: p["id"]).alias("merged_ids") for c in ([id] if id else [])]
    return rows.groupBy(*group, "__island").agg(
        F.min(rank).alias("first_rank"),
        F.first(document).alias(document),
        F.first(path).alias(path),
        F.min(index).alias("first_index"),
        F.max(index).alias("last_index"),
        F.count(F.lit(1)).alias("merged"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias(text),
        F.min_by(score, F.struct(rank, index)).alias(score),
        *ids,
    ).drop("__island")


def refined(
    candidates: DataFrame, *, group: str, rank: str, id: str, identities: list[str], document: str, path: str, index: str, text: str, score: str, threshold: float, budget: int, payload: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """What is left of the candidates of each query, and a row of counters on how that came.

    In this order are left out those that contradict their ``payload`` (pairs of columns), are below the threshold, are blank, come again
    in every column, or are like an accepted one by ``identities``; then neighbours are merged. The first ``budget`` distinct
    ones of a query take part. Counters: ``total``, ``invalid_metadata``, ``below_threshold``, ``blank_text``, ``exact_duplicates``, ``near_duplicates``,
    ``adjacent_merges``, ``kept``.
    """
    wrong = F.lit(False)
    for column, of_payload in (payload or {}).items():
        wrong = wrong | (F.col(of_payload).isNotNull() & ~F.col(of_payload).eqNullSafe(F.col(column)))
    marked = drop_reasons(candidates, score=score, text=text, threshold=threshold).withColumn("drop_reason", F.when(wrong, "invalid_metadata").otherwise(F.col("drop_reason")))
    same = [c for c in candidates.columns if c != group]
    twice = F.row_number().over(Window.partitionBy(group, "drop_reason", *same).orderBy(rank)) > 1
    marked = written(marked.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & twice, "exact_duplicates").otherwise(F.col("drop_reason"))), "marked")
    distinct = marked.filter("drop_reason is null").drop("drop_reason")
    accepted = written(without_near_duplicates(distinct, group=[group], rank=rank, identities=identities, budget=budget), "accepted")
    merged = written(merged_neighbours(accepted, group=[group], rank=rank, document=document, path=path, index=index, text=text, score=score, id=id), "merged")
    reasons = ("invalid_metadata", "below_threshold", "blank_text", "exact_duplicates")
    first = marked.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(F.col("drop_reason") == r, F.lit(False))).alias(r) for r in reasons], F.least(F.lit(budget), F.count_if(F.col("drop_reason").isNull())).alias("__before"))
    second = merged.groupBy(group).agg(F.sum("merged").alias("__accepted"), F.count(F.lit(1)).alias("kept"))
    joined = first.join(second, group, "left").na.fill(0, ["__accepted", "kept"])
    counters = joined.select(group, "total", *reasons, (F.col("__before") - F.col("__accepted")).alias("near_duplicates"), (F.col("__accepted") - F.col("kept")).alias("adjacent_merges"), "kept")
    return merged, counters


def reranked(candidates: DataFrame, *, group: str, index: str, score: str, budget: int, top_k: int, place: str = "rank") -> DataFrame:
    """The ``top_k`` best of the first ``budget`` candidates of each query, by score, then index, as ``place``.

    A candidate that was scored more than once has its highest score; those without a finite score are left out.
    """
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    scored = candidates.filter(finite & F.col(group).isNotNull() & (F.col(index) < budget)).groupBy(group, index).agg(F.max(score).alias(score))
    order = Window.partitionBy(group).orderBy(F.desc(score), index)
    return scored.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= top_k)


class Reranker(Protocol):
    """What a reranking service must offer; it is created in each task."""

    def rerank(self, question: str, texts: list[str]) -> list[float]: ...


def scored_by(candidates: DataFrame, questions: DataFrame, *, group: str, index: str, text: str, budget: int, provider: Callable[[], Reranker]) -> DataFrame:
    """``group``, ``index`` and ``score`` by a provider, which sees the first ``budget`` candidates of a query at once.

    ``questions`` has ``group`` and ``question``. A provider that doesn't score each of them with a finite number is refused.
    """
    kind = questions.schema[group].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = provider()
        for batch in batches:
            scores = [[float(x) for x in service.rerank(q, t)] for q, t in zip(batch.column("question").to_pylist(), batch.column("texts").to_pylist())]
            for s, t in zip(scores, batch.column("texts").to_pylist()):
                if len(s) != len(t) or not all(map(math.isfinite, s)):
                    raise ValueError("the reranking provider must score every candidate")
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("places"), pa.array(scores, pa.list_(pa.float64()))], ["query", "places", "scores"])

    # of a query no more than its budget
    pool = candidates.filter(F.col(index) <= budget).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), F.col(text).alias("t")))).alias("__c"))
    asked = questions.join(pool, group).select(F.col(group).alias("query"), "question", F.transform("__c", lambda c: c["i"]).alias("places"), F.transform("__c", lambda c: c["t"]).alias("texts"))
    schema = T.StructType([T.StructField("query", kind), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    zipped = asked.mapInArrow(run, schema).select(F.col("query").alias(group), F.explode(F.arrays_zip("places", "scores")).alias("x"))
    return zipped.select(group, F.col("x.places").alias(index), F.col("x.scores").alias("score"))


def score_gaps(candidates: DataFrame, *, group: str, index: str) -> DataFrame:
    """Whether the scored candidates of a query are 0..n-1, each once: ``scored``, ``distinct``, ``highest``, ``complete``."""
    counted = candidates.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("scored"), F.count_distinct(index).alias("distinct"), F.min(index).alias("lowest"), F.max(index).alias("highest")
    )
    return counted.withColumn("complete", (F.col("scored") == F.col("distinct")) & (F.col("lowest") == 0) & (F.col("highest") == F.col("scored") - 1))
