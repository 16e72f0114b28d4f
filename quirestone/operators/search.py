"""Exact vector search: the nearest rows of each query vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that go to all tasks at once; more queries take more passes over the rows.
QUERIES_A_PASS = 4096
_QUERIES_A_STEP = 256
METRICS = ("cosine", "dot", "euclid")


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Score of two vectors as a built-in expression; for ``euclid`` the distance."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """A row's score for each query, larger is better."""
    if metric == "cosine":
        norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return norm(queries) @ norm(rows).T
    if metric == "dot":
        return queries @ rows.T
    return -np.sqrt(np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * queries @ rows.T, 0))


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row, of equal ones the first, in any order; infinite ones are left out."""
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(np.isfinite(scores))
    least = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    more, equal = scores > least, scores == least
    room = k - more.sum(axis=1, keepdims=True)
    return np.nonzero((more | (equal & (np.cumsum(equal, axis=1) <= room))) & np.isfinite(scores))


class _Kept:
    """The ``k`` best rows of each query so far; of equal scores those with the smaller ids."""

    def __init__(self, k: int):
        self.k, self.ids = k, None
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        rows = pa.table([pa.array(self.query), pa.array(-self.score), self.ids], ["q", "s", "i"])
        order = pc.sort_indices(rows, [("q", "ascending"), ("s", "ascending"), ("i", "ascending")]).to_numpy()
        q = self.query[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.query, self.score, self.ids = self.query[order], self.score[order], self.ids.take(pa.array(order))

    def rows(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.query)), self.ids, pa.array(self.score)], ["query_id", "id", "score"])


def matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    """The vectors of a batch as a matrix."""
    return vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(rows, -1)


def _searched(shared, metric: str, k: int, threshold: float | None, match: Sequence[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        queries, wanted, probes = asked["vectors"], asked["filters"], asked.get("probes")
        kept = _Kept(k)
        for batch in batches:
            if not batch.num_rows or not len(queries):
                continue
            # rows by id, so that of equal scores the smaller id comes first
            batch = batch.take(pc.sort_indices(batch.column("id")))
            vectors = matrix(batch.column("vector"), batch.num_rows)
            codes = []
            for c in match:
                coded = batch.column(f"filter_{c}").dictionary_encode()
                place = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
                given = np.array([-2 if v is None else place.get(v, -1) for v in wanted[c]], np.int64)
                codes.append((given, pc.fill_null(coded.indices, -3).to_numpy(zero_copy_only=False)))
            if probes is None:
                meetings = [(np.arange(len(queries)), np.arange(batch.num_rows))]
            else:  # a row meets the queries that look into its cell
                cells = batch.column("cell").to_numpy()
                meetings = [(probes[c], np.flatnonzero(cells == c)) for c in np.unique(cells).tolist() if c in probes]
            found = []
            for who, rows in meetings:
                for at in range(0, len(who), _QUERIES_A_STEP):
                    some = who[at : at + _QUERIES_A_STEP]
                    scores = np.round(_scores(vectors[rows], queries[some], metric), 12)
                    for given, has in codes:
                        scores[(given[some, None] != -2) & (given[some, None] != has[None, rows])] = -np.inf
                    if threshold is not None:
                        scores[scores < threshold] = -np.inf
                    q, r = _best(scores, k)
                    found.append((some[q], scores[q, r], rows[r]))
            if found:
                query, score, row = (np.concatenate(x) for x in zip(*found))
                kept.add(query, score, batch.column("id").take(pa.array(row)))
        yield from kept.rows(asked["ids"])

    return search


def nearest(
    rows: DataFrame, queries: DataFrame, *, id: str, vector: str, query_id: str, query_vector: str, k: int = 20, metric: str = "cosine", threshold: float | None = None, match: str | Sequence[str] | None = None
) -> DataFrame:
    """The ``k`` rows with the best score for each query: ``query_id``, ``id``, ``score``, ``rank``.

    Every row is compared with every query, exactly. ``match`` are columns of both sides that must all be
    equal; where a query has null, its column doesn't matter. Rows whose score is below ``threshold`` are left out
    (cosine and dot). Scores are rounded to 12 decimals, so that equal vectors tie; of those the smaller id comes first. For ``euclid`` the score is the distance, and less is better.

    Queries are sent to the tasks in blocks of ``QUERIES_A_PASS``; each task multiplies its rows with the
    block and keeps ``k`` a query, so that only ``k`` rows a query and partition are shuffled. Ids are numbers or strings. Null ids
    and vectors are left out; all vectors need the same length.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    match = [match] if isinstance(match, str) else list(match or ())
    extra = [F.col(c).cast("string").alias(f"filter_{c}") for c in match]
    taken = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), *extra).dropna(subset=["id", "vector"])
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vector"), *extra).dropna(subset=["id", "vector"])
    return in_passes(taken, asked, k, metric, threshold if metric != "euclid" else None, match)


def in_passes(taken: DataFrame, asked: DataFrame, k: int, metric: str, threshold: float | None = None, match: Sequence[str] = ()) -> DataFrame:
    """The search of ``nearest`` on its own columns; with ``cells`` in ``asked``, only rows whose ``cell`` is among them are compared."""
    spark, probing = taken.sparkSession, "cells" in asked.columns
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("id", taken.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    passes = max(1, -(-asked.count() // QUERIES_A_PASS))
    found = None
    for i in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).toArrow()
        if not block.num_rows and found is not None:
            continue
        vectors = block.column("vector").to_pylist()
        message = {
            "ids": block.column("id").combine_chunks(),
            "vectors": np.array(vectors, np.float64).reshape(len(vectors), len(vectors[0]) if vectors else 0),
            "filters": {c: block.column(f"filter_{c}").to_pylist() for c in match},
        }
        some = taken
        if probing:
            by_cell: dict[int, list[int]] = {}
            for q, cells in enumerate(block.column("cells").to_pylist()):
                for c in cells:
                    by_cell.setdefault(c, []).append(q)
            message["probes"] = {c: np.array(q) for c, q in by_cell.items()}
            some = taken.filter(F.col("cell").isin(sorted(by_cell)))  # the other cells aren't read
        one = some.mapInArrow(_searched(spark.sparkContext.broadcast(message), metric, k, threshold, match), schema)
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id"), "id", (-F.col("score") if metric == "euclid" else F.col("score")).alias("score"), "rank")
