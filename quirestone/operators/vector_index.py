"""Approximate vector search: every row lies in the cell of its nearest centroid, and a query looks into the nearest cells only.

The centroids are fitted on a bounded sample; all rows are indexed. ``search.nearest`` stays the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestone.operators.search import in_passes, matrix
from quirestone.session import written

#: Rows that centroids are fitted on at most, and most cells.
SAMPLE_ROWS, MOST_CELLS = 50_000, 4096


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centroids(rows: DataFrame, *, vector: str, cells: int | None = None, seed: int = 1) -> np.ndarray:
    """Directions of cells, by default as many as the root of the number of rows and at most ``MOST_CELLS``, by k-means on a sample of ``SAMPLE_ROWS``."""
    full = rows.filter(F.col(vector).isNotNull())
    n = full.count()
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sample = full.sample(min(1.0, 1.1 * SAMPLE_ROWS / max(n, 1)), seed).limit(SAMPLE_ROWS).select(F.col(vector).cast("array<double>").alias("v"))
    features = written(sample.select(F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-300))).alias("v")), "sample").select(array_to_vector("v").alias("features"))
    if features.isEmpty():
        raise ValueError("no vectors to fit an index on")
    return _unit(np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(features).clusterCenters()))


def _nearest_cells(df: DataFrame, columns: list[str], centers: np.ndarray, probes: int) -> DataFrame:
    """``columns`` (an id and ``vector`` among them) and ``cells``, the nearest ones first."""
    shared = df.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = -(_unit(matrix(batch.column("vector"), batch.num_rows)) @ shared.value.T)
                cells = np.argsort(near, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    taken = df.select(*columns)
    return taken.mapInArrow(place, T.StructType([*taken.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def indexed(rows: DataFrame, centers: np.ndarray, *, id: str, vector: str) -> DataFrame:
    """Every row with an id and a vector as ``id``, ``vector`` and ``cell``, stored by cell; a large cell is several files."""
    taken = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).dropna()
    placed = _nearest_cells(taken, ["id", "vector"], centers, 1).select("id", "vector", F.col("cells")[0].alias("cell"))
    return written(placed.hint("rebalance", "cell"), "vectors", partition_by="cell")


def nearest_by_index(index: DataFrame, centers: np.ndarray, queries: DataFrame, *, query_id: str, query_vector: str, k: int = 20, probes: int = 16) -> DataFrame:
    """About the ``k`` rows with the largest cosine for each query: ``query_id``, ``id``, ``score``, ``rank``.

    Scores are exact; a row in none of the ``probes`` nearest cells of a query isn't found. With as many probes as cells the
    result is that of ``search.nearest``. Null ids and vectors are left out.
    """
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vector")).dropna()
    return in_passes(index, _nearest_cells(asked, ["id", "vector"], centers, min(probes, len(centers))), k, "cosine")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``queries``, and ``recall``, the share of the exact results that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("recall"))
