"""Embedding with any provider, each distinct text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirestone.functions.text import content_hash, normalize_ws


class EmbeddingProvider(Protocol):
    """What an embedding service must offer; it is created in each task."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def mock_embedding(text: Column, dimensions: int) -> Column:
    """A deterministic vector: bytes of sha256("text:counter") over 255, as many blocks as needed."""
    # a lambda's variable is computed once, where an expression in its place would be for every byte
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    digits = lambda norm: F.concat(*[F.sha2(F.concat(norm, F.lit(f":{i}")), 256) for i in range(-(-dimensions // 32))])
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    byte = lambda hexed, i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0
    return let(let(normalize_ws(text), digits), lambda hexed: F.when(hexed.isNotNull(), F.transform(places, lambda i: byte(hexed, i))))


def is_valid_vector(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def _provided(provider: Callable[[], EmbeddingProvider], batch_size: int, isolate: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = provider()

        def vectors_of(texts: list[str]) -> list:
            vectors = service.embed(texts)
            if len(vectors) != len(texts) or any(len(v) != service.dimensions or not np.isfinite(v).all() for v in vectors):
                raise ValueError("the embedding provider returned invalid vectors")
            return vectors

        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = part.column("text").to_pylist()
                try:
                    vectors, errors = vectors_of(texts), [None] * len(texts)
                except Exception:  # whatever a service raises
                    if not isolate:
                        raise
                    vectors, errors = [], []
                    for text in texts:  # to tell the texts that it fails on from the others
                        try:
                            vectors += vectors_of([text])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], ["hash", "vector", "error"])

    return run


def embedded(texts: DataFrame, *, text: str, provider: Callable[[], EmbeddingProvider], cache: DataFrame | None = None, batch_size: int = 64, isolate: bool = False) -> DataFrame:
    """``texts`` with ``hash``, ``vector`` and ``cache_hit``.

    A text is known by the hash of its normalized form. Those in ``cache`` (``hash``, ``vector``) aren't
    embedded again; of the others, each is embedded once, however often it comes. A provider that fails stops the
    job, unless ``isolate``: then the texts of that batch are tried one by one, and those that it fails on have a null vector and
    ``error``, a further column.
    """
    hashed = texts.withColumn("hash", content_hash(F.col(text)))
    wanted = hashed.filter("hash is not null").groupBy("hash").agg(F.min(text).alias("text"))
    if cache is not None:
        wanted = wanted.join(cache.select("hash"), "hash", "left_anti")
    columns = ["hash", "vector", *["error"] * isolate]
    new = wanted.select("hash", "text").mapInArrow(_provided(provider, batch_size, isolate), "hash string, vector array<double>, error string").select(*columns, F.lit(False).alias("cache_hit"))
    known = new if cache is None else new.unionByName(cache.select("hash", "vector", F.lit(True).alias("cache_hit")), allowMissingColumns=True)
    return hashed.join(known, "hash", "left")
