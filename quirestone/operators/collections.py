"""Collections of points as partitioned tables: a contract that every write has to keep, and upserts that write the parts they touch."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.operators.index import invalid_points, upsert_counts, upserted
from quirestone.session import written

DISTANCES = ("cosine", "euclid", "dot")
#: Parts of a collection, by the hash of the id; an upsert writes those again that it has points of.
PARTS = 64


@dataclass(frozen=True)
class Collection:
    """What a collection of points is made for; every write has to agree with it."""

    name: str
    dimensions: int
    model: str
    distance: str = "cosine"
    schema_version: str = "1"

    def __post_init__(self) -> None:
        if not self.name.strip() or self.dimensions <= 0 or self.distance not in DISTANCES:
            raise ValueError("a collection needs a name, positive dimensions and a known distance")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def contract(spark: SparkSession, folder: str) -> dict | None:
    """What the collection in ``folder`` was made for; None if there is none."""
    made = _read(spark, f"{folder}/contract")
    return None if made is None else made.first().asDict()


def ensure(spark: SparkSession, folder: str, wanted: Collection, *, recreate: bool = False) -> None:
    """Make a collection, or check that it was made for the same; with ``recreate`` begin it anew."""
    made = contract(spark, folder)
    if made is None or recreate:
        if made is not None and (old := points_of(spark, folder)) is not None:
            old.limit(0).write.mode("overwrite").parquet(f"{folder}/points")
        spark.createDataFrame([asdict(wanted)]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/contract")
    elif made != asdict(wanted):
        differs = [k for k, v in asdict(wanted).items() if made[k] != v]
        raise ValueError(f"the collection in {folder} was made with another {', '.join(differs)}")


def points_of(spark: SparkSession, folder: str) -> DataFrame | None:
    """The points of a collection; None if it has none yet."""
    if contract(spark, folder) is None:
        raise ValueError(f"no collection in {folder}")
    points = _read(spark, f"{folder}/points")
    return points if points is None or "part" not in points.columns else points.drop("part")


def upsert(spark: SparkSession, folder: str, points: DataFrame, *, id: str = "point_id", vector: str = "vector", attempts: int = 3) -> dict[str, int]:
    """Write points over those with the same id; returns ``inserted`` and ``updated``.

    Refused as a whole if an id comes twice or a vector doesn't fit. The points are computed once; of the collection, the
    parts that they fall into are read and written; a write that fails is tried ``attempts`` times in all. One writer at a time.
    """
    made = contract(spark, folder)
    if made is None:
        raise ValueError(f"no collection in {folder}")
    part = F.pmod(F.xxhash64(id), F.lit(PARTS)).cast("int").alias("part")
    new = written(points.select("*", part), "upserted")
    if wrong := invalid_points(new, id=id, vector=vector, dimensions=made["dimensions"]).limit(3).collect():
        raise ValueError(f"invalid points, such as {[tuple(r) for r in wrong]}")
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most PARTS
    before = _read(spark, f"{folder}/points")
    whole, counts = new, {"inserted": new.count(), "updated": 0}
    if before is not None and "part" in before.columns:
        old = before.filter(F.col("part").isin(touched)).select(new.columns)
        counts = upsert_counts(old, new, id=id).first().asDict()
        whole = written(upserted(old, new, id=id), "parts")
    for attempt in range(1, attempts + 1):
        try:
            whole.repartition("part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/points")
            break
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(0.1 * attempt)
    return counts


def run_statistics(discovered: DataFrame, indexed: DataFrame, points: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row on an indexing run: documents discovered, indexed, skipped and failed, chunks, distinct embedded texts.

    ``discovered``, ``indexed`` and ``errors`` have ``doc_id``, ``points`` has ``content_hash``.
    """
    one = lambda df, *c: df.agg(*c)
    found = one(discovered, F.count_distinct("doc_id").alias("discovered"))
    done = one(indexed, F.count_distinct("doc_id").alias("indexed"))
    made = one(points, F.count(F.lit(1)).alias("chunks"), F.count_distinct("content_hash").alias("embedded_texts"))
    failed = one(errors, F.count_distinct("doc_id").alias("failed")) if errors is not None else found.select(F.lit(0).cast("long").alias("failed"))
    # four tables of one row each
    joined = found.crossJoin(done).crossJoin(made).crossJoin(failed)
    return joined.withColumn("skipped", F.col("discovered") - F.col("indexed") - F.col("failed"))
