"""Incremental ingestion as a stream: documents are indexed once, telemetry is counted in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirestone.functions.text import content_hash


def document_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    """New Parquet files of ``folder`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_deliveries(stream: DataFrame, *, text: str, at: str, late: str = "7 days") -> DataFrame:
    """Documents whose content hasn't come before, as ``fingerprint`` beside their columns.

    State is kept for ``late``; a copy that comes later than that counts as new.
    """
    marked = stream.withColumn("fingerprint", content_hash(F.col(text)))
    return marked.withWatermark(at, late).dropDuplicatesWithinWatermark(["fingerprint"])


def counts_by_window(stream: DataFrame, *, at: str, by: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows in each time window for each combination of ``by``: ``window_start``, ``by``, ``n``."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, *, at: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user that end after ``gap`` without a row: ``user``, ``started``, ``ended``, ``n``."""
    grouped = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def observed_lateness(spark: SparkSession, folder: str, at: str) -> int:
    """Seconds by which rows of a file are older than the newest row of the files before it, at most.

    Files count in the order in which a stream reads them, by their time of modification. With this lateness a stream over the same files
    drops nothing. Only a row a file is sorted.
    """
    files = spark.read.parquet(folder).groupBy(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    before = F.max("last").over(Window.orderBy("t", "p").rowsBetween(Window.unboundedPreceding, -1))
    late = files.select((F.unix_timestamp(before) - F.unix_timestamp("first")).alias("s")).agg(F.max("s")).first()[0]
    return max(int(late or 0), 0)


def closing_row(spark: SparkSession, path: str, schema, *, at: str) -> str:
    """Write a file with one row, null but for a time after all others, and return its path.

    Read after the last file of a stream that has ended, it moves the watermark behind every window, so that append mode gives out the
    last ones as well. Its own window stays open.
    """
    row = spark.range(1).select(*[(F.to_timestamp(F.lit("9000-01-01")) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.parquet(path)
    return path


def index_stream(stream: DataFrame, *, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start a query that hands each batch of what is there to ``write``, once; it ends when all is read.

    ``write`` gets a batch and its number; a batch that is repeated after a failure has the same number.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
