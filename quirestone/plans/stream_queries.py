"""Queries that run a stream over a given table until all of it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestone.functions.text import WS_CLASS
from quirestone.session import new_path
from quirestone.sources.tables import table
from quirestone.streaming.ingest import closing_row, counts_by_window, document_stream, first_deliveries, index_stream, observed_lateness, sessions


def _drained(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """What a stream appends until it has read all that is there; a batch that is repeated writes its own rows again."""
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
    index_stream(stream, write=write, checkpoint=f"{path}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _events(spark: SparkSession, folder: str, path: str) -> tuple[DataFrame, str]:
    """All events and a closing row as a stream, and how late events may be, as observed."""
    known = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = observed_lateness(spark, f"{folder}/events.parquet", "ts")
    closing = closing_row(spark, f"{path}/closing", table(spark, folder, "events").schema, at="ts")
    schema = table(spark, folder, "events").schema
    stream = document_stream(spark, f"{folder}/{{events.parquet}}", schema).unionByName(document_stream(spark, closing, schema))
    return stream.withColumn("ts", F.col("ts").cast(known.schema["ts"].dataType)), f"{late} seconds"


def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each hour by type, counted as a stream that gives out each window once."""
    path = new_path(spark)
    events, late = _events(spark, folder, path)
    counts = counts_by_window(events, at="ts", by=["event_type"], late=late)
    return _drained(spark, counts, path).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with at most 30 minutes between events, as a stream that gives out each session once."""
    path = new_path(spark)
    events, late = _events(spark, folder, path)
    found = _drained(spark, sessions(events, at="ts", user="user_id", late=late), path)
    return found.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def stream_first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct contents of all documents, in the order of a stream; copies may be any time apart, so every fingerprint is kept."""
    docs = document_stream(spark, f"{folder}/{{documents.parquet}}", table(spark, folder, "documents").schema).filter("text is not null")
    return _drained(spark, first_deliveries(docs, text="text", at="ingested_at", late="3650 days"), new_path(spark)).select("fingerprint")


QUERIES = {"stream_event_counts": stream_event_counts, "stream_sessions": stream_sessions, "stream_first_deliveries": stream_first_deliveries}
ORACLE_SQL = {
    "stream_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM b GROUP BY user_id, s""",
    "stream_first_deliveries": f"SELECT DISTINCT sha256(trim(regexp_replace(text, '{WS_CLASS}+', ' ', 'g'), ' ')) AS fingerprint FROM documents WHERE text IS NOT NULL",
}
