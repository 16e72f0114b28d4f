"""Session settings, and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quirestone", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the operators assume: UTC, AQE, Arrow.

    On a cluster, create the session with the cluster's own master and memory and call
    ``configure`` on it instead.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.driver.memory", os.environ.get("QUIRESTONE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options that results depend on; returns the session."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where neither that setting nor a checkpoint folder exists, as in tests on one machine, a
    temporary folder is made and set; on a cluster that is refused, as each executor would have its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quirestone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: list[str] = []
_TABLES: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses, until ``clear_written``."""
    path = f"{shared_folder(spark)}/quirestone-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor. Each call writes to a path of its own,
    which stays until ``clear_written`` is called, as results that aren't computed yet may read it.
    """
    spark = df.sparkSession
    path = f"{new_path(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Like ``written``, the rows in ``buckets`` by the hash of ``by``: grouping or joining on it needs no shuffle afterwards.

    The catalog of the session knows the table, as Spark keeps buckets there only.
    """
    spark = df.sparkSession
    path = f"{new_path(spark)}/{name}"
    table = f"{name}_{path.split('/')[-2].split('-')[-1]}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    _TABLES.append(table)
    return spark.table(table)


def clear_written(spark: SparkSession) -> int:
    """Delete all tables that ``written`` and ``bucketed`` have made; DataFrames made from them can't be computed any more.

    Returns the number of tables.
    """
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done
