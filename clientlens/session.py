"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even when that costs the following aggregate one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffled data of one task: with sorts and hash maps its rows take some twenty times that in memory
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
}
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of stored input per initial shuffle partition; Spark merges those that turn out small.
INPUT_PER_PARTITION = 4 << 20
#: Whether a query's shuffle files go when it ends, instead of with the driver's garbage, which may take half an hour.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Apply the runtime settings the plans are written for.

    ``folder`` holds the input tables: the number of shuffle partitions before merging grows with their size, so that a task's
    memory does not. It is never less than ``spark.sql.shuffle.partitions``.
    """
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    if folder is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(INITIAL_PARTITIONS, max(least, stored_bytes(spark, folder) // INPUT_PER_PARTITION))
    return spark


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Size of everything below a folder of any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or else below the warehouse; all executors share both.

    Nothing below it is read again by a later session; its owner may empty it between sessions.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile leave no shuffle files, so that disk holds those of one step at a time."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared scratch folder: for results several branches read.

    The table outlives lost executors, and no branch repeats the work behind it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def forget(*stored: DataFrame) -> None:
    """Delete tables that ``written`` gave, once everything that reads them is itself written."""
    for df in stored:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
