"""Table and file sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientlens.session import written


#: Quotes inside a quoted field are doubled, as spreadsheets and warehouses write them.
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"'}


def to_schema(df: DataFrame, schema: T.StructType, coerce: Sequence[str] = ()) -> DataFrame:
    """Cast to the declared fields and order; a field the frame lacks, or a value that does not fit, is an error.

    Only fields in ``coerce`` turn a value that does not fit into NULL.
    """
    def typed(f: T.StructField) -> Column:
        column = F.col(f"`{f.name}`")
        return (column.try_cast(f.dataType) if f.name in coerce else column.cast(f.dataType)).alias(f.name)

    return df.select(*[typed(f) for f in schema.fields])


def write_typed(df: DataFrame, schema: T.StructType, path: str, mode: str = "overwrite", coerce: Sequence[str] = (),
                partition: Sequence[str] = ()) -> None:
    """Replace (or append to) a parquet table with the declared schema."""
    to_schema(df, schema, coerce).write.mode(mode).partitionBy(*partition).parquet(path)


def save_typed(df: DataFrame, schema: T.StructType, table: str, mode: str = "overwrite", coerce: Sequence[str] = (),
               partition: Sequence[str] = ()) -> None:
    """The same into a table of the session's catalog, read back with ``spark.table``."""
    to_schema(df, schema, coerce).write.format("parquet").mode(mode).partitionBy(*partition).saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and doubled quotes; a line break in a field is quoted (see ``readers.read_csv``).

    A missing value is a bare empty field, an empty text a quoted one, so that both come back as they were.
    """
    df.write.mode(mode).options(**CSV_DIALECT).csv(path)


def write_snapshot(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Write date partitions; a rerun replaces only the partitions it holds.

    Rows are rebalanced on the partition columns, so a task does not open a file per date, and a
    heavy partition is split over several tasks by size at run time.
    """
    (df.hint("rebalance", *[F.col(c) for c in partition])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path))


def refresh_snapshot(source: DataFrame, changed_at: str, time: str, build: Callable[[DataFrame], DataFrame], path: str, partition: str) -> list[date]:
    """File the days whose source rows changed since the last refresh, and only those; gives these days.

    ``changed_at`` is when a row was last written, ``time`` the moment whose day it is filed under, ``build`` the plan from
    source rows to snapshot rows of the same day, with the day in ``partition``. The latest change seen so far is stored
    beside the snapshot, once its days are filed: a run that fails is repeated, and repeating a run changes nothing.
    Days are read as a range of ``time`` that the scan can skip by. A day that has no rows any more is removed.
    """
    spark, marks = source.sparkSession, f"{path.rstrip('/')}/_refreshed"
    schema = T.StructType([T.StructField("mark", source.schema[changed_at].dataType)])
    try:
        mark = spark.read.schema(schema).parquet(marks).agg(F.max("mark")).first()[0]
    except AnalysisException:  # nothing was filed yet
        mark = None
    fresh = source if mark is None else source.filter(F.col(changed_at) > F.lit(mark))
    changed = fresh.groupBy(F.to_date(time).alias("day")).agg(F.max(changed_at).alias("mark")).filter(F.col("day").isNotNull()).collect()
    if not changed:
        return []
    days = sorted(r["day"] for r in changed)
    rows = written(build(rows_of_days(source, time, days)), "snapshot-days")
    write_snapshot(rows, path, [partition])
    for day in set(days) - {r[0] for r in rows.select(partition).distinct().collect()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{partition}={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.createDataFrame([(max(r["mark"] for r in changed),)], schema).coalesce(1).write.mode("append").parquet(marks)
    return days


def rows_of_days(df: DataFrame, time: str, days: Sequence[date]) -> DataFrame:
    """Rows of some days; the range from the first to the last one is compared with ``time`` itself, so that scans skip the rest."""
    kind = df.schema[time].dataType
    low, high = F.lit(days[0]).cast(kind), F.lit(days[-1] + timedelta(days=1)).cast(kind)
    rows = df.filter((F.col(time) >= low) & (F.col(time) < high))
    whole = len(days) == (days[-1] - days[0]).days + 1
    return rows if whole else rows.filter(F.to_date(time).isin([F.lit(d) for d in days]))
