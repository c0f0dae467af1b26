"""Readers: parquet tables, typed CSV, rename sheets, published marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clientlens.operators.sinks import CSV_DIALECT

#: A text that no file holds: with the default, Spark reads a quoted empty field as NULL.
NO_TEXT = "\\N"


class Tables:
    """Parquet tables of one folder, read by name: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.schemas: dict[str, T.StructType] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        if name not in self.schemas:
            # footers are read once per table, not once per use
            self.schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self.schemas[name]).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False) -> DataFrame:
    """CSV with a header and a declared schema; a line that does not fit it is an error.

    An empty field is NULL when it is bare and an empty text when it is quoted, as ``sinks.write_csv`` writes them.
    Files whose fields hold line breaks need ``line_breaks``, which reads each file in one task; large tables
    with such texts belong in parquet.
    """
    return (spark.read.schema(schema).options(**CSV_DIALECT, mode="FAILFAST", multiLine=line_breaks)
            .option("enforceSchema", False).option("nullValue", NO_TEXT).option("emptyValue", "").csv(path))


def rename_map(sheet: DataFrame, old: str, new: str, columns: Sequence[str]) -> dict[str, str]:
    """What a two-column rename sheet says about ``columns``.

    Half-filled lines and names that are listed twice are errors. Only the lines about the columns reach the driver.
    """
    broken = sheet.groupBy(old).agg(F.count(F.lit(1)).alias("n"), F.count(new).alias("filled")).where((F.col("n") > 1) | (F.col("filled") < 1) | F.col(old).isNull())
    first = broken.select(old).head()
    if first is not None:
        raise ValueError(f"rename sheet: {first[0]!r} is listed twice or half-filled")
    return {r[0]: r[1] for r in sheet.where(F.col(old).isin(list(columns))).select(old, new).collect()}


def in_cohort(df: DataFrame, key: str, cohort: DataFrame, cohort_key: str) -> DataFrame:
    """Rows whose key belongs to the cohort."""
    return df.join(cohort, df[key] == cohort[cohort_key], "left_semi")


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Dates from start to the day before end."""
    days = F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1))
    return spark.range(1).select(F.explode(days).alias("day"))
