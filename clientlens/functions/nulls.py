"""Filling of missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

FILL_NUMBER = -1
FILL_DATE = "1900-01-01"
FILL_TEXT = "Unknown"


def backfill(df: DataFrame, pairs: Iterable[tuple[str, str]], drop: bool = True) -> DataFrame:
    """Fill each first column from the second, then drop the second ones."""
    pairs = list(pairs)
    filled = df.withColumns({a: F.coalesce(F.col(a), F.col(b)) for a, b in pairs})
    return filled.drop(*[b for _, b in pairs]) if drop else filled


def fill_by_type(df: DataFrame) -> DataFrame:
    """Numbers become -1, dates 1900-01-01 and text 'Unknown' where they are NULL."""
    def filled(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.NumericType):
            return F.coalesce(column, F.lit(FILL_NUMBER).cast(field.dataType)).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.coalesce(column, F.lit(FILL_DATE).cast(field.dataType)).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(column, F.lit(FILL_TEXT)).alias(field.name)
        return column
    return df.select(*[filled(f) for f in df.schema.fields])
