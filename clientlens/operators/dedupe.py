"""Top-1, n-th row, mode and duplicate operators.

``row_number() <= n`` lets Spark keep at most n rows per key on the map side (WindowGroupLimit),
so a key that owns a large share of the table never travels as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def nth_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n-th row of each key in the given order; keys with fewer rows vanish."""
    return _ranked(df, keys, order).filter(F.col("_rank") == n).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key. Give a unique tiebreak as the last order column."""
    return nth_per_key(df, keys, order, 1)


def nth_per_key_by_day(df: DataFrame, keys: Sequence[str], day: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The n-th row of each key by day, then in the given order within its day; for keys with long histories and a large n.

    Rows move once, and of a key no more than n from each task before the shuffle: up to the n that Spark limits
    (``spark.sql.optimizer.windowGroupLimitThreshold``), a key that owns much of the table does not travel as a whole. Rows
    without a day come first.
    """
    dated = df.withColumn("_day", day)
    return nth_per_key(dated, keys, [F.asc_nulls_first("_day"), *order], n).drop("_day")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first n rows of each key in the given order, with their rank kept."""
    return _ranked(df, keys, order).filter(F.col("_rank") <= n).withColumnRenamed("_rank", rank)


def mode_per_key(df: DataFrame, keys: Sequence[str], values: Sequence[str], count: str = "frequency") -> DataFrame:
    """Most frequent value tuple of each key, ties broken by the values."""
    counted = df.groupBy(*keys, *values).agg(F.count("*").alias(count))
    return first_per_key(counted, keys, [F.desc(count), *[F.asc_nulls_first(v) for v in values]])


def latest_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows whose value equals the maximum of their key."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    same = [df[k].eqNullSafe(top[k]) for k in keys]
    condition = df[value] == top["_top"]
    for s in same:
        condition = condition & s
    return df.join(top, condition, "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str], count: str = "n_rows") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).filter(F.col(count) > 1)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    return df.join(duplicate_keys(df, keys).select(*keys), list(keys), "left_semi")
