"""Conditional aggregates that stay at two exchanges however many measures are asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column) -> Column:
    """NULL when no row matches."""
    return F.sum(F.when(condition, value))


def avg_where(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def min_if_any(condition: Column, value: Column) -> Column:
    """Smallest value among the rows that match, NULL without any."""
    return F.min(F.when(condition, value))


def distinct_counts(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    flags: Mapping[str, Column],
    sums: Mapping[str, Column] | None = None,
    means: Mapping[str, Column] | None = None,
    counts: Mapping[str, Column] | None = None,
    total: str | None = None,
) -> DataFrame:
    """COUNT(DISTINCT IF(flag, entity, NULL)) for many flags, next to sums, means and row counts.

    First one row per (key, entity), then one row per key: no row is copied per measure, and the
    first exchange spreads a heavy key over all its entities.
    """
    sums, means, counts = dict(sums or {}), dict(means or {}), dict(counts or {})
    first = {f"_f_{n}": F.max(F.when(c, 1).otherwise(0)) for n, c in flags.items()}
    first |= {f"_s_{n}": F.sum(c) for n, c in sums.items()}
    first |= {f"_c_{n}": count_where(c) for n, c in counts.items()}
    for n, c in means.items():
        first |= {f"_ms_{n}": F.sum(c), f"_mn_{n}": F.count(c)}
    if not first:
        first = {"_one": F.count("*")}
    per_entity = df.groupBy(*keys, entity).agg(*[c.alias(n) for n, c in first.items()])

    known = F.col(entity).isNotNull()
    second = []
    if total:
        second.append(F.count(entity).alias(total))
    second += [F.count(F.when(known & (F.col(f"_f_{n}") == 1), 1)).alias(n) for n in flags]
    second += [F.sum(f"_s_{n}").cast("double").alias(n) for n in sums]
    second += [F.sum(f"_c_{n}").alias(n) for n in counts]
    second += [(F.sum(f"_ms_{n}").cast("double") / F.nullif(F.sum(f"_mn_{n}"), F.lit(0))).alias(n) for n in means]
    return per_entity.groupBy(*keys).agg(*second)


def share_of_total(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Count and percentage per value; the total is a scalar over the counted, hence small, result."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    if not keep_null:
        counted = counted.filter(F.col(column).isNotNull())
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(column, "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct"))
