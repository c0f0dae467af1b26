"""Data-quality reports as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from clientlens.functions.rules import flag
from clientlens.session import written


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of NULLs, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    return counts.select(F.explode(cells).alias("_c")).select("_c.column_name", "_c.n_null")


def keys_with_many(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values per key of each column; a pair-wise distinct precedes every count."""
    def counted(c: str) -> DataFrame:
        return (df.select(key, c).filter(F.col(key).isNotNull()).distinct()
                .groupBy(key).agg(F.count(c).alias(f"unique_{c}_count")))
    return reduce(lambda a, b: a.join(b, key), [counted(c) for c in columns])


@dataclass(frozen=True)
class Check:
    """One question about a table, and what offends.

    ``rows``: every row (a plain count). ``failing``: rows that meet ``condition``. ``duplicate``: keys of several rows.
    ``several``: known keys with several known values of ``member``. ``missing``: rows whose key is none of ``other``'s.
    """

    name: str
    table: str
    kind: str
    keys: tuple[str, ...] = ()
    member: str | None = None
    condition: Column | None = None
    other: tuple[str, tuple[str, ...]] | None = None


def _facts(check: Check, number: int, keys: Sequence[str], here: bool) -> Column:
    """What a row tells a check: its key, the member, and whether it is one of those that are judged; NULL if it tells nothing."""
    fact = F.struct(F.lit(number).alias("check"), F.array(*[F.col(k).cast("string") for k in keys]).cast("array<string>").alias("key"),
                    (F.col(check.member).cast("string") if check.member else F.lit(None).cast("string")).alias("member"), F.lit(here).alias("here"))
    known = check.condition
    if check.kind == "several":
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return fact if known is None else F.when(known, fact)


def checks_report(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Offending rows or keys per check (check_name, n_offending), from one scan of each table and one grouping of all.

    Every row is turned into what it tells the checks about its table; these are added up by check and key before the shuffle,
    then by check. A check that nothing offends has 0.
    """
    told: dict[str, list[Column]] = {}
    for number, check in enumerate(checks):
        told.setdefault(check.table, []).append(_facts(check, number, check.keys, True))
        if check.other:
            told.setdefault(check.other[0], []).append(_facts(replace(check, member=None, condition=None), number, check.other[1], False))
    facts = reduce(DataFrame.unionByName, [tables[name].select(F.inline(F.array_compact(F.array(*columns)))) for name, columns in told.items()])
    of_key = facts.groupBy("check", "key").agg(F.count_if("here").alias("n"), F.bool_or(~F.col("here")).alias("elsewhere"),
                                               F.min("member").alias("least"), F.max("member").alias("most"))
    no_key = F.exists("key", lambda k: k.isNull())
    offends = {"rows": F.col("n"), "failing": F.col("n"), "duplicate": flag(F.col("n") > 1), "several": flag(F.col("least") < F.col("most")),
               "missing": F.when(~F.col("elsewhere") | no_key, F.col("n")).otherwise(0)}
    kind = F.element_at(F.array(*[F.lit(c.kind) for c in checks]), F.col("check") + 1)
    counted = of_key.groupBy("check").agg(F.sum(reduce(lambda a, k: a.when(kind == k, offends[k]), offends, F)).alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("check"), F.lit(c.name).alias("check_name")) for i, c in enumerate(checks)])
    listed = facts.sparkSession.range(1).select(F.inline(names))
    return listed.join(counted, "check", "left").select("check_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_offending"))


def counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """The frame stored, and measures of it that were taken while it was written."""
    seen = Observation(name)
    stored = written(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), name)
    return stored, seen.get


def reach(df: DataFrame, by: Sequence[str], entity: str, name: str) -> DataFrame:
    """Distinct entities per group, NULL groups left out."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    return (df.filter(known).select(*by, entity).distinct().groupBy(*by).agg(F.count(entity).alias(name)))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows, drawn in the order of a seeded hash of a unique key: repeatable anywhere."""
    ticket = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_ticket", ticket).orderBy("_ticket", key).limit(n).drop("_ticket")
