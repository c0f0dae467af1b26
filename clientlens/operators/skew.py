"""Joins with keys that hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clientlens.session import written

#: A key is heavy with more than this part of the rows, so at most so many keys are.
HEAVY_PART = 1000


def heavy_keys(facts: DataFrame, keys: Sequence[str], sample: float = 0.01, part: int = HEAVY_PART) -> DataFrame:
    """Keys with more than one ``part``-th of the sampled rows: at most ``part`` rows, whatever the size of the facts.

    Only the keys of the facts are read. What the sample misses costs balance and no result.
    """
    seen = facts.select(*keys).sample(fraction=sample, seed=1) if sample < 1 else facts.select(*keys)
    counted = written(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "key-frequencies")
    total = counted.agg(F.sum("_rows")).scalar()
    return written(counted.filter(F.col("_rows") * part > total).select(*keys), "heavy-keys")


def salted_join(facts: DataFrame, dims: DataFrame, keys: Sequence[str], heavy: DataFrame, salts: int, how: str = "inner") -> DataFrame:
    """Join facts with rows that are few per key, with the rows of heavy keys dealt out over ``salts`` partitions.

    ``heavy`` has at most ``HEAVY_PART`` keys and is sent to both sides, where it marks their rows; the dimension rows of
    a heavy key are copied once per salt. Keys are compared as in an equi-join: NULL meets nothing. ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how!r}")

    marks = F.broadcast(heavy.select(*[F.col(k).alias(f"_heavy_{k}") for k in keys]).withColumn("_heavy", F.lit(True)))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(marks, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_heavy_{k}") for k in keys]), "left")

    def plain(df: DataFrame, salt: Column) -> DataFrame:
        return df.withColumn("_salt", salt).drop("_heavy", *[f"_heavy_{k}" for k in keys])

    dealt = plain(marked(facts), F.when(F.col("_heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"))
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = plain(marked(dims).withColumn("_copies", copies), F.explode("_copies")).drop("_copies")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
