"""Pivots, renames and assembly of wide frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Cells that share a bigint; its sign stays free.
_WORD = 62


def pivot_nunique(df: DataFrame, key: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Distinct values per key and listed category; NULL where a key has none.

    Rows are made distinct first (an exchange on key, category and value), so the pivot itself
    only adds up and a heavy key is already spread.
    """
    cells = (df.select(key, column, value).filter(F.col(column).isNotNull() & F.col(key).isNotNull()).distinct())
    return cells.groupBy(key).pivot(column, list(values)).agg(F.count(value))


def pivot_many(df: DataFrame, key: str, value: str, cells: Mapping[str, tuple[str, Sequence[str]]],
               present: Mapping[str, str] | None = None) -> DataFrame:
    """Several distinct-count pivots of one frame in a single pass over it.

    ``cells`` maps a column prefix to (category column, listed categories); output columns are
    named prefix:category and are NULL where a key has none. Categories that are not listed count
    in prefix:*, so that a key's columns of one prefix add up to its values. ``present`` maps an output name to a
    category column and tells (1 or NULL) whether the key has any category in it.

    Every cell is a bit: first the bits of one (key, value) are put together, then a key's values are counted per
    bit, so no row is copied per category and what travels is one row per value with its bits.
    """
    bits = {f"{prefix}:{c}": i for i, (prefix, c) in enumerate((p, c) for p, (_, values) in cells.items() for c in (*values, "*"))}
    for name in present or {}:
        bits[name] = len(bits)
    words = range(len(bits) // _WORD + 1)

    def bit(cell: str, word: int) -> int:
        return 1 << bits[cell] % _WORD if bits[cell] // _WORD == word else 0

    def of_row(word: int) -> Column:
        found = []
        for prefix, (column, values) in cells.items():
            listed = [x for c in values for x in (F.lit(c), F.lit(bit(f"{prefix}:{c}", word)).cast("bigint"))]
            known = F.create_map(*listed)[F.col(column)] if listed else F.lit(None)
            found.append(F.when(F.col(column).isNotNull(), F.coalesce(known, F.lit(bit(f"{prefix}:*", word)))))
        found += [F.when(F.col(column).isNotNull(), F.lit(bit(name, word))) for name, column in (present or {}).items()]
        return reduce(lambda a, b: a.bitwiseOR(b), [F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint")) for x in found])

    names = [f"_bits_{w}" for w in words]
    per_value = (df.filter(F.col(key).isNotNull()).select(key, value, *[of_row(w).alias(n) for w, n in zip(words, names)])
                 .filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names]))
                 .groupBy(key, value).agg(*[F.bit_or(n).alias(n) for n in names]))

    def has(cell: str) -> Column:
        return F.getbit(f"_bits_{bits[cell] // _WORD}", F.lit(bits[cell] % _WORD))

    known = F.col(value).isNotNull()
    per_key = per_value.groupBy(key).agg(*[F.bit_or(n).alias(n) for n in names], *[
        F.sum(F.when(known, has(cell)).otherwise(0)).alias(f"_n_{i}") for cell, i in bits.items() if cell not in (present or {})])
    return per_key.select(key, *[F.when(has(cell) == 1, F.lit(1).cast("bigint") if cell in (present or {}) else F.col(f"_n_{i}")).alias(cell)
                                 for cell, i in bits.items()])


def spread_by_kind(kind: Column, values: Mapping[str, Mapping[str, Column]]) -> dict[str, Column]:
    """One column per (kind, field): the field where the row is of that kind, else NULL."""
    return {name: F.when(kind == k, c) for k, fields in values.items() for name, c in fields.items()}


def assemble(spine: DataFrame, parts: Iterable[DataFrame], key: str) -> DataFrame:
    """Left-join every part onto the spine; each part must be unique on the key."""
    return reduce(lambda left, right: left.join(right, key, "left"), parts, spine)


def rename_by_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are listed, keep the others."""
    return df.withColumnsRenamed(dict(names))


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").alias(prefix + c) for c in df.columns])
