"""Rule tables folded into Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def first_match(rules: Iterable[tuple[Column, Column | str]], otherwise: Column | None = None) -> Column:
    """Value of the first rule that holds; ``otherwise`` (or NULL) when none does."""
    result = None
    for condition, value in rules:
        value = F.lit(value) if isinstance(value, str) else value
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result if otherwise is None else result.otherwise(otherwise)


def all_matches(rules: Mapping[str, Column]) -> Column:
    """Array with the name of every rule that holds; its length is bounded by the rule table."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def lookup(value: Column, mapping: Mapping[str, str]) -> Column:
    """Value translated through a small fixed map, NULL when it is not listed."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (NULL counts as not holding)."""
    return F.when(condition, 1).otherwise(0).cast("bigint")


def missing_flag(key: Column) -> Column:
    """1 where a left join found no partner."""
    return flag(key.isNull())
