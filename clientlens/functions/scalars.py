"""Column functions for text, dates and ages. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365
DAYS_PER_MONTH = 30.44


def text_key(key: Column) -> Column:
    """Customer key as text."""
    return key.cast("string")


def whole_text_key(key: Column) -> Column:
    """Text of a key that an outer join turned into a fractional number: 12.0 becomes '12'."""
    return F.round(key, 0).try_cast("bigint").cast("string")


def number_key(key: Column) -> Column:
    """Customer key as a number, NULL when the text is not one."""
    return key.try_cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, truncated toward zero."""
    return F.timestamp_diff("MINUTE", start, end)


def parse_day_month_year(text: Column) -> Column:
    """'5 Jan 1990' to a date; NULL when the text is malformed."""
    return F.try_to_timestamp(text, F.lit("d MMM yyyy")).cast("date")


def parse_micro_timestamp(text: Column) -> Column:
    """'2024-01-31 10:20:30.123456' to a timestamp; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")


def age_days(born: Column, as_of: Column) -> Column:
    return F.datediff(as_of, born).cast("bigint")


def age_years(days: Column) -> Column:
    """Whole years of 365 days, rounded down (negative ages too)."""
    return F.floor(days / DAYS_PER_YEAR)


def months_on_book(first: Column, as_of: Column) -> Column:
    return F.round(F.datediff(as_of, first) / DAYS_PER_MONTH, 2)


def offset_dates(day: Column, offsets: tuple[int, ...]) -> dict[str, Column]:
    """{'day_120': day + 120, ...}"""
    return {f"day_{n}": F.date_add(day, n) for n in offsets}


def phone_prefix(number: Column, digits: int) -> Column:
    """Leading digits after the two-digit country code."""
    return F.substring(number, 3, digits)


def normalised_package(name: Column) -> Column:
    """App package name without blanks, dots and underscores."""
    return F.regexp_replace(name, "[ ._]", "")


def contains(text: Column, part: str, fold_case: bool = True) -> Column:
    """LIKE '%part%', on lowered text when fold_case is set."""
    return F.lower(text).contains(part.lower()) if fold_case else text.contains(part)


def lacks(text: Column, part: str) -> Column:
    """NOT LIKE '%part%' on lowered text; NULL text stays NULL and so does not pass a filter."""
    return ~contains(text, part)


def on_or_between(value: Column, low, high) -> Column:
    """Both ends inclusive, compared as dates."""
    return F.to_date(value).between(F.lit(low).cast("date") if isinstance(low, str) else low,
                                    F.lit(high).cast("date") if isinstance(high, str) else high)
