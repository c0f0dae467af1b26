"""Range and as-of operators that never build the pairs of a key.

The right side is first reduced to one row per key and day; the counts a left row needs are then
read from running totals or from a join with a spine that is unique per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def daily_counts(facts: DataFrame, key: str, streams: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Facts per key and day, one column per stream (date, condition), from one scan."""
    dated = F.array(*[F.struct(F.lit(n).alias("stream"), F.when(c, F.to_date(at)).alias("day")) for n, (at, c) in streams.items()])
    return (facts.filter(F.col(key).isNotNull())
            .select(F.col(key).alias("_fact_key"), F.explode(dated).alias("_d"))
            .select("_fact_key", F.col("_d.stream").alias("_stream"), F.col("_d.day").alias("_day"))
            .filter(F.col("_day").isNotNull())
            .groupBy("_fact_key", "_day")
            .agg(*[F.count(F.when(F.col("_stream") == n, 1)).alias(f"_n_{n}") for n in streams]))


def inside(day: Column, low: Column, high: Column, closed: str = "both") -> Column:
    """Whether a day lies in an interval whose ends belong to it as ``closed`` says: both, left, right or neither."""
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"closed: {closed!r}")
    return ((day >= low) if closed in ("both", "left") else (day > low)) & ((day <= high) if closed in ("both", "right") else (day < high))


def window_counts(spine: DataFrame, facts: DataFrame, key: str, fact_key: str,
                  streams: Mapping[str, tuple[Column, Column]],
                  windows: Mapping[str, tuple[str, Column, Column] | tuple[str, Column, Column, str]]) -> DataFrame:
    """Per spine key, the facts of a stream dated inside windows of the spine row.

    ``windows`` maps an output name to (stream, low, high) or (stream, low, high, closed), see ``inside``. The spine must
    be unique on its key, so that the join repeats neither side; keys without facts are absent.
    """
    bounds = spine.select(key, *[c.alias(f"_{side}_{n}") for n, (_, low, high, *_) in windows.items() for side, c in (("lo", low), ("hi", high))])
    daily = daily_counts(facts, fact_key, streams)
    return (daily.join(bounds, daily["_fact_key"] == bounds[key]).groupBy(key)
            .agg(*[F.sum(F.when(inside(F.col("_day"), F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), *closed), F.col(f"_n_{stream}"))).alias(n)
                   for n, (stream, _, _, *closed) in windows.items()]))


def with_counts(spine: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Join counts to the spine; a missing count is 0, as COUNT gives it."""
    names = [c for c in counts.columns if c != key]
    return (spine.join(counts, key, "left")
            .withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in names}))


def count_on_or_after(left: DataFrame, facts: DataFrame, keys: Sequence[str], left_date: str, fact_date: str,
                      name: str = "n_after") -> DataFrame:
    """Left rows with the number of facts of the same key dated on or after their day.

    Days of both sides are merged first, so the running total covers at most one row per key and
    calendar day; left rows come back through an equi-join on key and day.
    """
    days = left.select(*keys, F.to_date(left_date).alias("_day")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    hits = (facts.select(*keys, F.to_date(fact_date).alias("_day")).filter(F.col("_day").isNotNull())
            .groupBy(*keys, "_day").agg(F.count("*").alias("_n")))
    later = W.partitionBy(*keys).orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = (days.unionByName(hits).groupBy(*keys, "_day").agg(F.sum("_n").alias("_n"))
              .withColumn(name, F.sum("_n").over(later)).drop("_n"))
    return (left.withColumn("_day", F.to_date(left_date))
            .join(totals, [*keys, "_day"], "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint")).drop("_day"))


#: Microseconds of the finer and of the coarser steps into which time falls: 31,250 microseconds make one, 32,000 of these
#: a coarser one (1000 seconds), and 31,536 of those a year, so that no window holds more than about so many rows.
FINE_STEP, FINE_STEPS = 31_250, 32_000


def exact_counts_at_or_after(times: DataFrame, keys: Sequence[str], time: str, hits: str,
                             name: str, total: str) -> DataFrame:
    """Running total of ``hits`` from the end, on a frame with one row per key and timestamp.

    Totals are built on three levels: coarse steps of a key, fine steps of a coarse one, timestamps of a fine
    one. Each level is the partial sum of the one below, added up before its shuffle, and each window runs over one level of
    one group, so neither a key with a long history nor one with a million events in a minute is ever one window's
    rows. ``total`` is the sum over the whole key. ``time`` is a timestamp without time zone and not NULL.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    rows = times.withColumn("_fine", F.floor(micros / FINE_STEP)).withColumn("_coarse", F.floor(F.col("_fine") / FINE_STEPS))

    def later(column: str, group: Sequence[str], order: str) -> Column:
        window = W.partitionBy(*group).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    fine = rows.groupBy(*keys, "_coarse", "_fine").agg(F.sum(hits).alias("_hits"))
    coarse = fine.groupBy(*keys, "_coarse").agg(F.sum("_hits").alias("_hits"))
    coarse = coarse.select(*keys, "_coarse", later("_hits", keys, "_coarse").alias("_after_coarse"), F.sum("_hits").over(W.partitionBy(*keys)).alias(total))
    fine = (fine.withColumn("_after_fine", later("_hits", [*keys, "_coarse"], "_fine")).join(coarse, [*keys, "_coarse"])
            .select(*keys, "_coarse", "_fine", (F.col("_after_fine") + F.col("_after_coarse")).alias("_after"), total))
    return (rows.withColumn("_inside", later(hits, [*keys, "_coarse", "_fine"], time) + F.col(hits))
            .join(fine, [*keys, "_coarse", "_fine"])
            .withColumn(name, (F.col("_inside") + F.col("_after")).cast("bigint"))
            .drop("_coarse", "_fine", "_inside", "_after"))


def as_of_cutoff(spine: DataFrame, facts: DataFrame, key: str, date: str, cutoff: str, how: str = "inner") -> DataFrame:
    """Facts of a key dated on or before the cutoff day of its spine row.

    An equi-join with a date residual; the spine must be unique on the key.
    """
    condition = (spine[key] == facts[key]) & (F.to_date(facts[date]) <= spine[cutoff])
    return spine.join(facts, condition, how).drop(facts[key])
