"""Operators on small hand-made frames: NULLs, ties, boundaries, empty and repeated rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from clientlens.functions import nulls, rules, scalars as sc
from clientlens.operators import condagg, dedupe, gaps, quality, ranges, reshape
from clientlens.params import Params
from clientlens.session import forget, scratch_path, tune, written


def d(text):
    return dt.date.fromisoformat(text)


def t(text):
    return dt.datetime.fromisoformat(text)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_first_row_breaks_ties_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", 2, "w"), (None, 5, "v")], "k string, t int, v string")
    assert rows(dedupe.first_per_key(df, ["k"], [F.asc("t"), F.asc("v")]), "k", "v") == [("a", "x"), (None, "v")]


def test_nth_row_skips_short_keys(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "k string, t int")
    assert rows(dedupe.nth_per_key(df, ["k"], [F.asc("t")], 3), "k", "t") == [("a", 2)]


def test_mode_prefers_frequency_then_value(spark):
    df = spark.createDataFrame([("a", "2"), ("a", "2"), ("a", "1"), ("b", "9"), ("b", "8")], "k string, v string")
    assert rows(dedupe.mode_per_key(df, ["k"], ["v"]), "k", "v") == [("a", "2"), ("b", "8")]


def test_rows_at_maximum_keep_ties(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), ("a", 1, 3), ("b", None, 4)], "k string, v int, id int")
    assert rows(dedupe.latest_with_ties(df, ["k"], "v"), "id") == [(1,), (2,)]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert rows(dedupe.duplicate_rows(df, ["k"]), "v") == [("x",), ("y",)]
    assert rows(dedupe.duplicate_keys(df, ["k"]), "k", "n_rows") == [(1, 2)]


def test_distinct_counts_equal_count_distinct(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 5), ("a", "y", 1), ("a", None, 1), ("b", None, 9)], "k string, e string, v int")
    got = condagg.distinct_counts(df, ["k"], "e", total="n", flags={"small": F.col("v") == 1}, sums={"s": F.when(F.col("v") > 4, F.col("v"))},
                                  means={"m": F.when(F.col("k") == "a", F.col("v"))}, counts={"c": F.col("v") > 0})
    assert rows(got, "k", "n", "small", "s", "m", "c") == [("a", 2, 2, 5.0, 2.0, 4), ("b", 0, 0, 9.0, None, 1)]


def test_gaps_count_days_with_several_rows(spark):
    df = spark.createDataFrame([("a", d("2024-01-01"), 3), ("a", d("2024-01-05"), 1), ("a", d("2024-01-06"), 1), ("b", d("2024-01-01"), 1)],
                               "k string, day date, n long")
    # raw gaps of a: 0 0 4 1
    assert rows(gaps.day_gaps(df, "k", "day", "n"), "k", "gap", "weight") == [("a", 0, 2), ("a", 1, 1), ("a", 4, 1)]
    got = gaps.day_gap_stats(df, "k", "day", {"all": F.col("n"), "late": F.when(F.col("day") > d("2024-01-01"), 1).otherwise(0)}, totals=["n"])
    assert rows(got, "k", "avg_all", "med_all", "avg_late", "med_late", "n") == [("a", 1.25, 0.5, 1.0, 1.0, 5), ("b", None, None, None, None, 1)]


def test_windows_include_both_ends(spark):
    spine = spark.createDataFrame([("a", d("2024-01-01")), ("b", d("2024-01-01"))], "k string, start date")
    facts = spark.createDataFrame([("a", t(f"{day}T23:59:59")) for day in ("2023-12-31", "2024-01-01", "2024-04-30", "2024-05-30", "2024-05-31")]
                                  + [("a", None), (None, t("2024-01-01T00:00:00"))], "who string, at timestamp_ntz")
    start = F.col("start")
    found = ranges.window_counts(spine, facts, "k", "who", {"all": (F.col("at"), F.lit(True))}, {
        "near": ("all", start, F.date_add(start, 120)), "far": ("all", F.date_add(start, 120), F.date_add(start, 150))})
    got = ranges.with_counts(spine, found, "k")
    assert rows(got, "k", "near", "far") == [("a", 2, 2), ("b", 0, 0)]  # day 120 belongs to both


def test_counts_on_or_after(spark):
    left = spark.createDataFrame([("a", d("2024-01-02"), 1), ("a", d("2024-01-02"), 2), ("a", d("2024-01-09"), 3), ("c", d("2024-01-01"), 4)],
                                 "k string, day date, id int")
    facts = spark.createDataFrame([("a", d("2024-01-01")), ("a", d("2024-01-02")), ("a", d("2024-01-05")), ("b", d("2024-01-05"))], "k string, at date")
    got = ranges.count_on_or_after(left, facts, ["k"], "day", "at", "n")
    assert rows(got, "id", "n") == [(1, 2), (2, 2), (3, 0), (4, 0)]


def test_exact_counts_inside_a_minute(spark):
    stamps = ["2024-01-01T10:00:01", "2024-01-01T10:00:02", "2024-01-01T10:05:00", "2024-01-02T00:00:00"]
    df = spark.createDataFrame([("a", t(s), i % 2) for i, s in enumerate(stamps)], "k string, at timestamp_ntz, hit int")
    got = ranges.exact_counts_at_or_after(df, ["k"], "at", "hit", "n", "total")
    assert [r["n"] for r in got.orderBy("at").collect()] == [2, 2, 1, 1]
    assert {r["total"] for r in got.collect()} == {2}


def test_pivots(spark):
    df = spark.createDataFrame([("a", "x", "p", None), ("a", "x", "p", None), ("a", "x", "q", "1"), ("a", None, "r", None), ("b", "z", "p", None),
                                (None, "x", "p", "1")], "k string, c string, v string, e string")
    assert rows(reshape.pivot_nunique(df, "k", "c", "v", ["x", "y"]), "k", "x", "y") == [("a", 2, None), ("b", None, None)]
    many = reshape.pivot_many(df, "k", "v", {"c": ("c", ["x", "z"]), "e": ("e", ["1"])}, present={"any_e": "e"})
    assert rows(many, "k", "c:x", "c:z", "e:1", "any_e") == [("a", 2, None, 1, 1), ("b", None, 1, None, None)]


def test_many_pivots_copy_no_rows_and_take_any_number_of_cells(spark):
    labels = [f"c{i}" for i in range(130)]
    cells = [(k, x, f"{k}{i % 7}") for k, n in (("a", 130), ("b", 3)) for i, x in enumerate(labels[:n])]
    df = spark.createDataFrame([*cells, *cells, ("a", "other", "v"), ("a", "else", "v"), ("b", "c0", "b5"), ("c", "c0", None), ("d", None, "v")],
                               "k string, c string, v string")
    many = reshape.pivot_many(df, "k", "v", {"c": ("c", labels)}, present={"any": "c"})
    got = {r["k"]: r for r in many.collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert [got["a"][f"c:{x}"] for x in labels] == [1] * 130 and got["a"]["c:*"] == 1 and got["a"]["any"] == 1
    assert [got["b"][f"c:{x}"] for x in labels[:4]] == [2, 1, 1, None] and got["b"]["c:*"] is None
    # a category whose values are all unknown is there, with none counted
    assert (got["c"]["c:c0"], got["c"]["c:c1"], got["c"]["any"]) == (0, None, 1)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_partitions_grow_with_the_input(spark, tmp_path):
    """Tasks merge what is small, so a large input has more of them and not larger ones."""
    (tmp_path / "small").mkdir()
    (tmp_path / "large").mkdir()
    for name, size in (("small", 1), ("large", 400 << 20)):
        with open(tmp_path / name / "orders.parquet", "wb") as f:
            f.truncate(size)
    try:
        assert [tune(spark, str(tmp_path / x)).conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") for x in ("small", "large")] == ["8", "100"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_fills(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, d("2024-01-01"), "s", 2.0)], "i int, day date, s string, x double")
    assert rows(nulls.fill_by_type(df), "i", "day", "s", "x") == [(-1, d("1900-01-01"), "Unknown", -1.0), (1, d("2024-01-01"), "s", 2.0)]
    pair = spark.createDataFrame([(None, "b"), ("a", "b"), (None, None)], "x string, y string")
    assert rows(nulls.backfill(pair, [("x", "y")]), "x") == [("a",), ("b",), (None,)]


def test_rules_first_match_and_lookup(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("c",), (None,)], "s string")
    first = rules.first_match([(F.col("s").contains("a"), "A"), (F.col("s").contains("b"), "B")], F.col("s"))
    assert [r[0] for r in df.select(first).collect()] == ["A", "B", "c", None]
    found = rules.lookup(F.col("s"), {"b": "yes"})
    assert [r[0] for r in df.select(found).collect()] == [None, "yes", None, None]
    assert [r[0] for r in df.select(rules.flag(F.col("s") == "b")).collect()] == [0, 1, 0, 0]


@pytest.mark.parametrize("text,expected", [("5 Jan 1990", d("1990-01-05")), ("15 Jan 1990", d("1990-01-15")), ("1990-01-05", None), ("", None), (None, None)])
def test_birth_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(sc.parse_day_month_year(F.col("s"))).first()[0] == expected


def test_ages_round_down(spark):
    df = spark.createDataFrame([(d("2024-01-02"), d("2024-01-01")), (d("2023-01-01"), d("2024-01-01"))], "born date, at date")
    assert [r[0] for r in df.select(sc.age_years(sc.age_days(F.col("born"), F.col("at")))).collect()] == [-1, 1]


def test_minutes_truncate_toward_zero(spark):
    df = spark.createDataFrame([(t("2024-01-01T10:00:30"), t("2024-01-01T10:01:29")), (t("2024-01-01T10:01:29"), t("2024-01-01T10:00:00"))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(sc.minutes_between(F.col("a"), F.col("b"))).collect()] == [0, -1]


def test_keys_with_many_and_nulls(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", None), (None, "3", "y")], "k string, dev string, tel string")
    assert rows(quality.keys_with_many(df, "k", ["dev", "tel"]), "k", "unique_dev_count", "unique_tel_count") == [("a", 2, 1)]
    assert rows(quality.null_counts(df), "column_name", "n_null") == [("dev", 0), ("k", 1), ("tel", 1)]


def test_sample_is_repeatable_and_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = rows(quality.hashed_sample(df, "k", 50, 1), "k")
    assert len(one) == 50 and one == rows(quality.hashed_sample(df.repartition(7), "k", 50, 1), "k")
    assert one != rows(quality.hashed_sample(df, "k", 50, 2), "k")


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    stored = written(spark.range(3), "kept")
    assert stored.count() == 3
    forget(stored)
    assert not os.path.exists(stored.stored_at.removeprefix("file:"))


def test_params_name_the_bank():
    p = Params(bank="Acme")
    assert (p.main_account, p.inside, p.outside) == ("Acme Account", "Inside Acme", "Outside Acme")
