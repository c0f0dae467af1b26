"""Stored blocks, publication in one step, incremental snapshots, checks in one pass, heavy keys, long histories."""

import contextlib
import datetime as dt
import io
import random
import time
import uuid
from collections import Counter
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

import __spark_entry__  # noqa: F401  (registers the queries)
from bindings import behaviour, snapshots, targets
from bindings.registry import QUERIES, Context
from clientlens.operators import dedupe, quality, ranges, sinks, skew, stores
from clientlens.operators.quality import Check
from clientlens.plans import flags as fl
from clientlens.session import FREE_SHUFFLES, scratch_path
from clientlens.sources import standins
from clientlens.sources.readers import Tables
from tests.test_operators import d, rows, t


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__enabled": "false"}


def test_blocks_join_without_exchange_and_leave_no_table(spark):
    tables = len(spark.catalog.listTables())
    one = stores.block(spark.range(1000).select(F.col("id").cast("string").alias("k"), "id"), "k", "one")
    two = stores.block(spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("twice")), "k", "two")
    assert len(spark.catalog.listTables()) == tables
    with settings(spark, **NO_BROADCAST):
        joined = one.join(two, "k", "left")
        assert "Exchange" not in plan(joined) and "Bucketed: true" in plan(joined)
        assert joined.count() == 1000 and joined.filter("twice IS NOT NULL").count() == 334
    assert len(one.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_modelling_table_reads_each_block_once_without_exchange(spark, data):
    with settings(spark, **NO_BROADCAST):
        text = plan(targets.modelling_table(Context(spark, data)))
    assert text.count("FileScan") == 5 and "Exchange" not in text


def shuffled(spark):
    """Shuffle files that are on disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for folder in folders for f in Path(folder).rglob("shuffle_*")}


def left_behind(spark, before):
    """Shuffle files that stay; their deletion is not waited for."""
    until = time.time() + 20
    while (found := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return found


def test_a_stored_step_leaves_no_shuffle_files(spark, data):
    setting, rest = spark.conf.get(FREE_SHUFFLES), spark.range(100_000).select((F.col("id") % 997).alias("k"), "id")
    counted = rest.groupBy("k", "id").count().groupBy("k").agg(F.sum("count").alias("n"))
    c, before = Context(spark, data), shuffled(spark)
    c.staging = True
    stored = c.shared("counted", lambda: counted)
    block = stores.block(counted, "k", "counted")
    assert not left_behind(spark, before)
    assert stored.agg(F.sum("n")).first()[0] == block.agg(F.sum("n")).first()[0] == 100_000
    assert spark.conf.get(FREE_SHUFFLES) == setting


def test_blocks_are_written_one_after_another(spark, monkeypatch):
    running, most, whole = [], [], stores.block

    def watched(df, key, name, buckets):
        running.append(name)
        most.append(len(running))
        found = whole(df, key, name, buckets)
        running.remove(name)
        return found

    monkeypatch.setattr(stores, "block", watched)
    found = stores.blocks({n: lambda n=n: spark.range(n).withColumnRenamed("id", "k") for n in (3, 5)}, "k", 2)
    assert most == [1, 1] and {n: df.count() for n, df in found.items()} == {3: 3, 5: 5}


def test_modelling_table_leaves_no_shuffle_files(spark, data):
    before = shuffled(spark)
    targets.modelling_table(Context(spark, data))
    assert not left_behind(spark, before)


def test_behaviour_mart_stores_its_steps(spark, data):
    c, before = Context(spark, data), shuffled(spark)
    mart = behaviour.behaviour_mart(c)
    assert not left_behind(spark, before)
    assert {"cohort-transactions", "deposit-totals", "loan-metrics"} == set(c.stages)  # the deposits' days are deleted
    assert "lineitem.parquet" not in "".join(mart.inputFiles()) and "orders.parquet" not in "".join(mart.inputFiles())


def test_device_mart_explodes_the_inventories_once(spark, data, monkeypatch):
    from clientlens.plans import devices as dv
    calls = []
    whole = dv.installed_apps
    monkeypatch.setattr(dv, "installed_apps", lambda apps: calls.append(1) or whole(apps))
    mart = snapshots.device_mart(Context(spark, data))
    assert len(calls) == 1 and "Generate explode(Application" not in plan(mart)


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.IntegerType())])


def test_a_load_that_fails_leaves_the_old_rows(spark):
    name, folder = f"published_{uuid.uuid4().hex}", scratch_path(spark, "published")
    first = stores.publish(spark.createDataFrame([(1, "5"), (2, None)], "k long, v string"), SCHEMA, name, folder)
    old = spark.table(name)
    # fails in the middle: a later partition holds a value that does not fit
    broken = spark.range(0, 1000, 1, 8).select(F.col("id").alias("k"), F.when(F.col("id") == 990, "many").otherwise("1").alias("v"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        stores.publish(broken, SCHEMA, name, folder)
    assert rows(spark.table(name), "k", "v") == [(1, 5), (2, None)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        stores.reload(broken, name, folder)
    with pytest.raises(ValueError):
        stores.reload(spark.createDataFrame([(1, 1, 1)], "k long, v int, w int"), name, folder)
    assert rows(spark.table(name), "k", "v") == [(1, 5), (2, None)]
    stores.reload(spark.createDataFrame([(7, 8)], "k long, v long"), name, folder)
    assert spark.table(name).schema == SCHEMA and rows(spark.table(name), "k", "v") == [(7, 8)]
    assert rows(old, "k", "v") == [(1, 5), (2, None)]  # who read the old version goes on reading it
    stores.point(spark, name, SCHEMA, first)
    assert rows(spark.table(name), "k", "v") == [(1, 5), (2, None)]
    spark.sql(f"DROP VIEW {name}")


def people(spark, *lines):
    return spark.createDataFrame([(i, t(created), t(changed), status) for i, created, changed, status in lines],
                                 "cust_id long, created_dt timestamp_ntz, changed_at timestamp_ntz, kyc string")


def test_a_refresh_recomputes_changed_days_only(spark, tmp_path):
    path, built = scratch_path(spark, "refreshed"), []

    def build(source):
        built.append(source)
        return source.filter("kyc <> 'BKYC'").select("cust_id", F.to_date("created_dt").alias("day"))

    def refresh(*lines):
        frame = people(spark, *lines)
        stored = str(tmp_path / uuid.uuid4().hex)
        frame.write.parquet(stored)
        return sinks.refresh_snapshot(spark.read.parquet(stored), "changed_at", "created_dt", build, path, "day")

    a = (1, "2024-01-01T10:00:00", "2024-01-01T10:00:00", "SKYC")
    b = (2, "2024-01-02T10:00:00", "2024-01-02T10:00:00", "SKYC")
    c = (3, "2024-01-03T00:00:00", "2024-01-03T00:00:00", "BKYC")
    assert refresh(a, b, c) == [d("2024-01-01"), d("2024-01-02"), d("2024-01-03")]
    assert refresh(a, b, c) == [] and len(built) == 1
    # one day changes: a customer of the second day is excluded now, another one is new
    late = "2024-02-01T00:00:00"
    assert refresh(a, (2, b[1], late, "BKYC"), (4, "2024-01-02T23:59:59.999999", late, "SKYC"), c) == [d("2024-01-02")]
    assert rows(spark.read.parquet(path), "cust_id", "day") == [(1, d("2024-01-01")), (4, d("2024-01-02"))]
    with settings(spark, spark__sql__maxMetadataStringLength="1000"):
        text = plan(built[-1])
    pushed = text[text.index("PushedFilters"):].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(created_dt,2024-01-02T00:00)" in pushed and "LessThan(created_dt,2024-01-03T00:00)" in pushed
    # nobody of the first day is left
    assert refresh((1, a[1], "2024-02-02T00:00:00", "BKYC")) == [d("2024-01-01")]
    assert rows(spark.read.parquet(path), "cust_id", "day") == [(4, d("2024-01-02"))]
    assert sinks.refresh_snapshot(people(spark), "changed_at", "created_dt", build, scratch_path(spark, "none"), "day") == []


def test_a_refresh_that_fails_is_repeated(spark):
    path = scratch_path(spark, "refreshed")
    source = people(spark, (1, "2024-01-01T10:00:00", "2024-01-01T10:00:00", "SKYC"))
    with pytest.raises(RuntimeError):
        sinks.refresh_snapshot(source, "changed_at", "created_dt", lambda rows: (_ for _ in ()).throw(RuntimeError()), path, "day")
    keep = lambda source: source.select("cust_id", F.to_date("created_dt").alias("day"))
    assert sinks.refresh_snapshot(source, "changed_at", "created_dt", keep, path, "day") == [d("2024-01-01")]


def test_checks_in_one_pass(spark, tmp_path):
    left = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", None, 2), (None, "x", 3), (None, "z", 4), ("c", "x", 5)], "k string, m string, n int")
    right = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    empty = left.limit(0)
    checks = [Check("dup", "left", "duplicate", ("k",)), Check("dup pair", "left", "duplicate", ("k", "m")), Check("many", "left", "several", ("k",), member="m"),
              Check("no n", "left", "failing", condition=F.col("n").isNull()), Check("gone", "left", "missing", ("k",), other=("right", ("k",))),
              Check("left rows", "left", "rows"), Check("right rows", "right", "rows"), Check("none", "empty", "rows"), Check("no dup", "empty", "duplicate", ("k",))]
    report = quality.checks_report({"left": left, "right": right, "empty": empty}, checks)
    assert dict(rows(report, "check_name", "n_offending")) == {
        "dup": 2, "dup pair": 0, "many": 1, "no n": 1, "gone": 3, "left rows": 6, "right rows": 4, "none": 0, "no dup": 0}
    assert report.columns == ["check_name", "n_offending"]


def test_quality_query_scans_each_table_once(spark, data):
    with settings(spark, **NO_BROADCAST):
        text = plan(QUERIES["q55_quality_checks"](spark, data))
    assert text.count("FileScan") == 3
    text = plan(QUERIES["a26_distinct_values"](spark, data))
    assert text.count("FileScan") == 1 and "Subquery" not in text


def test_counts_are_taken_while_writing(spark):
    stored, seen = quality.counted(spark.range(50).toDF("n"), "numbers", rows=F.count(F.lit(1)), most=F.max("n"))
    assert seen == {"rows": 50, "most": 49} and stored.count() == 50


def test_heavy_account_is_dealt_out(spark):
    """One account with 40,000 of 48,000 transactions: no task gets more than five times the median."""
    n, parts = 40_000, 16
    facts = (spark.range(n).select(F.lit("1").alias("customer_id"), F.lit("608").alias("accountid"), F.col("id").alias("tx"))
             .unionByName(spark.range(8000).select((F.col("id") % 997 + 2).cast("string").alias("customer_id"), (F.col("id") % 3).cast("string").alias("accountid"),
                                                   (F.col("id") + n).alias("tx"))))
    accounts = spark.range(997).select((F.col("id") + 2).cast("string").alias("customer_id"), F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("accountid"))
    accounts = accounts.unionByName(spark.createDataFrame([("1", "608"), (None, "608")], "customer_id string, accountid string")).withColumn("opened", F.lit(1))
    key = ["customer_id", "accountid"]
    heavy = skew.heavy_keys(facts, key, sample=0.2, part=100)
    assert rows(heavy, *key) == [("1", "608")]
    with settings(spark, spark__sql__shuffle__partitions=str(parts), **NO_BROADCAST):
        def largest(df):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            return max(sizes), sorted(sizes)[len(sizes) // 2], sum(sizes)
        plain, salted = facts.join(accounts, key), skew.salted_join(facts, accounts, key, heavy, 64)
        assert largest(plain)[0] > 5 * largest(plain)[1]
        most, median, total = largest(salted)
        assert total == largest(plain)[2] and most <= 5 * median
    assert salted.exceptAll(plain.select(salted.columns)).isEmpty()
    lost = facts.limit(5).unionByName(spark.createDataFrame([("1", "no", -1), (None, "608", -2)], "customer_id string, accountid string, tx long"))
    assert skew.salted_join(lost, accounts, key, heavy, 4, "left").filter("opened IS NULL").count() == 2
    with pytest.raises(ValueError):
        skew.salted_join(facts, accounts, key, heavy, 4, "outer")


def test_no_heavy_key(spark):
    facts = spark.range(5000).select(F.col("id").alias("k"))
    assert skew.heavy_keys(facts, ["k"], sample=1.0).isEmpty() and skew.heavy_keys(facts.limit(0), ["k"]).isEmpty()
    assert skew.salted_join(facts, facts.withColumn("v", F.lit(1)), ["k"], skew.heavy_keys(facts, ["k"]), 8).count() == 5000


def test_nth_row_by_day(spark):
    draw = random.Random(1)
    start = dt.date(2024, 1, 1)
    table = [(key, start + dt.timedelta(days=draw.randint(0, 40)) if draw.random() < 0.95 else None, i) for key, size in (("a", 300), ("b", 90), ("c", 89), (None, 120)) for i in range(size)]
    df = spark.createDataFrame(table, "k string, day date, i int")
    for n in (1, 3, 90, 120, 121, 301):
        want = []
        for key in ("a", "b", "c", None):
            mine = sorted((r for r in table if r[0] == key), key=lambda r: (r[1] is not None, r[1] or start, r[2]))
            want += [mine[n - 1]] if len(mine) >= n else []
        got = dedupe.nth_per_key_by_day(df, ["k"], F.col("day"), [F.asc("i")], n)
        assert rows(got, "k", "day", "i") == sorted(want, key=str) and got.columns == df.columns


def test_balances_move_once(spark, data):
    """Lines and orders meet in one join, and only balances move by account, at most n of an account from each task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["q33_nth_day_balance"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 3 and "Partial" in plan and "Union" not in plan


def test_roles_with_a_text_for_spark_have_the_same_rows(spark, data):
    tables = Tables(spark, data)
    for name, text in standins.SPARK_SQL.items():
        assert text != standins.ROLE_SQL[name]
        plain = spark.sql(standins.ROLE_SQL[name], lineitem=tables.lineitem, orders=tables.orders)
        built = standins.role(tables, name)
        assert built.schema == plain.schema and not plain.isEmpty()
        assert built.exceptAll(plain).isEmpty() and plain.exceptAll(built).isEmpty()


def test_rank_ninety_finds_accounts(spark, data):
    assert QUERIES["q33_nth_day_balance"](spark, data).count() > 20
    assert not QUERIES["q34_deposit_only"](spark, data).isEmpty()


def test_a_million_events_in_a_minute(spark):
    """Windows hold the steps of one level: the largest group of the machine account stays far below its rows."""
    n = 1_000_000
    at = F.expr("TIMESTAMP_NTZ '2024-03-01 10:00:00' + make_dt_interval(0, 0, 0, id * 0.000059)")
    machine = spark.range(n).select(F.lit("m").alias("k"), at.alias("at"), (F.col("id") % 3 == 0).cast("int").alias("hit"))
    got = ranges.exact_counts_at_or_after(machine, ["k"], "at", "hit", "n_later", "total")
    first, last = got.orderBy("at").first(), got.orderBy(F.desc("at")).first()
    hits = (n + 2) // 3
    assert (first["n_later"], first["total"], last["n_later"], got.count()) == (hits, hits, 1, n)
    assert got.filter((F.col("hit") == 1) & (F.col("n_later") > hits)).isEmpty()
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at"))
    fine = machine.groupBy(F.floor(micros / ranges.FINE_STEP)).count().agg(F.max("count"), F.count("count")).first()
    assert fine[0] <= ranges.FINE_STEP and fine[1] <= ranges.FINE_STEPS


def test_totals_over_all_levels_agree_with_counting(spark):
    draw = random.Random(4)
    stamps = sorted({t("2023-12-31T23:59:00") + dt.timedelta(microseconds=draw.choice((1, 31_250, 10**6, 10**9, 86_400 * 10**6)) * draw.randint(0, 40)) for _ in range(300)})
    table = [(k, s, draw.randint(0, 1)) for k in ("a", "b") for s in stamps if draw.random() < 0.8]
    got = ranges.exact_counts_at_or_after(spark.createDataFrame(table, "k string, at timestamp_ntz, hit int"), ["k"], "at", "hit", "n_later", "total")
    totals = Counter()
    for k, _, hit in table:
        totals[k] += hit
    assert rows(got, "k", "at", "n_later", "total") == sorted(
        ((k, s, sum(h for q, u, h in table if q == k and u >= s), totals[k]) for k, s, _ in table), key=str)


@pytest.mark.parametrize("closed,expected", [("both", 3), ("left", 2), ("right", 2), ("neither", 1)])
def test_interval_ends(spark, closed, expected):
    spine = spark.createDataFrame([("a", d("2024-01-01"))], "k string, start date")
    facts = spark.createDataFrame([("a", d(x)) for x in ("2024-04-29", "2024-04-30", "2024-05-05", "2024-05-30", "2024-05-31")], "who string, at date")
    start = F.col("start")
    found = ranges.window_counts(spine, facts, "k", "who", {"all": (F.col("at"), F.lit(True))}, {"n": ("all", F.date_add(start, 120), F.date_add(start, 150), closed)})
    assert found.first()["n"] == expected
    with pytest.raises(ValueError):
        ranges.inside(F.col("a"), F.col("b"), F.col("c"), "open")


def test_unknown_balance_can_count_as_nothing(spark):
    mart = spark.createDataFrame([("1", 0, 0, None, 500.0), ("2", 0, 0, None, None), ("3", 0, 1, None, 500.0)],
                                 "customer_id string, tx int, tx_cnt_active_loans_end_4m int, tx_tsa_balance_4m double, tx_stash_balance_4m double")
    got = mart.select("customer_id", fl.flag(fl.active("4m", "tx", unknown=0.0)).alias("a"))
    assert rows(got, "customer_id", "a") == [("1", 1), ("2", 0), ("3", 0)]


def test_default_counts_filter_both_tables(spark, data):
    c = Context(spark, data)
    with settings(spark, **NO_BROADCAST):
        text = plan(fl.default_counts(c.role("behaviour_mart"), c.role("loans"), c.role("loan_buckets"), c.role("delinquency"), c.p))
    # one for delinquency, one for the buckets, whose pairs hold the first one again
    assert text.count("LeftSemi") == 3
