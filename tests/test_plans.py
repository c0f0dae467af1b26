"""Feature plans: invariants on the driver tables, edge cases and a heavy customer on made frames."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from bindings import behaviour, campaigns as cb, snapshots, targets
from bindings.registry import Context, PARAMS
from clientlens.operators import sinks
from clientlens.plans import balances as ba, campaigns as ca, channels as ch, demographics as de, devices as dv, flags as fl, products as pr, transactions as tx
from clientlens.plans.demographics import DEMOGRAPHIC_SCHEMA
from clientlens.sources import readers, standins
from tests.test_operators import d, rows, t


@pytest.fixture(scope="module")
def c(spark, data):
    return Context(spark, data)


def unique(df, *keys):
    return df.groupBy(*keys).count().filter("count > 1").isEmpty()


def test_marts_have_one_row_per_customer(c):
    for df, key in ((behaviour.behaviour_mart(c), "customer_id"), (cb.campaign_mart(c), "customer_id"), (cb.event_mart(c), "cust_id"),
                    (cb.location_mart(c), "customer_id"), (snapshots.demographic_table(c), "cust_id"), (targets.flags(c), "customer_id")):
        assert unique(df, key)


def test_snapshot_keeps_the_cohort(c):
    table = snapshots.demographic_table(c)
    assert table.count() == snapshots.members(c).count()
    assert sinks.to_schema(table, DEMOGRAPHIC_SCHEMA).columns == table.columns and len(table.columns) == 60


def test_device_mart_fits_its_schema(c):
    mart = snapshots.device_mart(c)
    assert mart.columns == dv.device_schema(c.p).fieldNames()


def test_sub_type_counts_stay_below_the_total(c):
    totals = tx.transaction_totals(tx.classified(behaviour.base(c), c.p), c.p)
    parts = [n for n in totals.columns if n.startswith("cnt_")]
    assert totals.filter(F.greatest(*parts) > F.col("total_transactions")).isEmpty()
    assert not totals.isEmpty()


def test_flags_are_null_exactly_for_ineligible_products(c):
    flags = targets.flags(c)
    for products, names in ((fl.CHURN_PRODUCTS, ["tx_Churn_flag_4m", "tx_Churn_flag_5m"]), (fl.DEFAULT_PRODUCTS, ["tx_FSPD30_4m", "tx_FSPD30_5m"]),
                            (fl.LOAN_PRODUCTS, ["tx_loanApplicationflag_4m", "tx_loanApplicationflag_5m", "tx_loanApprovedflag_5m"])):
        fits = F.col("tx_first_product").isin(*products)
        for n in names:
            assert flags.filter(fits != F.col(n).isNotNull()).isEmpty()
            assert flags.filter(F.col(n).isNotNull() & ~F.col(n).isin(0, 1)).isEmpty()
    assert flags.filter(F.col("tx_Churn_flag_4m") + F.col("tx_mau4m_active") != 1).isEmpty()


P = replace(PARAMS, cohort_from="2024-01-01", cohort_to="2024-01-31", obs_from="2024-01-01", obs_to="2024-07-01")
TX = ("transaction_id string, customer_id string, accountid string, transaction_date date, transaction_code string, status string, channel string, "
      "credit_debit_indicator string, inter_exter_flag string, account_type string, trx_amount decimal(18,2), core_narration string")


def bank(spark, transactions):
    people = spark.createDataFrame([("1", t("2024-01-05T10:00:00"), "SKYC"), ("2", t("2024-03-05T10:00:00"), "SKYC")],
                                   "cust_id string, created_dt timestamp_ntz, kyc_status string")
    accounts = spark.createDataFrame([("1", "608", t("2024-01-06T00:00:00"), "N", "current", "Bank Account"), ("1", "900", t("2024-02-01T00:00:00"), "N", "savings", "Group Stash")],
                                     "ubcustomercode string, accountid string, opendate timestamp_ntz, closed string, productid string, accountdescription string")
    return tx.cohort_transactions(spark.createDataFrame(transactions, TX), accounts, people, P)


def one(i, day, code="N01", who="1", account="608", status="Success", channel="App", direction="CREDIT", side="Outside Bank", kind="Bank Account",
        amount="100.00", text="Top up"):
    from decimal import Decimal
    return (str(i), who, account, d(day), code, status, channel, direction, side, kind, Decimal(amount), text)


def test_overlapping_rules_count_a_transaction_once(spark):
    # a card payment through another channel to the outside is both a card use and a transfer out
    base = bank(spark, [one(1, "2024-02-01", code="A01", direction="DEBIT"), one(1, "2024-02-01", code="A01", direction="DEBIT"),
                        one(2, "2024-02-03", text=None), one(3, "2024-02-04", text="BLOCKING fee"), one(4, "2024-02-05", status="Failed"),
                        one(5, "2024-02-06", who="2"), one(6, "2024-12-31")])
    found = tx.classified(base, P)
    assert rows(found, "transaction_id", "sub_transaction_type") == [("1", "Card Transactions (Cash Out)"), ("1", "TSA to Outside Bank (Other Banks)")]
    total = tx.transaction_totals(found, P).first()
    assert (total["total_transactions"], total["cnt_cash_out_total"], total["amt_cash_out_total"], total["amt_cash_in_total"]) == (1, 1, 200.0, None)


def test_first_product_prefers_the_account_on_a_tie(spark):
    base = bank(spark, [one(1, "2024-02-01", code="BP1"), one(2, "2024-02-01", account="900", kind="Group Stash")])
    assert rows(tx.first_product(base, P), "first_product", "first_product_user_segment") == [("Group Stash", "Deposit Users")]
    ghost = bank(spark, [one(1, "2024-02-01", code="Z9")])
    assert rows(tx.first_product(ghost, P), "first_product", "first_product_user_segment") == [("Unknown", "Ghost Users")]


EVENTS = "customer_id long, event_time timestamp_ntz, event_name string, event_code string, campaign_name string, campaign_channel string, clicked string"


def test_click_before_impression_drops_the_impression(spark):
    p = replace(P, obs_from="2024-01-01")
    shown, clicked = "Notification Sent iOS", "Notification Clicked iOS"
    events = spark.createDataFrame([
        (1, t("2024-01-02T10:00:00"), shown, "v", "n", "PUSH", None), (1, t("2024-01-02T10:00:05"), clicked, "c", "n", "PUSH", None),
        (1, t("2024-01-03T10:00:00"), shown, "v", "n", "PUSH", None),   # only earlier clicks: dropped
        (1, t("2024-01-03T10:00:00"), shown, "v", "n", "SMS", None),    # no click on this channel: kept
        (2, t("2024-01-03T10:00:00"), shown, "v", "m", "PUSH", None)], EVENTS)
    groups = spark.createDataFrame([("n", None), ("m", "Any Activity")], "campaign_name string, campaign_group string")
    got = ca.funnel(ca.campaign_base(events, groups, p))
    assert rows(got, "customer_id", "campaign", "campaign_channel", "n_clicks", "n_pairs") == [
        (1, "n", "PUSH", 1, 1), (1, "n", "SMS", 0, 1), (2, "Any Activity", "PUSH", 0, 1)]


def test_heavy_customer_funnel_equals_brute_force(spark):
    """One customer, campaign and channel holds most events; many share a second and a minute."""
    n = 4000
    heavy = F.col("id") % 3 != 0
    stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast((id * 7919) % 20000 as decimal(18,6)))")
    events = spark.range(n).select(
        F.when(heavy, 1).otherwise(F.col("id") % 40).cast("long").alias("customer_id"), stamp.alias("event_time"),
        F.when(F.col("id") % 5 < 3, "SMS Sent").otherwise("Notification Clicked iOS").alias("event_name"), F.lit("x").alias("event_code"),
        F.lit("n").alias("campaign_name"), F.when(heavy, "PUSH").otherwise("SMS").alias("campaign_channel"), F.lit(None).cast("string").alias("clicked"))
    groups = spark.createDataFrame([("n", None)], "campaign_name string, campaign_group string")
    got = ca.funnel(ca.campaign_base(events, groups, P))
    frame = events.toPandas()  # the fixture itself, for the brute force
    con = duckdb.connect()
    con.register("e", frame)
    brute = con.execute("""
        SELECT a.customer_id, a.t, count(b.t), count(*) FROM (SELECT DISTINCT customer_id, campaign_channel, event_time AS t FROM e WHERE event_name = 'SMS Sent') a
        LEFT JOIN (SELECT DISTINCT customer_id, campaign_channel, event_time AS t FROM e WHERE event_name LIKE '%Clicked%') b
        USING (customer_id, campaign_channel) WHERE a.t <= b.t OR b.t IS NULL GROUP BY ALL""").fetchall()
    mine = [(r["customer_id"], r["impression_time"], r["n_clicks"], r["n_pairs"]) for r in got.collect()]
    assert sorted(mine) == sorted(brute)


def test_heavy_customer_totals_and_gaps_equal_brute_force(spark):
    codes = F.element_at(F.array(*[F.lit(x) for x in ("N01", "A01", "BP1", "P01")]), (F.col("id") % 4 + 1).cast("int"))
    moves = spark.range(3000).select(
        (F.col("id") % 2900).cast("string").alias("transaction_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 2).otherwise(1).cast("string").alias("customer_id"),
        F.expr("date_add(date'2024-01-01', cast((id * 31) % 170 as int))").alias("transaction_date"), codes.alias("transaction_code"),
        F.when(F.col("id") % 2 == 0, "CREDIT").otherwise("DEBIT").alias("credit_debit_indicator"))
    rows_in = moves.withColumns({"main_transaction_type": F.when(F.col("credit_debit_indicator") == "CREDIT", tx.NET_CASH_IN).otherwise(tx.NET_CASH_OUT),
                                 "sub_transaction_type": F.lit("Bills Pay"), "trx_amount": F.lit(1).cast("decimal(18,2)")})
    con = duckdb.connect()
    con.register("r", rows_in.drop("trx_amount").toPandas())
    brute = con.execute("""
        SELECT customer_id, avg(g), quantile_cont(g, 0.5) FROM (
            SELECT customer_id, datediff('day', transaction_date, lead(transaction_date) OVER (PARTITION BY customer_id ORDER BY transaction_date)) AS g
            FROM (SELECT DISTINCT customer_id, transaction_date, main_transaction_type FROM r)) GROUP BY 1""").fetchall()
    mine = [(r["customer_id"], r["avg_days_bt_trans"], r["med_days_bt_trans"]) for r in tx.transaction_gaps(rows_in).collect()]
    assert sorted(mine) == sorted(brute)
    counts = con.execute("SELECT customer_id, count(DISTINCT transaction_id) FROM r GROUP BY 1").fetchall()
    assert sorted(counts) == rows_of(tx.transaction_totals(rows_in, P), "customer_id", "total_transactions")


def rows_of(df, *columns):
    return sorted(tuple(r[x] for x in columns) for r in df.collect())


def test_channel_rules_in_order(spark):
    cases = [("social_x", None, None, "Social"), (None, None, "Refer me", "FWB"), ("invalid_media_source_name", None, None, "Invalid Media Source"),
             ("Restricted", None, None, "Ads_Meta"), (None, None, None, "Organic"), ("None", None, None, "Broken OneLink"),
             ("Bank_CPA_9", None, None, "Aff_Pokkt"), ("ta_bank_aos_ph", None, None, "Aff_TyrAds"), (None, "vivo", None, "Aff_Vivo"), ("x", None, None, "x")]
    df = spark.createDataFrame(cases, "m string, p string, c string, expected string")
    got = df.withColumn("got", ch.acquisition_channel(F.col("m"), F.col("p"), F.col("c"), P))
    assert got.filter("got <> expected").isEmpty()
    groups = got.select(ch.channel_group(F.col("got"), P).alias("g")).collect()
    assert [r["g"] for r in groups] == ["Organic", "Direct", None, "Direct", "Organic", "Others", "Affiliates", "Affiliates", "Affiliates", None]


def test_deposit_only_keeps_late_and_never_borrowers(spark):
    people = spark.createDataFrame([(k, "TSA1.0", t("2024-01-05T10:00:00")) for k in "1234"], "cust_id string, product string, created_dt timestamp_ntz")
    loans = spark.createDataFrame([(1, "L1", "Quick", "APPLIED", t("2024-04-04T00:00:00")), (2, "L2", "Quick", "APPLIED", t("2024-04-03T00:00:00")),
                                   (3, "L3", "Quick", "APPLIED", t("2023-01-01T00:00:00"))],
                                  "customerId long, digitalLoanAccountId string, new_loan_type string, applicationStatus string, startApplyDateTime timestamp_ntz")
    held = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "client_id string")
    assert rows(ba.deposit_only(people, loans, held, P), "cust_id") == [("1",), ("3",)]


def test_empty_app_arrays_and_late_dumps(spark):
    devices = spark.createDataFrame([("1", "SKYC", "D1", d("2024-05-04"), "s"), ("2", None, "D2", d("2024-05-04"), "s"), ("3", None, "D1", d("2024-05-02"), "s")],
                                    "cust_id string, kycStatus string, deviceId string, day_120 date, fraudScore string")
    app = "array<struct<package_name:string,first_install_time:timestamp_ntz>>"
    early, late = t("2024-05-03T00:00:00"), t("2024-06-01T00:00:00")
    apps = spark.createDataFrame([("D1", early, [("a.b", t("2024-01-02T00:00:00")), ("a.b", t("2024-01-01T00:00:00"))]), ("D1", late, [("c.d", t("2023-01-01T00:00:00"))]),
                                  ("D2", early, []), ("D3", early, [("x.y", early)])], f"deviceId string, run_date timestamp_ntz, Application {app}")
    owned = dv.device_packages(apps, devices)
    assert rows(owned, "deviceId", "package_name", "first_install_time") == [("D1", "a.b", t("2024-01-01T00:00:00")), ("D1", "c.d", t("2023-01-01T00:00:00"))]
    # the later dump counts for nobody, the earlier one only for the customer whose day 120 it precedes
    assert rows(dv.customer_packages(devices, owned, P), "cust_id", "package_name") == [("1", "a.b")]
    assert rows(dv.earliest_install(devices, owned, P), "cust_id", "first_install_time") == [("1", t("2024-01-01T00:00:00"))]
    dump = spark.createDataFrame([("D1", late, ("b",), ("b", "m", "x"), ("o", "1", "s"))],
                                 "deviceId string, run_date timestamp_ntz, GeneralInfo struct<brand:string>, "
                                 "Hardware struct<device__brand:string,device__manufacturer:string,device__model:string>, "
                                 "GeneralData struct<telephony_info__network_operator_name:string,telephony_info__network_operator:string,sim_operator_name:string>")
    assert rows(dv.device_snapshot(devices, dump, owned, P), "cust_id", "run_date") == rows(dv.device_snapshot(devices, dump, dv.equipped(apps), P), "cust_id", "run_date") == [("1", None), ("3", None)]


def test_unlisted_categories_are_counted(spark):
    apps = spark.createDataFrame([("1", "a", "card", "rated for 3+", "free"), ("1", "b", "games", "rated for 12+", None), ("1", "c", "games", None, "gift"), ("2", "d", "Others", None, None)],
                                 "cust_id string, package string, category string, rating string, is_paid string")
    got = {r["cust_id"]: r for r in dv.app_counts(apps).collect()}
    assert (got["1"]["cl_pkg_card"], got["1"]["unlisted_category"], got["1"]["unlisted_rating"], got["1"]["unlisted_price"]) == (1.0, 2, 1, 1)
    assert sum(got["1"][dv.published_name(c)] for c in dv.category_columns()) + got["1"]["unlisted_category"] == 3
    assert got["2"]["unlisted_category"] == 0


def test_dumps_after_the_last_cutoff_go_before_packages_are_grouped(spark):
    devices = spark.createDataFrame([("1", "D1", d("2024-05-04")), ("2", "D1", d("2024-05-10")), ("3", "D2", d("2024-05-04"))], "cust_id string, deviceId string, day_120 date")
    app = "array<struct<package_name:string,first_install_time:timestamp_ntz>>"
    apps = spark.createDataFrame([(k, t(f"2024-05-{day}T00:00:00"), [(f"p{day}", t("2024-01-01T00:00:00"))] if day != "03" else []) for k in ("D1", "D2", "D3")
                                  for day in ("03", "04", "10", "11")], f"deviceId string, run_date timestamp_ntz, Application {app}")
    every, early = dv.device_packages(apps, devices), dv.device_packages(apps, devices, P)
    assert rows(early, "deviceId", "package_name") == [("D1", "p04"), ("D1", "p10"), ("D2", "p04")]
    mine = dv.customer_packages(devices, early, P)
    assert rows(mine, "cust_id", "package_name") == rows(dv.customer_packages(devices, every, P), "cust_id", "package_name") == [("1", "p04"), ("2", "p04"), ("2", "p10"), ("3", "p04")]
    assert rows(dv.earliest_install(devices, mine, P), *mine.columns[::2]) == rows(dv.earliest_install(devices, every, P), *mine.columns[::2])


def test_latest_dump_is_chosen_before_the_mart(spark, data):
    """Also among several scores and states of a customer, BKYC ones included, and ties in the time of the dump."""
    c = Context(spark, data)
    first = snapshots.tracked(c).filter("cast(cust_id AS int) % 3 = 0")
    again = [first.withColumns({"kycStatus": F.lit(k), "fraudScore": F.lit(s), "day_120": F.lit(d("2030-01-01"))}) for k, s in (("BKYC", "0"), (None, "5"), ("SKYC", None))]
    devices = snapshots.tracked(c).unionByName(again[0]).unionByName(again[1]).unionByName(again[2]).withColumn("day_120", F.lit(d("2030-01-01")))
    dump = snapshots.dump(c).withColumn("run_date", F.date_trunc("year", "run_date").cast("timestamp_ntz"))
    apps, none = dv.equipped(snapshots.inventories(c)), spark.createDataFrame([], "cust_id string, first_install_time timestamp_ntz")
    counts = dv.app_counts(snapshots.categorised(c))
    late = dv.latest_dump(dv.device_mart(dv.device_snapshot(devices, dump, apps, P), none, counts, P))
    soon = dv.device_mart(dv.latest_snapshot(devices, dump, apps, P), none, counts, P)
    assert late.columns == soon.columns and soon.count() == late.count() > 50
    assert late.exceptAll(soon).isEmpty() and soon.exceptAll(late).isEmpty()
    assert unique(soon, "cust_id")


def test_only_final_statuses_of_deposits_move(spark):
    accounts = spark.createDataFrame([(k, "1", "fixdep", t("2024-01-05T00:00:00"), None, "Time Deposit - 6 months") for k in "abcd"],
                                     "accountid string, ubcustomercode string, productid string, opendate timestamp_ntz, closuredate timestamp_ntz, accountdescription string")
    balances = spark.createDataFrame([(k, "Time Deposit - 6 months", t("2023-12-31T00:00:00"), 150) for k in "abcd"],
                                     "accountid string, account_type string, balancedateasof timestamp_ntz, clearedbalance int").withColumn("clearedbalance", F.col("clearedbalance").cast("decimal(18,2)"))
    statuses = spark.createDataFrame([("a", "4"), ("a", "9"), ("b", "1"), ("c", "9"), ("c", "1"), ("x", "4")], "accountid string, status string")
    held = pr.deposit_accounts(accounts, balances, statuses, P)
    assert rows(held, "accountid", "td_completed", "td_broken") == [("a", 1, 1), ("b", 0, 0), ("c", 0, 1), ("d", 0, 0)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and [x for x in plan.split("\n") if "Filter" in x and "status" in x]
    got = pr.deposit_metrics(held, P).collect()[0]
    assert (got.deposit_accnt_cnt, got.td_accnt_opened_cnt, got.td_accnt_completed_cnt, got.td_accnt_broken_cnt, got.td_active_cnt, got.td_balance) == (4, 4, 1, 2, 2, 600.0)


def test_deposits_move_days_and_bits_only(spark):
    accounts = spark.createDataFrame(
        [("a", "1", "savings", t("2024-01-05T09:00:00"), t("2024-03-01T00:00:00"), "Group Stash"), ("a", "1", "savings", t("2024-01-09T09:00:00"), None, "Individual Stash"),
         ("b", "1", "fixdep", t("2024-01-05T00:00:00"), t("2025-03-01T00:00:00"), "Time Deposit - 6 months"), ("c", "1", "fixdep", t("2024-01-07T00:00:00"), None, None),
         ("d", "1", "fixdep", t("2024-01-07T00:00:00"), t("2024-02-01T00:00:00"), "Time Deposit - 6 months")],
        "accountid string, ubcustomercode string, productid string, opendate timestamp_ntz, closuredate timestamp_ntz, accountdescription string")
    balances = spark.createDataFrame([(k, "Any", t("2023-12-31T00:00:00"), n) for k, n in (("a", 150), ("b", 99), ("c", 500), ("d", 100))],
                                     "accountid string, account_type string, balancedateasof timestamp_ntz, clearedbalance int").withColumn("clearedbalance", F.col("clearedbalance").cast("decimal(18,2)"))
    held = pr.deposit_accounts(accounts, balances, spark.createDataFrame([("d", "4")], "accountid string, status string"), P)
    days = pr.deposit_days(held, P)
    assert not {"opendate", "closuredate", "account_type", "accountid"} & set(days.columns) and days.count() == 5
    # the account listed twice counts once, in all that it ever was; one without a description counts in no kind
    got = pr.deposit_metrics(held, P).collect()
    assert [tuple(r) for r in got] == [("1", 4, 1, 1, 2, 1, 0, 1, 1, 1, 0, 300.0, 100.0, 1.0, 2.0)]
    moved = pr.deposit_metrics(held, P)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" in moved and moved.count("Exchange hashpartitioning(customer_id") == 2


def test_dumps_after_the_last_cutoff_do_not_move(spark, c):
    devices, dump, apps = snapshots.tracked(c), snapshots.dump(c), dv.equipped(snapshots.inventories(c))
    last = devices.agg(F.max("day_120")).first()[0]
    later = dump.limit(5).withColumn("run_date", F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL '3' DAY"))
    plain, more = dv.latest_snapshot(devices, dump, apps, c.p), dv.latest_snapshot(devices, dump.unionByName(later), apps, c.p)
    assert plain.count() == more.count() > 50 and plain.exceptAll(more).isEmpty()
    assert "scalar-subquery" in plain._jdf.queryExecution().optimizedPlan().toString()


def test_roles_of_stored_lines_have_the_same_rows(spark, data):
    tables = readers.Tables(spark, data)
    lines = standins.order_lines(tables)
    for name in standins.OF_LINES:
        plain, shared = standins.role(tables, name), standins.role(tables, name, lines)
        assert shared.schema == plain.schema and not plain.isEmpty()
        assert shared.exceptAll(plain).isEmpty() and plain.exceptAll(shared).isEmpty()


def test_modelling_table_joins_lines_with_orders_once(spark, data):
    c = Context(spark, data)
    targets.modelling_table(c)
    assert {"cohort-transactions", "order-lines", "device-rows", "customer-packages"} <= set(c.stages)
    for name in standins.OF_LINES:
        if name in c.roles and name != "device_rows":
            assert "orders.parquet" not in "".join(c.roles[name].inputFiles())


def test_modelling_table_has_one_row_per_eligible_customer(spark, data):
    c = Context(spark, data)
    table = targets.modelling_table(c)
    eligible = targets.flags(c).filter(F.col("tx_first_product").isin(*fl.LOAN_PRODUCTS)).count()
    assert table.count() == eligible == table.select("customer_id").distinct().count()
    assert {x.split("_")[0] for x in table.columns} >= {"de", "meng", "cl", "tx"}
    assert table.filter(F.col("first_product") != F.col("tx_first_product")).isEmpty()


def test_snapshot_rerun_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    df = spark.createDataFrame([(i, f"2024-02-{1 + i % 3:02d}") for i in range(30)], "id int, day string")
    for part in (df, df.filter("day = '2024-02-02' AND id < 20"), df.filter("day = '2024-02-03'")):
        sinks.write_snapshot(part, path, ["day"])
    assert spark.read.parquet(path).groupBy("day").count().orderBy("day").collect() == [(d("2024-02-01"), 10), (d("2024-02-02"), 7), (d("2024-02-03"), 10)]


def test_a_value_that_does_not_fit_fails_the_load(spark, tmp_path):
    from pyspark.errors import PySparkException
    from pyspark.sql import types as T
    df = spark.createDataFrame([("1", "two")], "a string, b string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    with pytest.raises(PySparkException):
        sinks.write_typed(df, schema, str(tmp_path / "t"))
    sinks.save_typed(df, schema, "typed_by_name", coerce=["b"])
    assert spark.table("typed_by_name").collect() == [(1, None)]


def test_csv_keeps_quotes_and_refuses_broken_lines(spark, tmp_path):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    df = spark.createDataFrame([('5" screen, new', "a\nb", ""), ('"', None, "x")], "a string, b string, c string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(readers.read_csv(spark, str(tmp_path / "c"), df.schema, line_breaks=True).collect()) == sorted(df.collect())
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED"):
        readers.read_csv(spark, str(tmp_path / "c"), df.schema).collect()
    numbers = spark.createDataFrame([(1, None, ""), (None, 2.5, None)], "n int, x double, t string")
    sinks.write_csv(numbers, str(tmp_path / "n"))
    assert set(readers.read_csv(spark, str(tmp_path / "n"), numbers.schema).collect()) == set(numbers.collect())


def test_rename_sheet_is_checked(spark):
    sheet = lambda *lines: spark.createDataFrame(lines, "o string, n string")
    assert readers.rename_map(sheet(("a", "b"), ("z", "y")), "o", "n", ["a"]) == {"a": "b"}
    for bad in (sheet(("a", "b"), ("a", "c")), sheet(("a", None)), sheet((None, "b"))):
        with pytest.raises(ValueError):
            readers.rename_map(bad, "o", "n", ["a"])


def test_unknown_balance_is_not_active(spark):
    mart = spark.createDataFrame([("1", 0, 0, None, 500.0), ("2", 0, 0, 60.0, 40.0), ("3", 1, 1, 60.0, 400.0), ("4", 1, 0, None, None)],
                                 "customer_id string, tx int, tx_cnt_active_loans_end_4m int, tx_tsa_balance_4m double, tx_stash_balance_4m double")
    got = mart.select("customer_id", fl.flag(fl.active("4m", "tx")).alias("a"))
    assert rows(got, "customer_id", "a") == [("1", 0), ("2", 1), ("3", 0), ("4", 1)]


def test_no_clock_in_the_library():
    import pathlib
    import re
    root = pathlib.Path(__file__).parent.parent / "clientlens"
    for f in root.rglob("*.py"):
        assert not re.search(r"current_date|current_timestamp|\bnow\(|toPandas|localCheckpoint|crossJoin", f.read_text()), f


def test_education_moves_once_per_loan(spark):
    """The highest level of a loan is found before anything but its id moves; names follow by level, ties and missing ones included."""
    lookup = spark.createDataFrame([("1", "school", "Education"), ("2", "b", "Education"), ("2", "a", "Education"), ("2", "a", "Education"),
                                    ("3", None, "Education"), ("3", "z", "Education"), ("9", "car", "Purpose")], "id string, description string, module string")
    education = spark.createDataFrame([("L1", "1"), ("L1", "2"), ("L1", "2"), ("L1", "9"), ("L2", "1"), ("L3", "3"), ("L4", "9"), (None, "3")],
                                      "digitalLoanAccountId string, education_id string")
    loans = spark.createDataFrame([(1, "L1"), (1, "L2"), (2, "L2"), (3, "L3"), (4, "L4"), (5, "L1"), (None, "L1")], "customerId bigint, digitalLoanAccountId string")
    cohort = spark.createDataFrame([(str(i),) for i in (1, 2, 3, 4)], "cust_id string")
    best = de.highest_education(education, lookup, loans, cohort)
    columns = ("customerId", "education_id", "Education_Type")
    assert rows(best, *columns) == sorted([(1, "2", "a"), (2, "1", "school"), (3, "3", None)], key=str)
    tied = de.highest_education_with_ties(education, lookup, loans)
    assert rows(tied, *columns) == sorted([*[(k, "2", n) for k in (1, 5, None) for n in ("a", "b")], (2, "1", "school"), (3, "3", None), (3, "3", "z")], key=str)
    per_loan = de.highest_per_loan(education, de.education_levels(lookup))
    assert per_loan.columns == ["digitalLoanAccountId", "education_id"]
    for df in (best, tied):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [digitalLoanAccountId" in plan
        assert not [x for x in plan.split("\n") if "Window" in x and "digitalLoanAccountId" in x]
