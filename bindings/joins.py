"""Join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Context, query
from clientlens.functions import scalars as sc
from clientlens.operators import ranges
from clientlens.operators.reshape import assemble
from clientlens.plans import campaigns as ca, devices as dv, flags as fl
from clientlens.sources import standins


@query("j1_inner_join", """
    SELECT l_orderkey, l_linenumber, o_custkey, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
def _(c: Context):
    return (c.lineitem.join(c.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "o_custkey", "s_name"))


@query("j2_left_join_chain", """
    SELECT c_custkey, n_orders, spent, n_events FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def _(c: Context):
    key = F.col("o_custkey").alias("c_custkey")
    parts = [c.orders.groupBy(key).agg(F.count("*").alias("n_orders")),
             c.orders.filter(F.col("o_orderstatus") == "F").groupBy(key).agg(F.max("o_totalprice").alias("spent")),
             c.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))]
    return assemble(c.customer.select("c_custkey"), parts, "c_custkey")


@query("j3_cast_key_join", """
    SELECT cust_id, digitalLoanAccountId FROM customers JOIN loans ON try_cast(cust_id AS bigint) = customerId""")
def _(c: Context):
    people = c.role("customers").select("cust_id", sc.number_key(F.col("cust_id")).alias("customerId"))
    return people.join(c.role("loans"), "customerId").select("cust_id", "digitalLoanAccountId")


@query("j4_case_insensitive_join", """
    SELECT user_id, hm_province, Region_name FROM customer_address a LEFT JOIN region_map b ON lower(a.hm_province) = lower(b.province)""")
def _(c: Context):
    lookup = c.role("region_map").select(F.lower("province").alias("p"), "Region_name")
    return c.role("customer_address").join(lookup, F.lower("hm_province") == F.col("p"), "left").select("user_id", "hm_province", "Region_name")


@query("j5_substring_join", """
    SELECT cust_id, g.network_group AS short_group, h.network AS long_network FROM customers
    LEFT JOIN carrier_map g ON left(right(mobile_no, length(mobile_no) - 2), 3) = cast(g.number_prefix AS varchar)
    LEFT JOIN carrier_map h ON left(right(mobile_no, length(mobile_no) - 2), 4) = cast(h.number_prefix AS varchar)""")
def _(c: Context):
    prefix = F.col("number_prefix").cast("string")
    short = c.role("carrier_map").select(prefix.alias("p3"), F.col("network_group").alias("short_group"))
    long = c.role("carrier_map").select(prefix.alias("p4"), F.col("network").alias("long_network"))
    number = F.col("mobile_no")
    return (c.role("customers").join(short, sc.phone_prefix(number, 3) == F.col("p3"), "left")
            .join(long, sc.phone_prefix(number, 4) == F.col("p4"), "left").select("cust_id", "short_group", "long_network"))


@query("j6_coalesced_key_join", """
    SELECT campaign, count(*) AS n_events FROM (
        SELECT coalesce(campaign_group, l.campaign_name) AS campaign FROM campaign_events e JOIN campaign_list l ON e.campaign_name = l.campaign_name) x
    JOIN (SELECT DISTINCT coalesce(campaign_group, campaign_name) AS label FROM campaign_list) y ON x.campaign = y.label GROUP BY campaign""")
def _(c: Context):
    label = F.coalesce("campaign_group", "campaign_name").alias("campaign")
    # events shrink to one count per campaign before any join
    counted = c.role("campaign_events").groupBy("campaign_name").agg(F.count("*").alias("n"))
    named = counted.join(c.role("campaign_list"), "campaign_name").select(label, "n")
    return named.groupBy("campaign").agg(F.sum("n").alias("n_events")).join(
        c.role("campaign_list").select(label).distinct(), "campaign")


@query("j7_range_left_join", """
    SELECT a.event_id, count(b.transaction_id) AS n_later FROM campaign_events a
    LEFT JOIN transactions b ON cast(a.customer_id AS varchar) = b.customer_id AND cast(a.event_time AS date) <= b.transaction_date
    GROUP BY a.event_id""")
def _(c: Context):
    seen = c.role("campaign_events").select("event_id", sc.text_key(F.col("customer_id")).alias("customer_id"), "event_time")
    return ranges.count_on_or_after(seen, c.role("transactions"), ["customer_id"], "event_time", "transaction_date",
                                    "n_later").select("event_id", "n_later")


@query("j8_left_join_then_filter", """
    SELECT customer_id, campaign, campaign_channel, impression_time, n_pairs FROM funnel_rows""")
def _(c: Context):
    base = ca.campaign_base(c.role("campaign_events"), c.role("campaign_list"), c.p)
    return ca.funnel(base).select("customer_id", "campaign", "campaign_channel", "impression_time", "n_pairs")


@query("j9_as_of_cutoff_join", """
    SELECT b.cust_id, t.refno, t.createdOn FROM cohort b JOIN customer_details d ON d.custId = b.cust_id
    JOIN device_track t ON d.deviceRef = t.refno AND cast(t.createdOn AS date) <= b.day_120""")
def _(c: Context):
    from clientlens.plans.cohort import cohort
    spine = cohort(c.role("customers"), c.p).join(
        c.role("customer_details").select(F.col("custId").alias("cust_id"), F.col("deviceRef").alias("refno")), "cust_id")
    return ranges.as_of_cutoff(spine, c.role("device_track"), "refno", "createdOn", "day_120").select("cust_id", "refno", "createdOn")


@query("j10_constant_range_join", """
    WITH params AS (SELECT DATE '1996-01-01' AS start_date, DATE '1996-12-31' AS end_date)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN params p ON cast(l_shipdate AS date) BETWEEN p.start_date AND p.end_date""")
def _(c: Context):
    return c.lineitem.filter(sc.on_or_between(F.col("l_shipdate"), "1996-01-01", "1996-12-31")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("j11_semi_join", """
    SELECT customer_id, latitude, longitude FROM gps WHERE try_cast(customer_id AS bigint) IN (SELECT cust_key FROM customers WHERE kyc_status = 'SKYC')""")
def _(c: Context):
    members = c.role("customers").filter(F.col("kyc_status") == "SKYC").select(F.col("cust_id").alias("customer_id"))
    return c.role("gps").join(members, "customer_id", "left_semi").select("customer_id", "latitude", "longitude")


@query("j12_preaggregated_join", """
    SELECT digitalLoanAccountId, cast(repaid AS double) AS repaid FROM loans
    LEFT JOIN (SELECT accountid, sum(repaymentpaid) AS repaid FROM loan_repayments GROUP BY accountid) r ON r.accountid = loanAccountNumber""")
def _(c: Context):
    paid = c.role("loan_repayments").groupBy(F.col("accountid").alias("loanAccountNumber")).agg(F.sum("repaymentpaid").cast("double").alias("repaid"))
    return c.role("loans").join(paid, "loanAccountNumber", "left").select("digitalLoanAccountId", "repaid")


@query("j13_three_table_count", """
    SELECT m.customer_id, (
        SELECT count(l.customerId) FROM loan_buckets b JOIN loans l ON l.loanAccountNumber = b.loanAccountNumber
        JOIN delinquency d ON d.loanAccountNumber = l.loanAccountNumber
        WHERE l.customerId = cast(m.customer_id AS bigint) AND b.bucketDate = cast(m.registration_date AS date) + 120
          AND d.min_inst_def30 IN (1, 2) AND l.new_loan_type IN ('Quick', 'Flex')) AS fspd304m
    FROM behaviour_mart m""")
def _(c: Context):
    mart = c.role("behaviour_mart")
    found = fl.default_counts(mart, c.role("loans"), c.role("loan_buckets"), c.role("delinquency"), c.p)
    return ranges.with_counts(fl.loan_keyed(mart), found, "_loan_key").select("customer_id", "fspd304m")


@query("j14_lateral_unnest", "SELECT deviceId, package_name, first_install_time FROM app_rows")
def _(c: Context):
    return dv.installed_apps(standins.device_apps(c.role("device_rows"))).select("deviceId", "package_name", "first_install_time")


@query("j15_frame_merge", """
    SELECT c_custkey, c_nationkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(c: Context):
    return (c.customer.join(c.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(c.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_nationkey", "n_name", "r_name"))


@query("j16_full_outer_merge", """
    SELECT coalesce(a.package, b.package) AS package, a.n_devices, b.category FROM
        (SELECT regexp_replace(package_name, '[ ._]', '', 'g') AS package, count(DISTINCT deviceId) AS n_devices FROM app_rows GROUP BY 1) a
    FULL JOIN (SELECT regexp_replace(package_name, '[ ._]', '', 'g') AS package, category FROM app_catalogue) b ON a.package = b.package""")
def _(c: Context):
    used = (dv.installed_apps(standins.device_apps(c.role("device_rows")))
            .select(sc.normalised_package(F.col("package_name")).alias("package"), "deviceId").distinct()
            .groupBy("package").agg(F.count("deviceId").alias("n_devices")))
    listed = c.role("app_catalogue").select(sc.normalised_package(F.col("package_name")).alias("package"), "category")
    return used.join(listed, "package", "full_outer").select("package", "n_devices", "category")


@query("j17_merge_then_range", """
    SELECT DISTINCT m.customer_id FROM behaviour_mart m JOIN loans l ON m.customer_id = cast(l.customerId AS varchar)
    WHERE l.startApplyDateTime >= m.registration_date AND l.startApplyDateTime <= m.registration_date + INTERVAL 120 DAY""")
def _(c: Context):
    mart = c.role("behaviour_mart").select("customer_id", "registration_date")
    applied = c.role("loans").select(sc.text_key(F.col("customerId")).alias("who"), F.col("startApplyDateTime").alias("at"))
    until = F.col("registration_date") + F.make_dt_interval(F.lit(120))
    hit = (F.col("customer_id") == F.col("who")) & F.col("at").between(F.col("registration_date"), until)
    return mart.join(applied, hit, "left_semi").select("customer_id").distinct()


@query("j18_left_join_made_inner", """
    SELECT c.cust_id, a.transaction_id FROM customers c LEFT JOIN transactions a ON a.customer_id = c.cust_id
    JOIN accounts b ON a.customer_id = b.ubcustomercode AND a.accountid = b.accountid WHERE a.status = 'Success'""")
def _(c: Context):
    good = c.role("transactions").filter(F.col("status") == "Success").select("transaction_id", "customer_id", "accountid")
    owned = c.accounts.select(F.col("ubcustomercode").alias("customer_id"), "accountid")
    people = c.role("customers").select(F.col("cust_id").alias("customer_id"))
    return good.join(owned, ["customer_id", "accountid"]).join(people, "customer_id").select(
        F.col("customer_id").alias("cust_id"), "transaction_id")
