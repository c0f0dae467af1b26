"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Context, query
from clientlens.functions import scalars as sc
from clientlens.functions.rules import flag
from clientlens.operators import condagg as ag, dedupe, quality, ranges
from clientlens.plans import campaigns as ca, flags as fl


@query("a1_group_by", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total FROM orders GROUP BY 1, 2""")
def _(c: Context):
    return c.orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("a2_group_by_all", "SELECT l_returnflag, l_linestatus, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL")
def _(c: Context):
    return c.spark.sql("SELECT l_returnflag, l_linestatus, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY ALL", lineitem=c.lineitem)


@query("a3_count_star", "SELECT customer_id, latitude, longitude, count(*) AS frequency FROM gps GROUP BY ALL")
def _(c: Context):
    return c.role("gps").groupBy("customer_id", "latitude", "longitude").agg(F.count("*").alias("frequency"))


@query("a4_count_non_null", "SELECT customerId, count(decision_date) AS decided, count(maritalStatus) AS with_status FROM loans GROUP BY customerId")
def _(c: Context):
    return c.role("loans").groupBy("customerId").agg(F.count("decision_date").alias("decided"), F.count("maritalStatus").alias("with_status"))


@query("a5_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def _(c: Context):
    return c.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("a6_conditional_distinct_counts", """
    SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned,
           count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS accepted,
           count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS finished,
           count(DISTINCT CASE WHEN l_quantity >= 25 THEN l_partkey END) AS bulky
    FROM lineitem GROUP BY l_suppkey""")
def _(c: Context):
    return ag.distinct_counts(c.lineitem, ["l_suppkey"], "l_partkey", total="parts", flags={
        "returned": F.col("l_returnflag") == "R", "accepted": F.col("l_returnflag") == "A",
        "finished": F.col("l_linestatus") == "F", "bulky": F.col("l_quantity") >= 25})


@query("a7_conditional_counts", """
    SELECT customer_id, count(CASE WHEN campaign_channel = 'PUSH' THEN customer_id END) AS push,
           count(CASE WHEN campaign_channel = 'EMAIL' AND event_code = 'view' THEN customer_id END) AS email_views
    FROM campaign_events GROUP BY customer_id""")
def _(c: Context):
    channel = F.col("campaign_channel")
    return c.role("campaign_events").groupBy("customer_id").agg(
        ag.count_where(channel == "PUSH").alias("push"),
        ag.count_where((channel == "EMAIL") & (F.col("event_code") == "view")).alias("email_views"))


@query("a8_sum", "SELECT accountid, cast(sum(repaymentpaid) AS double) AS repaid FROM loan_repayments GROUP BY accountid")
def _(c: Context):
    return c.role("loan_repayments").groupBy("accountid").agg(F.sum("repaymentpaid").cast("double").alias("repaid"))


@query("a9_conditional_sum", """
    SELECT customer_id, cast(sum(CASE WHEN credit_debit_indicator = 'CREDIT' THEN trx_amount END) AS double) AS paid_in,
           cast(sum(CASE WHEN channel = 'Billspay' AND transaction_code = 'BP1' THEN trx_amount END) AS double) AS bills
    FROM transactions GROUP BY customer_id""")
def _(c: Context):
    amount = F.col("trx_amount")
    return c.role("transactions").groupBy("customer_id").agg(
        ag.sum_where(F.col("credit_debit_indicator") == "CREDIT", amount).cast("double").alias("paid_in"),
        ag.sum_where((F.col("channel") == "Billspay") & (F.col("transaction_code") == "BP1"), amount).cast("double").alias("bills"))


@query("a10_existence_test", """
    SELECT customer_id, sum(CASE WHEN transaction_code IN ('BP1', 'BP2') THEN 1 ELSE 0 END) > 0 AS pays_bills FROM transactions GROUP BY customer_id""")
def _(c: Context):
    return c.role("transactions").groupBy("customer_id").agg(F.bool_or(F.col("transaction_code").isin("BP1", "BP2")).alias("pays_bills"))


@query("a11_min_when_any", """
    SELECT customer_id, min(CASE WHEN transaction_code LIKE 'A0%' THEN transaction_date END) AS first_card FROM transactions GROUP BY customer_id""")
def _(c: Context):
    return c.role("transactions").groupBy("customer_id").agg(
        ag.min_if_any(F.col("transaction_code").startswith("A0"), F.col("transaction_date")).alias("first_card"))


@query("a12_conditional_average", """
    SELECT customerId, avg(loanRequestTenure) AS tenure, avg(CASE WHEN new_loan_type = 'Quick' THEN loanRequestTenure END) AS quick_tenure
    FROM loans GROUP BY customerId""")
def _(c: Context):
    tenure = F.col("loanRequestTenure")
    return c.role("loans").groupBy("customerId").agg(
        F.avg(tenure).alias("tenure"), ag.avg_where(F.col("new_loan_type") == "Quick", tenure).alias("quick_tenure"))


@query("a13_min_time", "SELECT deviceId, min(first_install_time) AS first_install_time FROM app_rows GROUP BY deviceId")
def _(c: Context):
    from clientlens.plans import devices as dv
    from clientlens.sources import standins
    apps = dv.installed_apps(standins.device_apps(c.role("device_rows")))
    return apps.groupBy("deviceId").agg(F.min("first_install_time").alias("first_install_time"))


@query("a14_select_distinct", "SELECT DISTINCT customer_id, event_name FROM campaign_events")
def _(c: Context):
    return c.role("campaign_events").select("customer_id", "event_name").distinct()


@query("a15_redundant_distinct", """
    SELECT DISTINCT l_suppkey, quantile_cont(l_quantity, 0.5) OVER (PARTITION BY l_suppkey) AS median_quantity FROM lineitem""")
def _(c: Context):
    # values are counted first, so a median holds distinct quantities, not rows
    counted = c.lineitem.groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return counted.groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("median_quantity"))


@query("a16_aggregate_thresholds", """
    SELECT customer_id, CASE WHEN count(CASE WHEN channel = 'Billspay' THEN 1 END) >= 2
        AND count(CASE WHEN credit_debit_indicator = 'CREDIT' THEN 1 END) >= 2 AND count(*) >= 5 THEN 1 ELSE 0 END AS converted
    FROM transactions GROUP BY customer_id""")
def _(c: Context):
    enough = ((ag.count_where(F.col("channel") == "Billspay") >= 2)
              & (ag.count_where(F.col("credit_debit_indicator") == "CREDIT") >= 2) & (F.count("*") >= 5))
    return c.role("transactions").groupBy("customer_id").agg(flag(enough).cast("int").alias("converted"))


@query("a17_group_on_derived_bit", """
    SELECT customer_id, campaign, max(bit) AS converted FROM (
        SELECT f.customer_id, f.campaign, CASE WHEN l.customerId IS NOT NULL THEN 1 ELSE 0 END AS bit FROM funnel_rows f
        LEFT JOIN (SELECT customerId, max(cast(decision_date AS date)) AS last_day FROM loans WHERE new_loan_type IN ('Quick', 'Flex') GROUP BY customerId) l
               ON l.customerId = f.customer_id AND cast(f.impression_time AS date) <= l.last_day) x
    GROUP BY customer_id, campaign""")
def _(c: Context):
    rows = ca.funnel(ca.campaign_base(c.role("campaign_events"), c.role("campaign_list"), c.p))
    decided = (c.role("loans").filter(F.col("new_loan_type").isin("Quick", "Flex"))
               .groupBy(F.col("customerId").alias("customer_id")).agg(F.max(F.to_date("decision_date")).alias("last_day")))
    first = rows.groupBy("customer_id", "campaign").agg(F.min(F.to_date("impression_time")).alias("first_day"))
    return first.join(decided, "customer_id", "left").select(
        "customer_id", "campaign", flag(F.col("first_day") <= F.col("last_day")).cast("int").alias("converted"))


@query("a18_distinct_per_group", """
    SELECT device_id, count(DISTINCT cust_id) AS customers, count(DISTINCT mobile_no) AS numbers FROM customers GROUP BY device_id""")
def _(c: Context):
    return quality.keys_with_many(c.role("customers"), "device_id", ["cust_id", "mobile_no"]).select(
        "device_id", F.col("unique_cust_id_count").alias("customers"), F.col("unique_mobile_no_count").alias("numbers"))


@query("a19_value_counts", """
    SELECT kyc_status, count(*) AS n, true AS with_null FROM customers GROUP BY kyc_status
    UNION ALL SELECT kyc_status, count(*), false FROM customers WHERE kyc_status IS NOT NULL GROUP BY kyc_status""")
def _(c: Context):
    counted = c.role("customers").groupBy("kyc_status").agg(F.count("*").alias("n"))
    return counted.withColumn("with_null", F.explode(F.when(F.col("kyc_status").isNull(), F.array(F.lit(True)))
                                                     .otherwise(F.array(F.lit(True), F.lit(False)))))


@query("a20_multi_column_counts", """
    SELECT tx_mau4m_active, tx_mau5m_active, tx_first_product, count(*) AS n FROM flags_active GROUP BY ALL""")
def _(c: Context):
    return fl.active_flags(c.role("behaviour_mart")).groupBy("tx_mau4m_active", "tx_mau5m_active", "tx_first_product").agg(F.count("*").alias("n"))


@query("a21_share_of_total", """
    SELECT c_mktsegment, n, round(n * 100.0 / (SELECT count(*) FROM customer), 4) AS pct FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) x""")
def _(c: Context):
    return ag.share_of_total(c.customer, "c_mktsegment")


@query("a22_rows_at_group_maximum", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders) x WHERE o_totalprice = top""")
def _(c: Context):
    return dedupe.latest_with_ties(c.orders, ["o_custkey"], "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@query("a23_frequency_lookup", """
    SELECT cust_id, a.device_id, n AS device_rows FROM customers a JOIN (SELECT device_id, count(*) AS n FROM customers GROUP BY 1) b ON a.device_id = b.device_id""")
def _(c: Context):
    people = c.role("customers")
    counted = people.groupBy("device_id").agg(F.count("*").alias("device_rows"))
    return people.select("cust_id", "device_id").join(counted, "device_id")


@query("a24_correlated_range_count", """
    SELECT m.customer_id, (SELECT count(customerId) FROM loans WHERE customerId = cast(m.customer_id AS bigint)
        AND cast(startApplyDateTime AS date) BETWEEN cast(m.registration_date AS date) AND cast(m.registration_date AS date) + 120) AS applied
    FROM behaviour_mart m""")
def _(c: Context):
    start = F.to_date("registration_date")
    spine = fl.loan_keyed(c.role("behaviour_mart"))
    found = ranges.window_counts(spine, c.role("loans"), "_loan_key", "customerId",
                                 streams={"all": (F.col("startApplyDateTime"), F.lit(True))},
                                 windows={"applied": ("all", start, F.date_add(start, 120))})
    return ranges.with_counts(spine, found, "_loan_key").select("customer_id", "applied")


@query("a25_correlated_equality_count", """
    SELECT m.customer_id, (SELECT count(customerId) FROM loans WHERE customerId = cast(m.customer_id AS bigint)
        AND Max_Ever_DPD >= 180 AND new_loan_type IN ('Quick', 'Flex')) AS npl FROM behaviour_mart m""")
def _(c: Context):
    bad = (c.role("loans").filter((F.col("Max_Ever_DPD") >= 180) & F.col("new_loan_type").isin("Quick", "Flex"))
           .groupBy(sc.text_key(F.col("customerId")).alias("customer_id")).agg(F.count("*").alias("n")))
    return c.role("behaviour_mart").join(bad, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("npl"))


@query("a26_distinct_values", "SELECT DISTINCT p_type, (SELECT count(DISTINCT p_type) FROM part) AS n_types FROM part")
def _(c: Context):
    kinds, seen = quality.counted(c.part.select("p_type").distinct(), "distinct-types", n=F.count("p_type"))
    return kinds.withColumn("n_types", F.lit(seen["n"]).cast("bigint"))
