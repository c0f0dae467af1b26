"""Windows, ordering, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from bindings.registry import Context, query, view
from clientlens.operators import dedupe, gaps, quality
from clientlens.operators.reshape import assemble, pivot_nunique, spread_by_kind
from clientlens.plans import devices as dv
from clientlens.sources import standins


@query("w1_first_row_per_key", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC, o_orderkey) = 1""")
def _(c: Context):
    return dedupe.first_per_key(c.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w2_latest_row_per_key", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def _(c: Context):
    return dedupe.first_per_key(c.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w3_latest_per_composite_key", """
    SELECT customer_id, latitude, longitude, date_time, road FROM geocodes
    QUALIFY row_number() OVER (PARTITION BY customer_id, latitude, longitude ORDER BY date_time DESC, road, county, result_type) = 1""")
def _(c: Context):
    place = ["customer_id", "latitude", "longitude"]
    order = [F.desc("date_time"), F.asc("road"), F.asc("county"), F.asc("result_type")]
    return dedupe.first_per_key(c.role("geocodes"), place, order).select(*place, "date_time", "road")


@query("w4_mode_per_key", """
    SELECT customer_id, latitude, longitude FROM (SELECT customer_id, latitude, longitude, count(*) AS frequency FROM gps GROUP BY ALL) x
    QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY frequency DESC, latitude, longitude) = 1""")
def _(c: Context):
    return dedupe.mode_per_key(c.role("gps"), ["customer_id"], ["latitude", "longitude"]).drop("frequency")


@query("w5_nth_row_per_key", """
    SELECT client_id, accountid, balancedateasof, cast(clearedbalance AS double) AS balance FROM daily_balances
    QUALIFY row_number() OVER (PARTITION BY client_id, accountid ORDER BY balancedateasof, line_no, part_no) = 3""")
def _(c: Context):
    rows = dedupe.nth_per_key(c.role("daily_balances"), ["client_id", "accountid"],
                              [F.asc("balancedateasof"), F.asc("line_no"), F.asc("part_no")], 3)
    return rows.select("client_id", "accountid", "balancedateasof", F.col("clearedbalance").cast("double").alias("balance"))


@query("w6_rank_column_kept", """
    SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders) x WHERE rnk <= 2""")
def _(c: Context):
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return c.orders.select("o_custkey", "o_orderkey", rank.cast("bigint").alias("rnk")).filter(F.col("rnk") <= 2)


def _daily(c: Context):
    return c.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


@query("w7_day_gap", """
    SELECT o_custkey, gap, count(*) AS n_gaps FROM (
        SELECT o_custkey, datediff('day', cast(o_orderdate AS date), lead(cast(o_orderdate AS date)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)) AS gap
        FROM orders) x WHERE gap IS NOT NULL GROUP BY ALL""")
def _(c: Context):
    found = gaps.day_gaps(_daily(c), "o_custkey", "day", "n")
    return found.groupBy("o_custkey", F.col("gap").cast("bigint").alias("gap")).agg(F.sum("weight").alias("n_gaps"))


@query("w8_exact_median", """
    SELECT DISTINCT o_custkey, quantile_cont(gap, 0.5) OVER (PARTITION BY o_custkey) AS median_gap FROM (
        SELECT o_custkey, datediff('day', cast(o_orderdate AS date), lead(cast(o_orderdate AS date)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)) AS gap
        FROM orders) x""")
def _(c: Context):
    return gaps.day_gap_stats(_daily(c), "o_custkey", "day", {"all": F.col("n")}).select("o_custkey", F.col("med_all").alias("median_gap"))


@query("o1_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1")
def _(c: Context):
    return c.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("o2_sort_by_aggregate", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC")
def _(c: Context):
    return quality.reach(c.lineitem, ["l_returnflag"], "l_orderkey", "n").orderBy(F.desc("n"))


@query("o3_nth_per_group", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) = 3""")
def _(c: Context):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return dedupe.nth_per_key(c.lineitem, ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("o4_random_sample", "SELECT * FROM orders ORDER BY md5(concat_ws(':', cast(o_orderkey AS varchar), '42')), o_orderkey LIMIT 500")
def _(c: Context):
    return quality.hashed_sample(c.orders, "o_orderkey", 500, 42)


@query("u1_union_all", """
    SELECT o_custkey AS customer, o_orderdate AS at, 'order' AS kind FROM orders UNION ALL SELECT user_id, ts, event_type FROM events""")
def _(c: Context):
    a = c.orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"))
    return a.unionByName(c.events.select(F.col("user_id").alias("customer"), F.col("ts").alias("at"), F.col("event_type").alias("kind")))


@query("u2_distinct_branches", """
    SELECT * FROM (SELECT DISTINCT o_custkey AS k, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT * FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000)""")
def _(c: Context):
    rows = c.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("label"), "o_orderstatus", "o_totalprice")
    branch = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", 1), F.when(F.col("o_totalprice") > 100000, 2)))
    return rows.withColumn("branch", F.explode(branch)).select("k", "label", "branch").distinct().drop("branch")


@query("u3_concat_frames", """
    SELECT c_custkey AS key, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part""")
def _(c: Context):
    a = c.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(c.part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("u4_drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(c: Context):
    return c.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates()


@query("u5_drop_duplicate_keys", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")
def _(c: Context):
    order = [F.asc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return dedupe.first_per_key(c.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("u6_find_duplicates", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
        SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def _(c: Context):
    return dedupe.duplicate_rows(c.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


view("app_rows", """
    SELECT deviceId, package_1 AS package_name, installed_1 AS first_install_time FROM device_rows WHERE n_apps >= 1
    UNION ALL SELECT deviceId, package_2, installed_2 FROM device_rows WHERE n_apps >= 2""")


@query("r1_pivot_nunique", """
    SELECT l_suppkey, nullif(count(DISTINCT CASE WHEN p_type = 'ECONOMY' THEN l_partkey END), 0) AS "ECONOMY",
           nullif(count(DISTINCT CASE WHEN p_type = 'SMALL' THEN l_partkey END), 0) AS "SMALL",
           nullif(count(DISTINCT CASE WHEN p_type = 'LARGE' THEN l_partkey END), 0) AS "LARGE",
           nullif(count(DISTINCT CASE WHEN p_type = 'MEDIUM' THEN l_partkey END), 0) AS "MEDIUM",
           nullif(count(DISTINCT CASE WHEN p_type = 'PROMO' THEN l_partkey END), 0) AS "PROMO",
           nullif(count(DISTINCT CASE WHEN p_type = 'STANDARD' THEN l_partkey END), 0) AS "STANDARD"
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def _(c: Context):
    lines = c.lineitem.join(c.part, F.col("l_partkey") == F.col("p_partkey"))
    return pivot_nunique(lines, "l_suppkey", "p_type", "l_partkey", ["ECONOMY", "SMALL", "LARGE", "MEDIUM", "PROMO", "STANDARD"])


def _categorised(c: Context):
    """Devices stand in for customers: packages with category, rating and price."""
    apps = standins.device_apps(c.role("device_rows"))
    pairs = dv.installed_apps(apps).select(F.col("deviceId").alias("cust_id"), "package_name").distinct()
    return dv.categorised(pairs, c.role("app_catalogue"))


view("device_categories", """
    SELECT a.cust_id, a.package_name, a.package, coalesce(b.category, 'Others') AS category, b.rating, b.rating_description, b.is_paid FROM
        (SELECT DISTINCT deviceId AS cust_id, package_name, regexp_replace(package_name, '[ ._]', '', 'g') AS package FROM app_rows) a
    LEFT JOIN (SELECT regexp_replace(package_name, '[ ._]', '', 'g') AS package,
                      CASE WHEN regexp_matches(package_name, '(?i)linkedin|jobstreet|glint') THEN 'Job'
                           WHEN regexp_matches(package_name, '(?i)office|gdrive|word|powerpoint|excel') THEN 'Professional' ELSE category END AS category,
                      rating, rating_description, is_paid FROM app_catalogue) b ON a.package = b.package""")


@query("r2_pivot_three_ratings", """
    SELECT cust_id, nullif(count(DISTINCT CASE WHEN rating = 'rated for 12+' THEN package END), 0) AS rated_12,
           nullif(count(DISTINCT CASE WHEN rating = 'rated for 16+' THEN package END), 0) AS rated_16,
           nullif(count(DISTINCT CASE WHEN rating = 'rated for 18+' THEN package END), 0) AS rated_18
    FROM device_categories WHERE rating IS NOT NULL GROUP BY cust_id""")
def _(c: Context):
    wide = pivot_nunique(_categorised(c), "cust_id", "rating", "package", dv.RATINGS)
    return wide.toDF("cust_id", "rated_12", "rated_16", "rated_18")


@query("r3_pivot_paid_filled", """
    SELECT cust_id, count(DISTINCT CASE WHEN is_paid = 'free' THEN package END) AS free, count(DISTINCT CASE WHEN is_paid = 'pay' THEN package END) AS pay,
           count(DISTINCT CASE WHEN is_paid = 'undefined' THEN package END) AS "undefined" FROM device_categories WHERE is_paid IS NOT NULL GROUP BY cust_id""")
def _(c: Context):
    return pivot_nunique(_categorised(c), "cust_id", "is_paid", "package", dv.PRICES).fillna(0)


@query("r4_assemble_wide", """
    SELECT c_custkey, a."F" AS n_f, a."O" AS n_o, a."P" AS n_p, b.n_r FROM customer
    LEFT JOIN (SELECT o_custkey, nullif(count(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) AS "F", nullif(count(CASE WHEN o_orderstatus = 'O' THEN 1 END), 0) AS "O",
                      nullif(count(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0) AS "P"
               FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_r FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def _(c: Context):
    key = F.col("o_custkey").alias("c_custkey")
    status = pivot_nunique(c.orders, "o_custkey", "o_orderstatus", "o_orderkey", ["F", "O", "P"]).toDF("c_custkey", "n_f", "n_o", "n_p")
    urgent = c.orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy(key).agg(F.count("*").alias("n_r"))
    return assemble(c.customer.select("c_custkey"), [status, urgent], "c_custkey")


@query("r5_wide_case_spread", """
    SELECT customer_id, CASE WHEN event_description = 'Onboarding' THEN latitude END AS onboarding_latitude,
           CASE WHEN event_description = 'Onboarding' THEN longitude END AS onboarding_longitude,
           CASE WHEN event_description = 'Apigee Logs' THEN latitude END AS log_latitude,
           CASE WHEN event_description = 'Apigee Logs' THEN longitude END AS log_longitude
    FROM gps QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY gps_collection_date DESC, event_description, latitude, longitude) = 1""")
def _(c: Context):
    latest = dedupe.first_per_key(c.role("gps"), ["customer_id"], [
        F.desc("gps_collection_date"), F.asc("event_description"), F.asc("latitude"), F.asc("longitude")])
    kinds = {k: {f"{n}_latitude": F.col("latitude"), f"{n}_longitude": F.col("longitude")}
             for k, n in {"Onboarding": "onboarding", "Apigee Logs": "log"}.items()}
    return latest.select("customer_id", *[col.alias(n) for n, col in spread_by_kind(F.col("event_description"), kinds).items()])
