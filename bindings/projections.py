"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Context, query
from clientlens.functions import scalars as sc
from clientlens.functions.rules import flag
from clientlens.operators import dedupe
from clientlens.operators.reshape import prefix_columns, rename_by_map


@query("p1_projection_alias", "SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders")
def _(c: Context):
    return c.orders.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
                           F.col("o_totalprice").alias("amount"))


@query("p2_constant_tags", "SELECT o_orderkey, 'Net Cash In' AS main_transaction_type, 'first' AS data_set FROM orders WHERE o_orderstatus = 'F'")
def _(c: Context):
    return c.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey").withColumns(
        {"main_transaction_type": F.lit("Net Cash In"), "data_set": F.lit("first")})


@query("p3_star_expansion", "SELECT a.*, n.n_name FROM customer a JOIN nation n ON a.c_nationkey = n.n_nationkey")
def _(c: Context):
    a, n = c.customer.alias("a"), c.nation.alias("n")
    return a.join(n, F.col("a.c_nationkey") == F.col("n.n_nationkey")).select("a.*", "n.n_name")


@query("p4_column_order", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def _(c: Context):
    return c.customer.select("c_mktsegment", "c_custkey", "c_acctbal")


@query("p5_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(c: Context):
    return c.customer.drop("c_name", "c_acctbal")


@query("p6_rename", """
    SELECT c_custkey AS cust_id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer""")
def _(c: Context):
    return rename_by_map(c.customer, {"c_custkey": "cust_id", "c_name": "name", "c_acctbal": "balance"})


@query("p7_bulk_prefix", """
    SELECT c_custkey, c_name AS de_c_name, c_nationkey AS de_c_nationkey, c_acctbal AS de_c_acctbal, c_mktsegment AS de_c_mktsegment FROM customer""")
def _(c: Context):
    return prefix_columns(c.customer, "de_", keep=["c_custkey"])


@query("p8_conjunctive_filter", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' AND o_totalprice >= 1000""")
def _(c: Context):
    return c.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT")
                           & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_totalprice")


@query("p9_between_dates", """
    SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders WHERE cast(o_orderdate AS date) BETWEEN DATE '1996-01-01' AND DATE '1996-07-01'""")
def _(c: Context):
    return c.orders.filter(sc.on_or_between(F.col("o_orderdate"), "1996-01-01", "1996-07-01")).select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("p10_in_lists", """
    SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')""")
def _(c: Context):
    return c.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus")


@query("p11_in_subquery", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(c: Context):
    rich = c.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return c.orders.join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("p12_in_subquery_as_value", """
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1 ELSE 0 END AS is_big FROM customer""")
def _(c: Context):
    big = c.orders.filter(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("hit")).distinct()
    return c.customer.join(big, "c_custkey", "left").select("c_custkey", flag(F.col("hit").isNotNull()).cast("int").alias("is_big"))


@query("p13_like", """
    SELECT transaction_id, core_narration FROM transactions
    WHERE lower(core_narration) NOT LIKE '%blocking%' AND core_narration LIKE '%Receive money from other Bank Account%'""")
def _(c: Context):
    text = F.col("core_narration")
    return c.role("transactions").filter(
        sc.lacks(text, "blocking") & sc.contains(text, "Receive money from other Bank Account", fold_case=False)).select(
        "transaction_id", "core_narration")


@query("p14_prefix_like", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'MA%' OR c_mktsegment LIKE 'B%'")
def _(c: Context):
    return c.customer.filter(F.col("c_mktsegment").startswith("MA") | F.col("c_mktsegment").startswith("B")).select("c_custkey", "c_mktsegment")


@query("p15_null_tests", """
    SELECT digitalLoanAccountId, maritalStatus, dependentsCount FROM loans
    WHERE maritalStatus IS NOT NULL OR dependentsCount IS NOT NULL OR decision_date IS NULL""")
def _(c: Context):
    return c.role("loans").filter(F.col("maritalStatus").isNotNull() | F.col("dependentsCount").isNotNull()
                                  | F.col("decision_date").isNull()).select("digitalLoanAccountId", "maritalStatus", "dependentsCount")


@query("p16_sentinel_exclusion", "SELECT customer_id, latitude, longitude FROM gps WHERE latitude <> 'undefined' AND longitude <> 'undefined'")
def _(c: Context):
    return c.role("gps").filter((F.col("latitude") != "undefined") & (F.col("longitude") != "undefined")).select(
        "customer_id", "latitude", "longitude")


@query("p17_isin_filter", "SELECT customer_id, tx_first_product FROM behaviour_mart WHERE tx_first_product IN ('Group Stash', 'Individual Stash')")
def _(c: Context):
    return c.role("behaviour_mart").filter(F.col("tx_first_product").isin("Group Stash", "Individual Stash")).select("customer_id", "tx_first_product")


@query("p18_boolean_mask", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 10 AND l_discount = 0.05""")
def _(c: Context):
    mask = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 10) & (F.col("l_discount") == 0.05))
    return c.lineitem.filter(mask).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("p19_drop_null_key", "SELECT install_id, customer_user_id FROM installs WHERE customer_user_id IS NOT NULL")
def _(c: Context):
    return c.role("installs").dropna(subset=["customer_user_id"]).select("install_id", "customer_user_id")


@query("p20_post_window_filter", """
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(c: Context):
    return dedupe.first_per_key(c.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_orderdate")


@query("p21_kyc_exclusion", """
    SELECT cust_id, kyc_status, 'sql' AS rule FROM customers WHERE kyc_status <> 'BKYC'
    UNION ALL SELECT cust_id, kyc_status, 'frame' FROM customers WHERE kyc_status IS DISTINCT FROM 'BKYC'""")
def _(c: Context):
    people = c.role("customers").select("cust_id", "kyc_status")
    status = F.col("kyc_status")
    # an inequality drops NULL, a frame comparison keeps it: one scan gives both answers
    rules = F.array_compact(F.array(F.when(status != "BKYC", "sql"), F.when(~status.eqNullSafe("BKYC"), "frame")))
    return people.withColumn("rule", F.explode(rules))
