"""Readers and writers."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F, types as T

from bindings.registry import Context, query
from clientlens.operators import sinks, stores
from clientlens.operators.reshape import rename_by_map
from clientlens.plans import flags as fl
from clientlens.plans.cohort import cohort
from clientlens.sources import readers


@query("s1_table_scan", "SELECT * FROM orders")
def _(c: Context):
    return c.orders


@query("s2_partition_pruned_scan", """
    SELECT partition_date, media_source, count(*) AS n FROM installs
    WHERE partition_date BETWEEN DATE '1995-01-05' AND DATE '1995-01-20' GROUP BY ALL""")
def _(c: Context):
    path = c.scratch("installs")
    sinks.write_snapshot(c.role("installs"), path, ["partition_date"])
    stored = c.spark.read.parquet(path)
    return (stored.filter(F.col("partition_date").between(F.lit("1995-01-05").cast("date"), F.lit("1995-01-20").cast("date")))
            .groupBy("partition_date", "media_source").agg(F.count("*").alias("n")))


CATALOGUE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "package_name", "category", "rating", "rating_description", "is_paid")])


@query("s3_csv_scan", "SELECT package_name, category, rating, rating_description, is_paid FROM app_catalogue")
def _(c: Context):
    path = c.scratch("catalogue")
    sinks.write_csv(c.role("app_catalogue").select(*CATALOGUE.fieldNames()), path)
    return readers.read_csv(c.spark, path, CATALOGUE)


@query("s4_column_mapping_scan", """
    SELECT c_custkey AS cust_id, c_name AS customer_name, c_nationkey AS home_nation, c_acctbal, c_mktsegment AS segment FROM customer""")
def _(c: Context):
    sheet = T.StructType([T.StructField("Column", T.StringType()), T.StructField("Updated_Name", T.StringType())])
    names = [("c_custkey", "cust_id"), ("c_name", "customer_name"), ("c_nationkey", "home_nation"), ("c_mktsegment", "segment")]
    path = c.scratch("mapping")
    sinks.write_csv(c.spark.createDataFrame(names, sheet), path)
    mapping = readers.rename_map(readers.read_csv(c.spark, path, sheet), "Column", "Updated_Name", c.customer.columns)
    return rename_by_map(c.customer, mapping)


@query("s5_run_query", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(c: Context):
    return c.spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus", orders=c.orders)


@query("s6_parameterised_query", """
    WITH params AS (SELECT DATE '1996-01-01' AS start_date, DATE '1997-12-31' AS end_date)
    SELECT o_custkey, count(*) AS n FROM orders JOIN params p ON cast(o_orderdate AS date) BETWEEN p.start_date AND p.end_date
    GROUP BY o_custkey""")
def _(c: Context):
    return c.spark.sql(
        "SELECT o_custkey, count(*) AS n FROM {orders} WHERE to_date(o_orderdate) BETWEEN :start AND :end GROUP BY o_custkey",
        args={"start": date(1996, 1, 1), "end": date(1997, 12, 31)}, orders=c.orders)


@query("s7_cohort_parameters", """
    SELECT o_orderkey, o_custkey, cast(o_orderdate AS date) AS day FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND cast(o_orderdate AS date) >= DATE '1996-06-01'""")
def _(c: Context):
    cohort = c.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    dated = c.orders.filter(F.to_date("o_orderdate") >= F.lit("1996-06-01").cast("date"))
    return readers.in_cohort(dated, "o_custkey", cohort, "c_custkey").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))


MART = "SELECT o_custkey AS customer_id, count(*) AS n_orders, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey"


def _mart(c: Context):
    return c.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"))


MART_SCHEMA = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("n_orders", T.LongType()),
                            T.StructField("largest", T.DoubleType())])
TYPED_MART = f"SELECT cast(customer_id AS varchar) AS customer_id, n_orders, largest FROM ({MART}) m"


@query("s8_reread_mart", MART)
def _(c: Context):
    """A published mart, read by name."""
    name = f"mart_{uuid.uuid4().hex}"
    stores.publish(_mart(c), _mart(c).schema, name, c.scratch("mart"))
    return c.spark.table(name)


@query("k1_csv_sink", MART)
def _(c: Context):
    path = c.scratch("csv")
    sinks.write_csv(_mart(c), path)
    return readers.read_csv(c.spark, path, _mart(c).schema)


@query("k2_typed_load", "SELECT * FROM flags")
def _(c: Context):
    path = c.scratch("flags")
    flags = fl.all_flags(c.role("behaviour_mart"), c.role("loans"), c.role("loan_buckets"), c.role("delinquency"), c.p)
    sinks.write_typed(flags, fl.FLAG_SCHEMA, path)
    return c.spark.read.schema(fl.FLAG_SCHEMA).parquet(path)


@query("k3_drop_and_create", TYPED_MART)
def _(c: Context):
    """A table with another schema, replaced in one step."""
    name, folder = f"replaced_{uuid.uuid4().hex}", c.scratch("replaced")
    old = _mart(c).select("customer_id", F.lit("old").alias("remark"))
    stores.publish(old, T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("remark", T.StringType())]), name, folder)
    stores.publish(_mart(c), MART_SCHEMA, name, folder)
    return c.spark.table(name)


@query("k4_truncate_load", TYPED_MART)
def _(c: Context):
    """The rows replaced, the declared columns kept."""
    name, folder = f"truncated_{uuid.uuid4().hex}", c.scratch("truncated")
    stores.publish(_mart(c).filter("n_orders > 5"), MART_SCHEMA, name, folder)
    stores.reload(_mart(c), name, folder)
    return c.spark.table(name)


@query("k5_append_load", f"{TYPED_MART} UNION ALL {TYPED_MART}")
def _(c: Context):
    path = c.scratch("appended")
    for _ in range(2):
        sinks.write_typed(_mart(c), MART_SCHEMA, path, mode="append")
    return c.spark.read.parquet(path)


@query("k6_daily_snapshot", """
    SELECT cust_id, kyc_status, onboarding_date, day_120, day_150 FROM cohort""")
def _(c: Context):
    """Filed up to a day, then again with all customers: the second run computes and files the later days only."""
    path, people = c.scratch("snapshot"), c.role("customers")
    for source in (people.filter(F.col("created_dt") < F.lit("1998-03-01").cast("timestamp_ntz")), people, people):
        sinks.refresh_snapshot(source, "created_dt", "created_dt", lambda rows: cohort(rows, c.p), path, "onboarding_date")
    return c.spark.read.parquet(path).select("cust_id", "kyc_status", "onboarding_date", "day_120", "day_150")


@query("k7_filtered_export", """
    SELECT customer_id, tx_first_product, tx_mau4m_active, tx_mau5m_active FROM flags_active
    WHERE tx_mau4m_active = 1 AND tx_mau5m_active = 0""")
def _(c: Context):
    path = c.scratch("export")
    rows = fl.active_flags(c.role("behaviour_mart")).select("customer_id", "tx_first_product", "tx_mau4m_active", "tx_mau5m_active")
    wanted = rows.filter((F.col("tx_mau4m_active") == 1) & (F.col("tx_mau5m_active") == 0))
    sinks.write_csv(wanted, path)
    return readers.read_csv(c.spark, path, rows.schema)
