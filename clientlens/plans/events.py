"""Install attribution, app events, first cash-in, locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientlens.functions.scalars import lacks, minutes_between, on_or_between, text_key
from clientlens.operators.condagg import count_where
from clientlens.operators.dedupe import first_per_key, mode_per_key
from clientlens.params import Params
from clientlens.plans.cohort import registered
from clientlens.plans.transactions import CASH_IN_CODES

# fixed values: app event names and tile attributes
APP_EVENTS = ("App_Launch", "Loans_QL_Calculator", "Loans_QL_Launch", "Loans_SIL_Launch")
TILE_EVENT = "Loans_Selection"
TILE_OF_CLICK = {"Quick_Loan": "Loans_Selection - QL", "Shop_Installment_Loan": "Loans_Selection - SIL"}
GPS_SOURCE = "Apigee Logs"
NO_POSITION = "undefined"
ADDRESS_COLUMNS = ("country", "state", "county", "city", "municipality", "postcode", "road", "state_code",
                   "result_type", "formatted", "address_line1", "address_line2")


def first_installs(installs: DataFrame, p: Params, extra: tuple[str, ...] = ()) -> DataFrame:
    """First install per known user; the partition column is compared as it is, so it prunes."""
    known = installs.filter(F.col("partition_date").between(F.lit(p.obs_from).cast("date"), F.lit(p.obs_to).cast("date"))
                            & F.col("customer_user_id").isNotNull())
    first = first_per_key(known, ["customer_user_id"], [F.asc("install_time"), F.asc("install_id")])
    return first.select("install_id", "customer_user_id", "install_time", *extra)


def attribution_link(paid: DataFrame, organic: DataFrame, p: Params, extra: tuple[str, ...] = ()) -> DataFrame:
    """First install per user and source table, one below the other."""
    return first_installs(paid, p, extra).unionByName(first_installs(organic, p, extra))


def first_install_overall(link: DataFrame) -> DataFrame:
    """One install per user where both sources know the user."""
    return first_per_key(link, ["customer_user_id"], [F.asc("install_time"), F.asc("install_id")])


def app_events(events: DataFrame, p: Params) -> DataFrame:
    """Distinct app events; tile selections are renamed after the tile that was clicked."""
    seen = events.filter(on_or_between(F.col("event_time"), p.obs_from, p.obs_to))
    tile = F.col("clicked")
    name = F.when(F.col("event_name").isin(*APP_EVENTS), F.col("event_name"))
    for clicked, label in TILE_OF_CLICK.items():
        name = name.when((F.col("event_name") == TILE_EVENT) & (tile == clicked), F.lit(label))
    return (seen.withColumn("app_event", name).filter(F.col("app_event").isNotNull())
            .select("customer_id", "event_time", F.col("app_event").alias("event_name")).distinct())


def app_event_counts(rows: DataFrame) -> DataFrame:
    name = F.col("event_name")
    return rows.groupBy("customer_id").agg(
        count_where(name == "App_Launch").alias("app_launch_count"),
        count_where(name.isin("Loans_Selection - QL", "Loans_QL_Launch")).alias("ql_sales_tile_count"),
        count_where(name.isin("Loans_SIL_Launch", "Loans_Selection - SIL")).alias("sil_sales_tile_count"),
        count_where(name == "Loans_QL_Calculator").alias("ql_calculator_count"))


def first_cash_in(postings: DataFrame, accounts: DataFrame, p: Params) -> DataFrame:
    """Earliest credit on a main account per customer.

    Postings shrink to one per account before they meet the accounts.
    """
    wanted = postings.filter(
        on_or_between(F.col("postingdate"), p.obs_from, p.obs_to) & (F.col("debitcreditflag") == "C")
        & F.col("code").isin(*CASH_IN_CODES) & F.col("accountid").startswith(p.main_account_prefix)
        & lacks(F.col("narration"), "blocking"))
    order = [F.asc("postingdate"), F.asc("transactionid")]
    per_account = first_per_key(wanted, ["accountid"], order)
    owned = per_account.join(accounts.select("accountid", "ubcustomercode", "accountdescription"), "accountid")
    return first_per_key(owned, ["ubcustomercode"], order).select(
        "transactionid", "narration", "debitcreditflag", "postingdate", "amount", "ubcustomercode", "accountdescription")


def event_mart(customers: DataFrame, link: DataFrame, counts: DataFrame, cash_in: DataFrame, p: Params) -> DataFrame:
    """Minutes from install to registration (not negative) and to the first cash-in, and app events."""
    people = registered(customers, p).withColumnRenamed("registration_date", "created_dt")
    installs = first_install_overall(link).withColumnRenamed("customer_user_id", "cust_id")
    events = counts.withColumn("cust_id", text_key(F.col("customer_id"))).drop("customer_id")
    paid_in = cash_in.select(F.col("ubcustomercode").alias("cust_id"), "postingdate")
    measures = ("app_launch_count", "ql_sales_tile_count", "sil_sales_tile_count", "ql_calculator_count")
    return (people.join(installs, "cust_id")
            .withColumn("install_to_registration_minutes", minutes_between(F.col("install_time"), F.col("created_dt")))
            .filter(F.col("install_to_registration_minutes") >= 0)
            .join(events, "cust_id", "left").join(paid_in, "cust_id", "left")
            .select("cust_id", "install_id", "created_dt", "install_to_registration_minutes",
                    minutes_between(F.col("created_dt"), F.col("postingdate")).alias("onboarding_to_first_cash_in_minutes"),
                    *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures]))


def frequent_location(gps: DataFrame, p: Params) -> DataFrame:
    """Most frequent valid position of the app log per customer."""
    valid = gps.filter(
        F.col("SourceAsofDate").between(F.lit(p.obs_from).cast("date"), F.lit(p.obs_to).cast("date"))
        & (F.col("event_description") == GPS_SOURCE)
        & (F.col("latitude") != NO_POSITION) & (F.col("longitude") != NO_POSITION))
    return mode_per_key(valid, ["customer_id"], ["latitude", "longitude"]).drop("frequency")


def location_address(locations: DataFrame, geocodes: DataFrame, p: Params) -> DataFrame:
    """Latest geocode of each customer's frequent position, where there is one."""
    place = ["customer_id", "latitude", "longitude"]
    ties = [F.asc_nulls_first(c) for c in ("road", "county", "result_type")]
    dated = geocodes.filter(on_or_between(F.col("date_time"), p.obs_from, p.obs_to))
    latest = first_per_key(dated, place, [F.desc("date_time"), *ties]).select(*place, *ADDRESS_COLUMNS)
    return locations.join(latest, place, "left")
