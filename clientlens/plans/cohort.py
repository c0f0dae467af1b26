"""Who is in scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientlens.functions.scalars import offset_dates, on_or_between
from clientlens.params import Params

EXCLUDED_KYC = "BKYC"


def cohort(customers: DataFrame, p: Params) -> DataFrame:
    """Customers onboarded in the cohort range with full KYC, and their observation dates.

    A NULL KYC status does not pass the inequality, as in SQL.
    """
    day = F.to_date("created_dt")
    return (customers
            .filter(on_or_between(F.col("created_dt"), p.cohort_from, p.cohort_to)
                    & F.col("cust_id").isNotNull() & (F.col("kyc_status") != EXCLUDED_KYC))
            .select("cust_id", "kyc_status", day.alias("onboarding_date"),
                    *[c.alias(n) for n, c in offset_dates(day, p.offsets).items()])
            .distinct())


def everybody(customers: DataFrame, p: Params) -> DataFrame:
    """Customers with an id onboarded in the cohort range, whatever their KYC status, and their observation dates."""
    day = F.to_date("created_dt")
    return (customers.filter(on_or_between(F.col("created_dt"), p.cohort_from, p.cohort_to) & F.col("cust_id").isNotNull())
            .select("cust_id", "kyc_status", day.alias("onboarding_date"), *[c.alias(n) for n, c in offset_dates(day, p.offsets).items()])
            .distinct())


def registered(customers: DataFrame, p: Params) -> DataFrame:
    """Customers created in the cohort range, whatever their KYC status."""
    return (customers.filter(on_or_between(F.col("created_dt"), p.cohort_from, p.cohort_to))
            .select("cust_id", F.col("created_dt").alias("registration_date")))
