"""Balance history and deposit-only customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clientlens.functions.scalars import on_or_between, text_key
from clientlens.operators.dedupe import first_per_key, nth_per_key_by_day
from clientlens.params import Params

LOAN_FREE_DAYS = 90


def nth_day_balance(balances: DataFrame, p: Params, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """The n-th balance of each account, kept when it reaches the minimum."""
    nth = nth_per_key_by_day(balances, ["client_id", "accountid"], F.to_date("balancedateasof"),
                             [F.asc("balancedateasof"), *[F.asc(c) for c in tiebreak]], p.balance_rank)
    return nth.filter(F.col("clearedbalance") >= p.min_balance).select(
        "client_id", "accountid", "balancedateasof", "clearedbalance")


def first_loan(loans: DataFrame, p: Params) -> DataFrame:
    """First loan a customer applied for since the cohort opened."""
    wanted = loans.filter(F.to_date("startApplyDateTime") >= F.lit(p.cohort_from).cast("date"))
    return first_per_key(wanted, ["customerId"], [F.asc("startApplyDateTime"), F.asc("digitalLoanAccountId")]).select(
        "customerId", "new_loan_type", "applicationStatus", "startApplyDateTime")


def deposit_only(customers: DataFrame, loans: DataFrame, held: DataFrame, p: Params) -> DataFrame:
    """Registered customers with a kept balance and no loan application in their first days."""
    people = customers.filter(on_or_between(F.col("created_dt"), p.cohort_from, p.cohort_to))
    applied = first_loan(loans, p).select(text_key(F.col("customerId")).alias("cust_id"), "startApplyDateTime")
    funded = held.select(F.col("client_id").alias("cust_id"))
    late = F.datediff(F.to_date("startApplyDateTime"), F.to_date("created_dt")) >= LOAN_FREE_DAYS
    return (people.join(funded, "cust_id", "left_semi").join(applied, "cust_id", "left")
            .filter(late | F.col("startApplyDateTime").isNull())
            .select("cust_id", "product", "created_dt", "startApplyDateTime"))
