"""Transaction behaviour: classes, totals, gaps, first product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientlens.functions.rules import all_matches, first_match
from clientlens.functions.scalars import contains, lacks
from clientlens.operators.condagg import distinct_counts, min_if_any
from clientlens.operators.gaps import day_gap_stats
from clientlens.operators.skew import salted_join
from clientlens.params import Params
from clientlens.plans.cohort import registered

# fixed values: codes and labels found in the transaction table
CASH_IN_CODES = ("N01", "IP2", "XE2", "00T", "21C", "P01")
TOP_UP_CODES = ("21C", "N01", "IP2", "XE2")
BILL_CODES = ("BP1", "BP2", "BP3", "BP4")
CARD_CODE_PREFIX = "A0"
BILLS_CHANNEL = "Billspay"
CORE_CHANNEL = "Core transactions"
DEPOSIT_PRODUCTS = ("fixdep", "savings", "SaveForFuture")
NET_CASH_IN = "Net Cash In"
NET_CASH_OUT = "Net Cash Out"
SENTINEL_DATE = "9999-12-31"


def successful(transactions: DataFrame, p: Params) -> DataFrame:
    """Successful transactions in the observation window."""
    return transactions.filter(
        F.col("transaction_date").between(F.lit(p.obs_from).cast("date"), F.lit(p.obs_to).cast("date"))
        & (F.col("status") == "Success"))


def cohort_transactions(transactions: DataFrame, accounts: DataFrame, customers: DataFrame, p: Params,
                        heavy: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """Successful transactions in the observation window on known accounts of registered customers.

    Accounts meet their customers first, so that transactions are shuffled once, by customer and
    account, and a heavy customer is spread over its accounts. A main account may hold nearly all transactions of
    its customer: ``heavy`` (``skew.heavy_keys`` of the transactions by customer and account) names such accounts, and their
    transactions are dealt out over ``salts`` partitions. Without it Spark splits them at run time, where they are large.
    """
    key = ["customer_id", "accountid"]
    owned = accounts.select(F.col("ubcustomercode").alias("customer_id"), "accountid", "opendate", "closed", "productid")
    people = registered(customers, p).withColumnRenamed("cust_id", "customer_id")
    theirs = owned.join(people, "customer_id")
    if heavy is None:
        return successful(transactions, p).join(theirs, key)
    return salted_join(successful(transactions, p), theirs, key, heavy, salts)


def outgoing(p: Params) -> dict[str, Column]:
    """Qualifying tests shared by the classifier and the campaign outcomes."""
    narration, code = F.col("core_narration"), F.col("transaction_code")
    debit = F.col("credit_debit_indicator") == "DEBIT"
    credit = F.col("credit_debit_indicator") == "CREDIT"
    main = F.col("account_type") == p.main_account
    open_funds = lacks(narration, "blocking")
    card = code.startswith(CARD_CODE_PREFIX)
    return {
        "bills": debit & open_funds & (F.col("channel") == BILLS_CHANNEL),
        "card": debit & main & card & open_funds,
        "transfer": debit & main & open_funds,
        "top_up": credit & main & open_funds & ~card & code.isin(*CASH_IN_CODES),
    }


def sub_type_rules(p: Params) -> dict[str, Column]:
    """Sub-type label to rule, cash-in first. Rules may overlap."""
    t = outgoing(p)
    narration, channel, side = F.col("core_narration"), F.col("channel"), F.col("inter_exter_flag")
    not_card = ~F.col("transaction_code").startswith(CARD_CODE_PREFIX)
    received = contains(narration, f"Receive money from other {p.main_account}", fold_case=False)
    sent = contains(narration, f"send money to other {p.main_account}")
    return {
        f"{p.outside} to TSA": t["top_up"] & (side == p.outside),
        f"Other {p.bank} Users to Own {p.main_account}": t["top_up"] & (side == p.inside) & received,
        "Bills Pay": t["bills"],
        "Card Transactions (Cash Out)": t["card"],
        f"Own TSA to Other {p.bank} Users": t["transfer"] & not_card & (channel == CORE_CHANNEL) & (side == p.inside) & sent,
        f"TSA to {p.outside} (Other Banks)": t["transfer"] & ~channel.isin(CORE_CHANNEL, BILLS_CHANNEL) & (side == p.outside),
    }


def labelled(base: DataFrame, p: Params) -> DataFrame:
    """One row per transaction row and matching sub-type, from a single scan; repeated rows stay."""
    rules = sub_type_rules(p)
    cash_in = list(rules)[:2]
    return (base.withColumn("sub_transaction_type", F.explode(all_matches(rules)))
            .withColumn("main_transaction_type",
                        F.when(F.col("sub_transaction_type").isin(*cash_in), NET_CASH_IN).otherwise(NET_CASH_OUT))
            .select("transaction_date", "opendate", "closed", "registration_date", "transaction_id", "customer_id",
                    "accountid", "account_type", "status", "channel", "credit_debit_indicator", "inter_exter_flag",
                    "trx_amount", "core_narration", "main_transaction_type", "sub_transaction_type"))


def classified(base: DataFrame, p: Params) -> DataFrame:
    """One distinct row per transaction row and matching sub-type.

    Partitioned by customer and transaction, which the distinct and the totals both reuse.
    """
    return labelled(base, p).repartition("customer_id", "transaction_id").distinct()


def transaction_totals(rows: DataFrame, p: Params) -> DataFrame:
    """Distinct transactions and amounts per customer: all, per direction, per sub-type."""
    names = dict(zip(["cash_in_ob2t", "cash_in_ot2t", "cash_out_billpay", "cash_out_cards", "cash_out_t2ot", "cash_out_t2ob"],
                     sub_type_rules(p)))
    tests = {"cash_in_total": F.col("main_transaction_type") == NET_CASH_IN,
             "cash_out_total": F.col("main_transaction_type") == NET_CASH_OUT}
    tests |= {n: F.col("sub_transaction_type") == label for n, label in names.items()}
    return distinct_counts(
        rows, ["customer_id"], "transaction_id", total="total_transactions",
        flags={f"cnt_{n}": c for n, c in tests.items()},
        sums={f"amt_{n}": F.when(c, F.col("trx_amount")) for n, c in tests.items()})


def transaction_gaps(rows: DataFrame) -> DataFrame:
    """Average and median days between distinct (day, direction) rows: overall, in, out.

    Labelled rows will do: repeated ones collapse on the map side with the rest of their day.
    """
    inflow = F.max(F.when(F.col("main_transaction_type") == NET_CASH_IN, 1).otherwise(0))
    outflow = F.max(F.when(F.col("main_transaction_type") == NET_CASH_OUT, 1).otherwise(0))
    daily = rows.groupBy("customer_id", "transaction_date").agg(inflow.alias("n_in"), outflow.alias("n_out"))
    stats = day_gap_stats(daily, "customer_id", "transaction_date", {
        "all": F.col("n_in") + F.col("n_out"), "in": F.col("n_in"), "out": F.col("n_out")})
    return stats.select(
        "customer_id",
        F.col("avg_all").alias("avg_days_bt_trans"), F.col("avg_in").alias("avg_days_bt_cash_in_trans"),
        F.col("avg_out").alias("avg_days_bt_cash_out_trans"), F.col("med_all").alias("med_days_bt_trans"),
        F.col("med_in").alias("med_days_bt_cash_in_trans"), F.col("med_out").alias("med_days_bt_cash_out_trans"))


def first_product(base: DataFrame, p: Params) -> DataFrame:
    """Earliest of first other account, bill payment, card use and top-up, with its segment.

    Every date is the earliest qualifying one; all four come from one aggregate.
    """
    day, code = F.col("transaction_date"), F.col("transaction_code")
    account = F.struct(F.col("opendate"), F.col("accountid"), F.col("productid"), F.col("account_type"))
    used = base.groupBy("customer_id").agg(
        min_if_any(code.isin(*BILL_CODES), day).alias("first_billpay_date"),
        min_if_any(code.startswith(CARD_CODE_PREFIX) & lacks(F.col("core_narration"), "blocking"), day).alias("virtual_transaction_date"),
        min_if_any(code.isin(*TOP_UP_CODES), day).alias("first_tsa_topup_date"),
        min_if_any(F.col("account_type") != p.main_account, account).alias("_account"))
    opened = F.to_date("_account.opendate")
    never = F.lit(SENTINEL_DATE).cast("date")
    bills, card, top_up = (F.col(c) for c in ("first_billpay_date", "virtual_transaction_date", "first_tsa_topup_date"))
    used = used.withColumn("first_opened_date", F.least(*[F.coalesce(c, never) for c in (opened, bills, card, top_up)]))
    first = F.col("first_opened_date")
    deposit = F.col("_account.productid").isin(*DEPOSIT_PRODUCTS)
    return used.select(
        "customer_id",
        first_match([(first == opened, F.col("_account.account_type")), (first == bills, "Bills Pay"),
                     (first == top_up, "TSA Top-Up"), (first == card, "Virtual Transaction")],
                    F.lit("Unknown")).alias("first_product"),
        first_match([((first == opened) & deposit, "Deposit Users"), ((first == opened) & ~deposit, "Loan Users"),
                     ((first == bills) | (first == top_up) | (first == card), "Utility Users")],
                    F.lit("Ghost Users")).alias("first_product_user_segment"))
