"""Target flags: activity, churn, loan applications and approvals, early default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientlens.functions.rules import flag
from clientlens.functions.scalars import number_key
from clientlens.operators.ranges import window_counts, with_counts
from clientlens.operators.reshape import assemble
from clientlens.params import Params

# fixed values: product lists and thresholds of the flag definitions
CHURN_PRODUCTS = ("Individual Stash", "Group Stash", "Bills Pay", "Unsecured Loan")
LOAN_PRODUCTS_BASIC = ("Individual Stash", "Group Stash", "Bills Pay")
LOAN_PRODUCTS = ("Individual Stash", "Group Stash", "Bills Pay", "TSA Top-Up", "Time Deposit - 6 months",
                 "Time Deposit - 24 months", "Time Deposit - 12 months", "Time Deposit - 9 months",
                 "Time Deposit - 18 months")
DEFAULT_PRODUCTS = ("Unsecured Loan",)
CASH_LOANS = ("Quick", "Flex")
ACTIVE_BALANCE = 100
NPL_DAYS = 180
MONTH = 30
OVER = ("COMPLETED", "REJECT", "EXPIRED")
DEFAULTED = (1, 2)

# fixed values: published flag columns, in order
FLAG_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("registration_date", T.TimestampNTZType()),
    T.StructField("tx_first_product", T.StringType()),
    *[T.StructField(n, T.LongType()) for n in (
        "tx_mau4m_active", "tx_mau5m_active", "tx_Churn_flag_4m", "tx_Churn_flag_5m", "tx_loanApplicationflag_4m",
        "submittedappliction4m", "tx_loanApplicationflag_5m", "submittedappliction5m", "tx_loanApprovedflag_5m",
        "tx_FSPD30_4m", "npl", "tx_FSPD30_5m", "fspd304m", "fspd305m")]])


def flag_inputs(people: DataFrame, first: DataFrame, moves: DataFrame, loans: DataFrame, balances: DataFrame, p: Params, closed: str = "both") -> DataFrame:
    """What the flags are decided on, one row per registered customer.

    ``first`` holds the first product, ``moves`` one row per classified transaction, ``balances`` the known balances
    on both observation days. The two windows of transactions are the month up to the first day and the time
    between both; a loan that is not over counts from its disbursement on. All loan counts come with them, from the same
    pass over the loans. ``closed`` names the ends that belong to the windows between both days: ``right`` leaves the first day out.
    """
    start = F.to_date("registration_date")
    near, far = (F.date_add(start, n) for n in p.offsets)
    spine = (people.select(F.col("cust_id").alias("customer_id"), "registration_date")
             .join(first.select("customer_id", F.col("first_product").alias("tx_first_product")), "customer_id", "left"))
    moved = window_counts(spine, moves, "customer_id", "customer_id", streams={"moved": (F.col("transaction_date"), F.lit(True))},
                          windows={"tx_cnt_total_transactions_bw_3m_and_4m": ("moved", F.date_add(start, p.offsets[0] - MONTH), near),
                                   "tx_cnt_total_transactions_bw_4m_and_5m": ("moved", near, far, closed)})
    counted = with_counts(loan_keyed(with_counts(spine, moved, "customer_id")), loan_counts(spine, loans, p, closed), "_loan_key").drop("_loan_key")
    return counted.join(balances, "customer_id", "left")


def active(mart_suffix: str, transactions: str, with_balance: bool = True, unknown: float | None = None) -> Column:
    """Recent transaction or enough balance, and no active loan.

    One unknown balance makes the sum unknown, which is not enough; ``unknown`` is what it counts as instead.
    """
    no_loan = F.col(f"tx_cnt_active_loans_end_{mart_suffix}") == 0
    result = (F.col(transactions) >= 1) & no_loan
    if with_balance:
        parts = [F.col(f"tx_{kind}_balance_{mart_suffix}") for kind in ("tsa", "stash")]
        tsa, stash = parts if unknown is None else [F.coalesce(c, F.lit(unknown)) for c in parts]
        result = result | ((tsa + stash >= ACTIVE_BALANCE) & no_loan)
    return result


def active_flags(mart: DataFrame, with_balance: bool = True, unknown: float | None = None) -> DataFrame:
    return mart.withColumns({
        "tx_mau4m_active": flag(active("4m", "tx_cnt_total_transactions_bw_3m_and_4m", with_balance, unknown)),
        "tx_mau5m_active": flag(active("5m", "tx_cnt_total_transactions_bw_4m_and_5m", with_balance, unknown))})


def eligible(products: Sequence[str], condition: Column) -> Column:
    """0/1 for eligible first products, NULL for all others."""
    return F.when(F.col("tx_first_product").isin(*products), flag(condition))


def churn_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"tx_Churn_flag_{m}": eligible(CHURN_PRODUCTS, F.col(f"tx_mau{m}_active") == 0) for m in ("4m", "5m")})


def loan_keyed(mart: DataFrame) -> DataFrame:
    """The mart with the numeric customer key of the loan tables."""
    return mart.withColumn("_loan_key", number_key(F.col("customer_id")))


def loan_counts(mart: DataFrame, loans: DataFrame, p: Params, closed: str = "both") -> DataFrame:
    """Every count of a customer's loans, from one pass over them and one grouping.

    Loans that are not over by the day of disbursement up to each offset, applications up to the first offset and between
    both, cash-loan approvals between both, and cash loans that were ever non-performing. The first window includes
    the first offset day, ``closed`` says which ends the second one includes.
    """
    start, ever = F.to_date("registration_date"), F.lit("1900-01-01").cast("date")
    near, far = F.date_add(start, p.offsets[0]), F.date_add(start, p.offsets[1])
    cash = F.col("new_loan_type").isin(*CASH_LOANS)
    return window_counts(
        loan_keyed(mart), loans, "_loan_key", "customerId",
        streams={"active": (F.col("disbursementdatetime"), ~F.col("applicationStatus").isin(*OVER)),
                 "applied": (F.col("startApplyDateTime"), F.lit(True)),
                 "approved": (F.col("approvedDateTime"), (F.col("flagApproval") == 1) & cash),
                 "npl": (ever, (F.col("Max_Ever_DPD") >= NPL_DAYS) & cash)},
        windows={"tx_cnt_active_loans_end_4m": ("active", ever, near), "tx_cnt_active_loans_end_5m": ("active", ever, far),
                 "submittedappliction4m": ("applied", start, near), "submittedappliction5m": ("applied", near, far, closed),
                 "approved5m": ("approved", near, far, closed), "npl": ("npl", ever, ever)})


def default_counts(mart: DataFrame, loans: DataFrame, buckets: DataFrame, delinquency: DataFrame, p: Params) -> DataFrame:
    """Rows of loan, bucket and delinquency on the two observation days.

    The (loan, day) pairs of the mart's customers with cash loans filter both other tables before anything is added up:
    first delinquency by loan, then the buckets by loan and day of the bad ones. The number of joined rows is the
    product of the tables' counts per loan.
    """
    start = F.to_date("registration_date")
    names = ("fspd304m", "fspd305m")
    days = F.array(*[F.struct(F.lit(name).alias("_name"), F.date_add(start, n).alias("bucketDate")) for name, n in zip(names, p.offsets, strict=True)])
    spine = loan_keyed(mart).select("_loan_key", days.alias("_days"))
    cash = (loans.filter(F.col("new_loan_type").isin(*CASH_LOANS)).groupBy(F.col("customerId").alias("_loan_key"), "loanAccountNumber")
            .agg(F.count("*").alias("_loans")))
    owed = cash.join(spine, "_loan_key")
    bad = (delinquency.filter(F.col("min_inst_def30").isin(*DEFAULTED)).join(owed.select("loanAccountNumber"), "loanAccountNumber", "left_semi")
           .groupBy("loanAccountNumber").agg(F.count("*").alias("_bad")))
    pairs = (owed.join(bad, "loanAccountNumber")
             .select("_loan_key", "loanAccountNumber", (F.col("_loans") * F.col("_bad")).alias("_weight"), F.inline("_days")))
    keys = ["loanAccountNumber", "bucketDate"]
    seen = buckets.join(pairs.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_seen"))
    return (pairs.join(seen, keys).groupBy("_loan_key").agg(
        *[F.sum(F.when(F.col("_name") == n, F.col("_weight") * F.col("_seen"))).alias(n) for n in names]))


def loan_flags(df: DataFrame, products: Sequence[str] = LOAN_PRODUCTS) -> DataFrame:
    four, five = F.col("tx_mau4m_active") == 1, F.col("tx_mau5m_active") == 1
    return df.withColumns({
        "tx_loanApplicationflag_4m": eligible(products, four & (F.col("submittedappliction4m") == 0)),
        "tx_loanApplicationflag_5m": eligible(products, five & (F.col("submittedappliction5m") > 0)),
        "tx_loanApprovedflag_5m": eligible(products, five & (F.col("approved5m") > 0))})


def default_flags(df: DataFrame) -> DataFrame:
    clean4 = (F.col("tx_mau4m_active") == 1) & (F.col("npl") == 0) & (F.col("fspd304m") == 0)
    clean5 = (F.col("tx_mau5m_active") == 1) & (F.col("fspd305m") == 0)
    return df.withColumns({"tx_FSPD30_4m": eligible(DEFAULT_PRODUCTS, ~clean4),
                           "tx_FSPD30_5m": eligible(DEFAULT_PRODUCTS, ~clean5)})


def all_flags(mart: DataFrame, loans: DataFrame, buckets: DataFrame, delinquency: DataFrame, p: Params,
              products: Sequence[str] = LOAN_PRODUCTS) -> DataFrame:
    """Every flag and count, one row per customer of the mart, in the published order.

    The mart is that of ``flag_inputs``, which holds all loan counts but those of defaults.
    """
    df = with_counts(loan_keyed(churn_flags(active_flags(mart))), default_counts(mart, loans, buckets, delinquency, p), "_loan_key")
    return default_flags(loan_flags(df, products)).select(*FLAG_SCHEMA.fieldNames())


def flag_cross_tab(flags: DataFrame, by: Sequence[str], name: str = "customer_unq_cnt") -> DataFrame:
    """Distinct customers per combination; combinations with a NULL are left out."""
    known = flags.dropna(subset=list(by)).select(*by, "customer_id").distinct()
    return known.groupBy(*by).agg(F.count("customer_id").alias(name))


def modelling_table(flags: DataFrame, blocks: Sequence[DataFrame], key: str = "customer_id") -> DataFrame:
    """Flags and wide features of customers whose first product is eligible for the loan flags.

    Each block is unique on the key, so that there are as many rows as eligible customers.
    """
    return assemble(flags.filter(F.col("tx_first_product").isin(*LOAN_PRODUCTS)), blocks, key)


def applicants_among_borrowers(mart: DataFrame, loans: DataFrame, p: Params) -> DataFrame:
    """Customers active with a loan who applied within the first offset days, per first product.

    Applications reduce to days per customer; both ends of the range are times, as in the source.
    """
    borrowers = mart.filter((F.col("tx_cnt_total_transactions_bw_3m_and_4m") >= 1)
                            & (F.col("tx_cnt_active_loans_end_4m") >= 1)
                            & F.col("tx_first_product").isin(*LOAN_PRODUCTS_BASIC))
    times = (loans.select(F.col("customerId").cast("string").alias("_who"), F.col("startApplyDateTime").alias("_applied"))
             .distinct())
    start = F.col("registration_date")
    until = start + F.make_dt_interval(F.lit(p.offsets[0]))
    hit = (borrowers["customer_id"] == times["_who"]) & F.col("_applied").between(start, until)
    return (borrowers.join(times, hit, "left_semi").select("tx_first_product", "customer_id").distinct()
            .groupBy("tx_first_product").agg(F.count("customer_id").alias("n_applicants")))
