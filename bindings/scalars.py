"""Scalar functions and the former row functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Context, query
from clientlens.functions import nulls, rules, scalars as sc
from clientlens.operators import quality
from clientlens.plans import channels as ch, demographics as de, devices as dv
from clientlens.plans.cohort import cohort
from clientlens.sources import readers, standins


@query("f1_lower", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def _(c: Context):
    return c.customer.select("c_custkey", F.lower("c_mktsegment").alias("segment"))


@query("f2_left_right_length", """
    SELECT cust_id, left(right(mobile_no, length(mobile_no) - 2), 3) AS p3, left(right(mobile_no, length(mobile_no) - 2), 4) AS p4 FROM customers""")
def _(c: Context):
    return c.role("customers").select("cust_id", sc.phone_prefix(F.col("mobile_no"), 3).alias("p3"), sc.phone_prefix(F.col("mobile_no"), 4).alias("p4"))


@query("f3_regex_replace", "SELECT package_name, regexp_replace(package_name, '[ ._]', '', 'g') AS package FROM app_catalogue")
def _(c: Context):
    return c.role("app_catalogue").select("package_name", sc.normalised_package(F.col("package_name")).alias("package"))


@query("f4_regex_search", """
    SELECT package_name, regexp_matches(package_name, '(?i)linkedin|jobstreet|glint') AS is_job FROM app_catalogue""")
def _(c: Context):
    return c.role("app_catalogue").select("package_name", F.col("package_name").rlike(dv.JOB_APPS).alias("is_job"))


@query("f5_coalesce", "SELECT install_id, coalesce(media_source, partner, campaign) AS source FROM installs")
def _(c: Context):
    return c.role("installs").select("install_id", F.coalesce("media_source", "partner", "campaign").alias("source"))


@query("f6_ifnull_sentinel", """
    SELECT digitalLoanAccountId, ifnull(cast(decision_date AS date), DATE '9999-12-31') AS decided FROM loans""")
def _(c: Context):
    return c.role("loans").select("digitalLoanAccountId", F.coalesce(F.to_date("decision_date"), F.lit("9999-12-31").cast("date")).alias("decided"))


@query("f7_least", """
    SELECT digitalLoanAccountId, least(approvedDateTime, decision_date, disbursementdatetime, startApplyDateTime) AS first_time FROM loans""")
def _(c: Context):
    return c.role("loans").select("digitalLoanAccountId", F.least("approvedDateTime", "decision_date", "disbursementdatetime", "startApplyDateTime").alias("first_time"))


@query("f8_if", "SELECT digitalLoanAccountId, CASE WHEN reloan_flag = 1 THEN 'Reloan' ELSE new_loan_type END AS loan_type FROM loans")
def _(c: Context):
    return c.role("loans").select("digitalLoanAccountId", F.when(F.col("reloan_flag") == 1, "Reloan").otherwise(F.col("new_loan_type")).alias("loan_type"))


@query("f9_searched_case", """
    SELECT cust_id, CASE WHEN product = 'LOAN1.0' THEN 'Borrow' WHEN product = 'TSA1.0' THEN 'Save' WHEN product = 'TSAE1.0' THEN 'Explore' ELSE product END AS type,
           CASE WHEN product = 'LOAN1.0' THEN 1 END AS borrows FROM customers""")
def _(c: Context):
    return c.role("customers").select("cust_id", de.product_type(F.col("product")).alias("type"), F.when(F.col("product") == "LOAN1.0", 1).alias("borrows"))


@query("f10_nested_case", """
    SELECT customer_id, CASE WHEN tx_first_product IN ('Individual Stash', 'Group Stash', 'Bills Pay', 'Unsecured Loan')
        THEN CASE WHEN tx_cnt_total_transactions_bw_3m_and_4m >= 1 THEN cast(0 AS bigint) ELSE 1 END END AS inactive FROM behaviour_mart""")
def _(c: Context):
    from clientlens.plans.flags import CHURN_PRODUCTS, eligible
    return c.role("behaviour_mart").select("customer_id", eligible(CHURN_PRODUCTS, ~(F.col("tx_cnt_total_transactions_bw_3m_and_4m") >= 1)).alias("inactive"))


@query("f11_ordered_rules", "SELECT install_id, channel FROM install_channels")
def _(c: Context):
    channel = ch.acquisition_channel(F.col("media_source"), F.col("partner"), F.col("campaign"), c.p)
    return c.role("installs").select("install_id", channel.alias("channel"))


@query("f12_missing_indicator", """
    SELECT c_custkey, CASE WHEN u.user_id IS NULL THEN cast(1 AS bigint) ELSE 0 END AS no_events FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = c_custkey""")
def _(c: Context):
    seen = c.events.select("user_id").distinct()
    return c.customer.join(seen, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", rules.missing_flag(F.col("user_id")).alias("no_events"))


@query("f13_cast", """
    SELECT deviceId, try_cast(monthly_income AS double) AS income, cast(sourceOfFundKey AS varchar) AS funds_text FROM financial_profile""")
def _(c: Context):
    return c.role("financial_profile").select("deviceId", F.col("monthly_income").try_cast("double").alias("income"), F.col("sourceOfFundKey").cast("string").alias("funds_text"))


@query("f14_date_truncation", "SELECT event_id, cast(ts AS date) AS day, DATE '2024-01-01' AS start_date FROM events")
def _(c: Context):
    return c.events.select("event_id", F.to_date("ts").alias("day"), F.lit("2024-01-01").cast("date").alias("start_date"))


@query("f15_date_diff", """
    SELECT digitalLoanAccountId, datediff('day', cast(startApplyDateTime AS date), cast(disbursementdatetime AS date)) AS days FROM loans""")
def _(c: Context):
    return c.role("loans").select("digitalLoanAccountId", F.datediff("disbursementdatetime", "startApplyDateTime").cast("bigint").alias("days"))


@query("f16_date_add_sub", """
    SELECT cust_id, cast(cast(created_dt AS date) + INTERVAL 120 DAY AS date) AS later, cast(cast(created_dt AS date) - INTERVAL 1 DAY AS date) AS before FROM customers""")
def _(c: Context):
    day = F.to_date("created_dt")
    return c.role("customers").select("cust_id", F.date_add(day, 120).alias("later"), F.date_sub(day, 1).alias("before"))


@query("f17_minutes", "SELECT event_id, date_sub('minute', ts, TIMESTAMP '2024-01-15 12:00:30') AS minutes FROM events")
def _(c: Context):
    return c.events.select("event_id", sc.minutes_between(F.col("ts"), F.lit("2024-01-15 12:00:30").cast("timestamp_ntz")).alias("minutes"))


@query("f18_abs", "SELECT c_custkey, abs(c_acctbal) AS size FROM customer")
def _(c: Context):
    return c.customer.select("c_custkey", F.abs("c_acctbal").alias("size"))


@query("f19_parse_timestamp", """
    SELECT custId, try_strptime(onboardingDate, '%Y-%m-%d %H:%M:%S.%f') AS onboarded FROM customer_details""")
def _(c: Context):
    return c.role("customer_details").select("custId", sc.parse_micro_timestamp(F.col("onboardingDate")).alias("onboarded"))


@query("f20_parse_birth_date", "SELECT custId, cast(try_strptime(dateOfBirth, '%d %b %Y') AS date) AS born FROM customer_details")
def _(c: Context):
    return c.role("customer_details").select("custId", sc.parse_day_month_year(F.col("dateOfBirth")).alias("born"))


@query("f21_coerced_timestamp", "SELECT custId, try_cast(onboardingDate AS timestamp) AS at FROM customer_details")
def _(c: Context):
    return c.role("customer_details").select("custId", F.col("onboardingDate").try_cast("timestamp_ntz").alias("at"))


@query("f22_age_in_days", """
    SELECT custId, datediff('day', cast(try_strptime(dateOfBirth, '%d %b %Y') AS date), DATE '2002-01-01') AS age_days FROM customer_details""")
def _(c: Context):
    born = sc.parse_day_month_year(F.col("dateOfBirth"))
    return c.role("customer_details").select("custId", sc.age_days(born, F.lit(c.p.as_of).cast("date")).alias("age_days"))


@query("f23_whole_years", """
    SELECT custId, cast(floor(datediff('day', cast(try_strptime(dateOfBirth, '%d %b %Y') AS date), DATE '2002-01-01') / 365) AS bigint) AS age FROM customer_details""")
def _(c: Context):
    born = sc.parse_day_month_year(F.col("dateOfBirth"))
    return c.role("customer_details").select("custId", sc.age_years(sc.age_days(born, F.lit(c.p.as_of).cast("date"))).alias("age"))


OFFSETS = "SELECT cust_id, cast(created_dt AS date) + 120 AS day_120, cast(created_dt AS date) + 150 AS day_150 FROM customers"


@query("f24_offset_dates", OFFSETS)
def _(c: Context):
    days = sc.offset_dates(F.to_date("created_dt"), c.p.offsets)
    return c.role("customers").select("cust_id", *[d.alias(n) for n, d in days.items()])


@query("f25_earliest_of_two", "SELECT digitalLoanAccountId, least(decision_date, disbursementdatetime) AS first_time FROM loans")
def _(c: Context):
    return c.role("loans").select("digitalLoanAccountId", F.least("decision_date", "disbursementdatetime").alias("first_time"))


@query("f26_months_on_book", "SELECT cust_id, round(datediff('day', cast(created_dt AS date), DATE '2002-01-01') / 30.44::double, 2) AS months FROM customers")
def _(c: Context):
    return c.role("customers").select("cust_id", sc.months_on_book(F.to_date("created_dt"), F.lit(c.p.as_of).cast("date")).alias("months"))


@query("f27_arithmetic", """
    SELECT deviceId, try_cast(monthly_income AS double) * 12.5::double AS yearly FROM financial_profile""")
def _(c: Context):
    return c.role("financial_profile").select("deviceId", (F.col("monthly_income").try_cast("double") * de.PAY_PERIODS).alias("yearly"))


@query("f28_fill_from_column", """
    SELECT custId, coalesce(city, mailingCity) AS city, coalesce(province, mailingProvince) AS province FROM customer_details""")
def _(c: Context):
    rows = c.role("customer_details").select("custId", "city", "mailingCity", "province", "mailingProvince")
    return nulls.backfill(rows, [("city", "mailingCity"), ("province", "mailingProvince")])


@query("f29_fill_constant", "SELECT install_id, coalesce(media_source, 'Others') AS media_source, coalesce(campaign, 'Others') AS campaign FROM installs")
def _(c: Context):
    return c.role("installs").select("install_id", "media_source", "campaign").fillna("Others")


@query("f30_fill_by_type", """
    SELECT digitalLoanAccountId, coalesce(approvedLoanTenure, -1) AS approvedLoanTenure, coalesce(decision_date, TIMESTAMP '1900-01-01') AS decision_date,
           coalesce(maritalStatus, 'Unknown') AS maritalStatus FROM loans""")
def _(c: Context):
    return nulls.fill_by_type(c.role("loans").select("digitalLoanAccountId", "approvedLoanTenure", "decision_date", "maritalStatus"))


@query("f31_where", """
    SELECT package_name, CASE WHEN regexp_matches(package_name, '(?i)linkedin|jobstreet|glint') THEN 'Job' ELSE category END AS category FROM app_catalogue""")
def _(c: Context):
    name = F.col("package_name")
    return c.role("app_catalogue").select("package_name", F.when(name.rlike(dv.JOB_APPS), "Job").otherwise(F.col("category")).alias("category"))


@query("f32_dictionary_lookup", "SELECT install_id, channel, channel_group FROM install_channels")
def _(c: Context):
    channel = ch.acquisition_channel(F.col("media_source"), F.col("partner"), F.col("campaign"), c.p)
    return (c.role("installs").withColumn("channel", channel)
            .select("install_id", "channel", ch.channel_group(F.col("channel"), c.p).alias("channel_group")))


@query("f33_type_casts", """
    SELECT c_custkey, cast(cast(c_custkey AS double) AS bigint) AS whole, cast(c_custkey AS varchar) AS text FROM customer""")
def _(c: Context):
    return c.customer.select("c_custkey", F.round(F.col("c_custkey").cast("double"), 0).cast("bigint").alias("whole"), sc.whole_text_key(F.col("c_custkey").cast("double")).alias("text"))


@query("f34_struct_field", """
    SELECT deviceId, run_date, brand, device__model AS model, sim_operator_name AS sim FROM device_rows""")
def _(c: Context):
    dump = standins.device_dump(c.role("device_rows")).alias("t4")
    return dump.select("t4.deviceId", "t4.run_date", "t4.GeneralInfo.brand", F.col("t4.Hardware.device__model").alias("model"),
                       F.col("t4.GeneralData.sim_operator_name").alias("sim"))


@query("f35_unnested_field", "SELECT deviceId, package_name FROM app_rows")
def _(c: Context):
    return standins.device_apps(c.role("device_rows")).select("deviceId", F.explode("Application").alias("app")).select("deviceId", F.col("app.package_name"))


@query("f36_date_part", "SELECT transactionid, cast(postingdate AS date) AS day FROM postings")
def _(c: Context):
    return c.role("postings").select("transactionid", F.to_date("postingdate").alias("day"))


# fixed values: columns of the loans
LOAN_COLUMNS = (
    "customerId", "digitalLoanAccountId", "loanAccountNumber", "applicationStatus", "new_loan_type", "reloan_flag",
    "flagApproval", "flagDisbursement", "startApplyDateTime", "approvedDateTime", "decision_date", "disbursementdatetime",
    "loanRequestTenure", "approvedLoanTenure", "loanRequestAmount", "approvedLoanAmount", "disbursedLoanAmount", "obsFPD10",
    "obsFPD30", "Max_Ever_DPD", "maritalStatus", "dependentsCount", "monthlyIncome")


@query("f37_null_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, count(*) FILTER ({name} IS NULL) AS n_null FROM loans" for name in LOAN_COLUMNS))
def _(c: Context):
    return quality.null_counts(c.role("loans"))


@query("d1f_age_function", """
    SELECT custId, datediff('day', cast(try_strptime(dateOfBirth, '%d %b %Y') AS date), cast(created_dt AS date)) AS age_days FROM customer_details""")
def _(c: Context):
    return c.role("customer_details").select("custId", sc.age_days(sc.parse_day_month_year(F.col("dateOfBirth")), F.to_date("created_dt")).alias("age_days"))


@query("d2f_add_age_column", """
    SELECT custId, dateOfBirth, datediff('day', cast(try_strptime(dateOfBirth, '%d %b %Y') AS date), DATE '2002-01-01') AS AgeInDays FROM customer_details""")
def _(c: Context):
    def with_age(df, born, as_of, name):
        return df.withColumn(name, sc.age_days(sc.parse_day_month_year(F.col(born)), F.lit(as_of).cast("date")))
    return c.role("customer_details").select("custId", "dateOfBirth").transform(with_age, "dateOfBirth", c.p.as_of, "AgeInDays")


@query("d3f_categorise_package", """
    SELECT package_name, CASE WHEN regexp_matches(package_name, '(?i)linkedin|jobstreet|glint') THEN 'Job'
        WHEN regexp_matches(package_name, '(?i)office|gdrive|word|powerpoint|excel') THEN 'Professional' ELSE 'Other' END AS category FROM app_catalogue""")
def _(c: Context):
    name = F.col("package_name")
    return c.role("app_catalogue").select("package_name", dv.keyword_category(name, F.lit("Other")).alias("category"))


@query("d4f_one_day_cohort", """
    SELECT cust_id, kyc_status, onboarding_date, day_120, day_150 FROM cohort WHERE onboarding_date = DATE '1995-03-01'""")
def _(c: Context):
    from dataclasses import replace
    day = replace(c.p, cohort_from="1995-03-01", cohort_to="1995-03-01")
    return cohort(c.role("customers"), day)


@query("d5f_date_range", """
    SELECT day, count(o_orderkey) AS n FROM (SELECT cast(unnest(generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY)) AS date) AS day) d
    LEFT JOIN orders ON cast(o_orderdate AS date) = day GROUP BY day""")
def _(c: Context):
    days = readers.calendar(c.spark, "1996-01-01", "1996-04-01")
    counted = c.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("d6f_observation_dates", OFFSETS)
def _(c: Context):
    return c.role("customers").select("cust_id", F.to_date("created_dt").alias("d")).withColumns(
        sc.offset_dates(F.col("d"), c.p.offsets)).drop("d")
