"""Demographic snapshot of a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientlens.functions.nulls import backfill
from clientlens.functions.rules import first_match, missing_flag
from clientlens.functions.scalars import (
    age_days, age_years, minutes_between, number_key, parse_day_month_year, parse_micro_timestamp)
from clientlens.operators.dedupe import first_per_key, latest_with_ties
from clientlens.operators.reshape import spread_by_kind
from clientlens.params import Params

# fixed values: product codes, region overrides, event sources, address columns to back-fill
PRODUCT_TYPES = {"LOAN1.0": "Borrow", "TSA1.0": "Save", "TSAE1.0": "Explore"}
REGION_OVERRIDES = {
    "KALINGA": "CAR – Cordillera Administrative Region",
    "OCCIDENTAL MINDORO": "MIMAROPA Region",
    "ORIENTAL MINDORO": "MIMAROPA Region",
    "ORODNIM": "MIMAROPA Region",
    "SAMAR (WESTERN SAMAR)": "Region VIII – Eastern Visayas",
    "ZAMBOANGA SIBUGAY": "Region IX – Zamboanga Peninsula",
}
LOCATION_SOURCES = {"Onboarding": "Onboarding", "Loan Journey": "loanjourney", "Apigee Logs": "ApigeeLogs"}
ADDRESS_PAIRS = [("city", "hm_city"), ("province", "hm_province"), ("barangay", "hm_barangay"), ("postalcode", "hm_postalcode")]
PAY_PERIODS = 12.5

# fixed values: published columns, in order, with their types
_TEXT, _WHOLE, _REAL, _TIME = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()
DETAIL_COLUMNS = ("addressline1", "city", "province", "barangay", "provinceCode", "postalcode", "mailingCity",
                  "mailingPostalCode", "mailingProvince", "natureofwork", "employmentstatus", "mobileOs", "docType")
DEMOGRAPHIC_FIELDS = [
    ("cust_id", _TEXT), ("onboardingDate", _TIME), ("kyc_status", _TEXT), ("educationdataflag", _WHOLE),
    ("education_id", _TEXT), ("Education_Type", _TEXT), ("clientdemographicflag", _WHOLE), ("user_id", _TEXT),
    ("device_id", _TEXT), ("created_dt", _TIME), ("gender", _TEXT), ("birthplace", _TEXT), ("mobile_no", _TEXT),
    ("product", _TEXT), ("type", _TEXT), ("telcoProvider", _TEXT), ("cdd_flag", _WHOLE), ("dateOfBirth", _TEXT),
    ("signUpAccNo", _TEXT), ("kycStatusfromCDD", _TEXT), *[(c, _TEXT) for c in DETAIL_COLUMNS],
    ("Minutestakentoonboard", _WHOLE), ("companyName", _TEXT), ("industry", _TEXT), ("device_dtl", _TEXT),
    ("Region_name", _TEXT), ("locationdfflag", _WHOLE), ("Onboarding_latitude", _TEXT), ("Onboarding_longitude", _TEXT),
    ("loanjourney_latitude", _TEXT), ("loanjourney_longitude", _TEXT), ("ApigeeLogs_latitude", _TEXT),
    ("ApigeeLogs_longitude", _TEXT), ("loandfFlag", _WHOLE), ("maritalStatus", _TEXT), ("dependentsCount", _TEXT),
    ("monthlyIncome", _TEXT), ("startApplyDateTime", _TIME), ("network_group", _TEXT), ("Source", _TEXT),
    ("media_source", _TEXT), ("partner", _TEXT), ("campaign", _TEXT), ("rnk", _WHOLE), ("Age", _REAL),
    ("SourceGroups", _TEXT), ("earliest_date", _TIME), ("months_difference", _REAL),
]
DEMOGRAPHIC_SCHEMA = T.StructType([
    T.StructField(n if n == "cust_id" else f"de_{n}", t) for n, t in DEMOGRAPHIC_FIELDS])
#: What the snapshot is joined with education by again: everything but the flags, the rank and education itself.
SNAPSHOT_COLUMNS = tuple(f.name for f in DEMOGRAPHIC_SCHEMA if f.name.removeprefix("de_") not in (
    "educationdataflag", "clientdemographicflag", "cdd_flag", "locationdfflag", "loandfFlag", "rnk", "education_id", "Education_Type"))


def education_levels(lookup: DataFrame) -> DataFrame:
    """Id and name of every education level; an id may have several names."""
    return lookup.filter(F.col("module") == "Education").select(
        F.col("id").alias("education_id"), F.col("description").alias("Education_Type")).distinct()


def highest_per_loan(education: DataFrame, levels: DataFrame) -> DataFrame:
    """Highest known level of each loan. Names come later, so that rows of a loan are added up before they move, once."""
    known = education.join(levels.select("education_id").distinct(), "education_id", "left_semi")
    return known.groupBy("digitalLoanAccountId").agg(F.max("education_id").alias("education_id"))


def highest_education(education: DataFrame, lookup: DataFrame, loans: DataFrame, cohort: DataFrame) -> DataFrame:
    """Highest education per loan, then per customer of the cohort; of several names the first one."""
    levels = education_levels(lookup)
    members = cohort.select(number_key(F.col("cust_id")).alias("customerId"))
    mine = loans.select("customerId", "digitalLoanAccountId").join(highest_per_loan(education, levels), "digitalLoanAccountId")
    named = first_per_key(mine.join(members, "customerId", "left_semi").select("customerId", "education_id"), ["customerId"],
                          [F.desc("education_id")]).join(first_per_key(levels, ["education_id"], [F.asc("Education_Type")]), "education_id")
    return named.select("customerId", "education_id", "Education_Type")


def highest_education_with_ties(education: DataFrame, lookup: DataFrame, loans: DataFrame) -> DataFrame:
    """Rows at the highest education of their customer, duplicates removed."""
    levels = education_levels(lookup)
    mine = loans.select("customerId", "digitalLoanAccountId").join(highest_per_loan(education, levels), "digitalLoanAccountId")
    return latest_with_ties(mine.select("customerId", "education_id").distinct(), ["customerId"], "education_id").join(
        levels, "education_id").select("customerId", "education_id", "Education_Type")


def _members(df: DataFrame, key: str, cohort: DataFrame | None) -> DataFrame:
    """Rows of the cohort; everything when the caller joins a cohort spine anyway."""
    if cohort is None:
        return df
    return df.join(cohort.select(F.col("cust_id").alias(key)), key, "left_semi")


def product_type(product: Column) -> Column:
    return first_match([(product == code, label) for code, label in PRODUCT_TYPES.items()], product)


def client_telco(customers: DataFrame, details: DataFrame, track: DataFrame, dump: DataFrame, cohort: DataFrame | None,
                 latest_only: bool = False) -> DataFrame:
    """Customer master with product type and network operator of the tracked device.

    One row per customer and operator, or, with ``latest_only``, the operator of the last dump.
    """
    name = F.col("GeneralData.telephony_info__network_operator_name")
    if latest_only:
        operators = first_per_key(dump.select("deviceId", "run_date", name.alias("telcoProvider")), ["deviceId"],
                                  [F.desc("run_date"), F.asc("telcoProvider")]).drop("run_date")
    else:
        operators = dump.select("deviceId", name.alias("telcoProvider")).distinct()
    refs = (details.select(F.col("custId").alias("cust_id"), F.col("deviceRef").cast("string").alias("deviceId"))
            .join(track.select(F.col("refno").cast("string").alias("deviceId")).distinct(), "deviceId", "left_semi"))
    people = _members(customers, "cust_id", cohort).withColumn("type", product_type(F.col("product")))
    return (people.join(refs, "cust_id").join(operators, "deviceId", "left")
            .select("cust_id", "user_id", "device_id", "created_dt", "gender", "birthplace", "mobile_no", "product",
                    "type", "telcoProvider").distinct())


def onboarding_details(details: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Customer details with the whole minutes between the two onboarding times."""
    minutes = F.abs(minutes_between(F.col("created_dt"), parse_micro_timestamp(F.col("onboardingDate"))))
    return _members(details, "custId", cohort).withColumn("Minutestakentoonboard", minutes)


def region_of(province: Column, mapped: Column) -> Column:
    return first_match([(province == name, label) for name, label in REGION_OVERRIDES.items()], mapped)


def region_mapping(customers: DataFrame, addresses: DataFrame, regions: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """Home address and region; the province meets the mapping on lowered names."""
    lookup = regions.select(F.lower("province").alias("_province"), F.col("Region_name").alias("_mapped"))
    return (_members(customers, "cust_id", cohort).select("user_id", "cust_id")
            .join(addresses, "user_id", "left")
            .join(lookup, F.lower("hm_province") == F.col("_province"), "left")
            .select("user_id", "cust_id", "hm_postalcode", "hm_barangay", "hm_city", "hm_province",
                    region_of(F.col("hm_province"), F.col("_mapped")).alias("Region_name")).distinct())


def latest_locations(gps: DataFrame, cohort: DataFrame) -> DataFrame:
    """Latest position per customer and event source, spread into one row."""
    kinds = {k: {f"{v}_latitude": F.col("latitude"), f"{v}_longitude": F.col("longitude")} for k, v in LOCATION_SOURCES.items()}
    latest = first_per_key(
        _members(gps, "customer_id", cohort)
        .filter(F.col("event_description").isin(*LOCATION_SOURCES)),
        ["customer_id", "event_description"], [F.desc("gps_collection_date"), F.asc("latitude"), F.asc("longitude")])
    spread = spread_by_kind(F.col("event_description"), kinds)
    return latest.groupBy("customer_id").agg(*[F.max(c).alias(n) for n, c in spread.items()])


def latest_loan_profile(loans: DataFrame, cohort: DataFrame) -> DataFrame:
    """Last loan row that gives a marital status, dependents or an income."""
    known = loans.filter(F.col("maritalStatus").isNotNull() | F.col("dependentsCount").isNotNull() | F.col("monthlyIncome").isNotNull())
    members = cohort.select(number_key(F.col("cust_id")).alias("customerId"))
    return first_per_key(known.join(members, "customerId", "left_semi"), ["customerId"],
                         [F.desc("startApplyDateTime"), F.asc("digitalLoanAccountId")]).select(
        "customerId", "maritalStatus", "dependentsCount", "monthlyIncome", "startApplyDateTime")


def demographic_snapshot(cohort: DataFrame, education: DataFrame, clients: DataFrame, details: DataFrame,
                         regions: DataFrame, locations: DataFrame, loans: DataFrame, p: Params) -> DataFrame:
    """Cohort with every demographic block, missing flags, back-filled address, age and months on book."""
    def keyed(df: DataFrame, key: str, marker: str) -> DataFrame:
        return df.withColumn(marker, F.col(key)).withColumnRenamed(key, "cust_id")

    text = lambda df: df.withColumn("customerId", F.col("customerId").cast("string"))
    facts = details.drop("created_dt", "onboardingDate", "deviceRef").withColumnRenamed("kycStatus", "kycStatusfromCDD")
    wide = (cohort
            .join(keyed(text(education), "customerId", "_education"), "cust_id", "left")
            .join(clients.withColumn("_client", F.col("cust_id")), "cust_id", "left")
            .join(keyed(facts, "custId", "_details"), "cust_id", "left")
            .join(regions.drop("user_id"), "cust_id", "left")
            .join(keyed(locations, "customer_id", "_location"), "cust_id", "left")
            .join(keyed(text(loans), "customerId", "_loan"), "cust_id", "left"))
    first_seen = F.least(F.col("onboarding_date").cast("timestamp_ntz"), F.col("startApplyDateTime"))
    days_known = F.floor(F.timestamp_diff("SECOND", F.col("earliest_date"), F.lit(p.as_of).cast("timestamp_ntz")) / 86400)
    cutoff = F.col(f"day_{p.offsets[0]}")
    return (backfill(wide, ADDRESS_PAIRS)
            .withColumns({"educationdataflag": missing_flag(F.col("_education")),
                          "clientdemographicflag": missing_flag(F.col("_client")),
                          "cdd_flag": missing_flag(F.col("_details")),
                          "locationdfflag": missing_flag(F.col("_location")),
                          "loandfFlag": missing_flag(F.col("_loan")),
                          "Age": age_years(age_days(parse_day_month_year(F.col("dateOfBirth")), cutoff)),
                          "earliest_date": first_seen,
                          "onboardingDate": F.col("onboarding_date").cast("timestamp_ntz")})
            .withColumn("months_difference", F.round(days_known / 30.44, 2))
            .drop("_education", "_client", "_details", "_location", "_loan", "onboarding_date"))


def demographic_details(customers: DataFrame, profiles: DataFrame, funds: DataFrame, jobs: DataFrame,
                        addresses: DataFrame, regions: DataFrame, cohort: DataFrame) -> DataFrame:
    """Source of funds, employment, income (also per year), address and region."""
    profile = profiles.select(F.col("deviceId").alias("device_id"), "sourceOfFundKey", "employmentStatusKey", "monthly_income")
    home = region_mapping(customers, addresses, regions, None).drop("user_id")
    return (customers.join(cohort, "cust_id", "left_semi").select("user_id", "cust_id", "device_id")
            .join(profile, "device_id", "left")
            .join(funds.select(F.col("id").alias("sourceOfFundKey"), F.col("description").alias("source_of_funds")), "sourceOfFundKey", "left")
            .join(jobs.select(F.col("id").alias("employmentStatusKey"), F.col("description").alias("employment_status")), "employmentStatusKey", "left")
            .join(home, "cust_id", "left")
            .withColumn("self_declared_annual_income", F.col("monthly_income").try_cast("double") * PAY_PERIODS)
            .select("user_id", "cust_id", "device_id", "source_of_funds", "employment_status", "monthly_income",
                    "self_declared_annual_income", "hm_postalcode", "hm_barangay", "hm_city", "hm_province", "Region_name")
            .distinct())


def publish(snapshot: DataFrame) -> DataFrame:
    """Prefix the columns and put them in the published order."""
    return snapshot.select(*[F.col(n).cast(t).alias(n if n == "cust_id" else f"de_{n}") for n, t in DEMOGRAPHIC_FIELDS]).distinct()


def with_latest_education(published: DataFrame, top: DataFrame) -> DataFrame:
    """The published snapshot without repeated rows, with every education at its customer's highest level.

    ``top`` is ``highest_education_with_ties``; two names at the highest level give two rows.
    """
    levels = top.select(F.col("customerId").cast("string").alias("cust_id"), F.col("education_id").alias("de_education_id"),
                        F.col("Education_Type").alias("de_Education_Type"))
    return published.select(*SNAPSHOT_COLUMNS).distinct().join(levels, "cust_id", "left")
