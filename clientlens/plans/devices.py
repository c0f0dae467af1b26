"""Device and installed-app features as of an observation day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clientlens.functions.rules import first_match
from clientlens.functions.scalars import normalised_package
from clientlens.operators.dedupe import first_per_key
from clientlens.operators.quality import reach
from clientlens.operators.reshape import assemble, pivot_many
from clientlens.params import Params
from clientlens.plans.cohort import EXCLUDED_KYC

# fixed values: the app categories counted per customer, in output order ("Others" comes first)
APP_CATEGORIES = (
    "action", "adventure", "arcade", "art & design", "auto & vehicles", "beauty", "board",
    "books & reference", "business", "card", "casino", "casual", "comics", "communication",
    "dating", "education", "educational", "entertainment", "finance", "food & drink",
    "health & fitness", "lifestyle", "maps & navigation", "medical", "music", "music & audio",
    "news & magazines", "personalization", "photography", "productivity", "puzzle", "racing",
    "role playing", "shopping", "simulation", "social", "sports", "strategy", "tools",
    "travel & local", "trivia", "video players & editors", "weather", "word",
)
# fixed values: keyword categories, ratings and price labels that become columns
JOB_APPS = "(?i)linkedin|jobstreet|glint"
OFFICE_APPS = "(?i)office|gdrive|word|powerpoint|excel"
OTHERS = "Others"
KEYWORD_CATEGORIES = ("Job", "Professional")
RATINGS = ("rated for 12+", "rated for 16+", "rated for 18+")
PRICES = ("free", "pay", "undefined")
DEVICE_COLUMNS = ("brand", "device__brand", "device__manufacturer", "device__model",
                  "telephony_info__network_operator_name", "telephony_info__network_operator", "sim_operator_name")
SCORE_COLUMNS = ("creditScoreUpdated", "fraudScore", "fraudScoreUpdated")


def category_columns() -> tuple[str, ...]:
    return (OTHERS, *APP_CATEGORIES, *KEYWORD_CATEGORIES)


def published_name(label: str) -> str:
    """'auto & vehicles' to cl_pkg_auto_vehicles, 'rated for 12+' to cl_pkg_rated_for_12_plus.

    One rule for all labels: letters, digits and underscores only, so that the columns need no quoting.
    """
    cleaned = label.replace("+", "_plus").replace("&", " ")
    return "cl_pkg_" + "_".join(cleaned.split())


def device_schema(p: Params) -> T.StructType:
    text, real, time = T.StringType(), T.DoubleType(), T.TimestampNTZType()
    fields = [("cust_id", text), ("onboardingDate", time), *[(f"cl_day_{n}", time) for n in p.offsets], ("cl_kycStatus", text),
              *[(f"cl_{c}", text) for c in SCORE_COLUMNS], ("cl_run_date", time), *[(f"cl_{c}", text) for c in DEVICE_COLUMNS],
              ("cl_first_install_time", time),
              *[(published_name(c), real) for c in (*category_columns(), *RATINGS, *PRICES)]]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def tracked_devices(cohort: DataFrame, details: DataFrame, track: DataFrame, p: Params) -> DataFrame:
    """Customers with the distinct score records of their device made on or before the cutoff day."""
    cutoff = F.col(f"day_{p.offsets[0]}")
    refs = details.select(F.col("custId").alias("cust_id"), F.col("kycStatus"), F.col("deviceRef").cast("string").alias("deviceId"))
    records = track.select(F.col("refno").cast("string").alias("deviceId"), "createdOn", *SCORE_COLUMNS)
    return (cohort.drop("kyc_status").join(refs, "cust_id").join(records, "deviceId")
            .filter(F.to_date("createdOn") <= cutoff).drop("createdOn").distinct())


def dumped_by(devices: DataFrame, p: Params) -> DataFrame:
    """Distinct customer-device pairs with the day up to which dumps count."""
    return devices.select("cust_id", "deviceId", F.col(f"day_{p.offsets[0]}").alias("cutoff")).distinct()


def installed_apps(apps: DataFrame) -> DataFrame:
    """One row per array element; devices with an empty or missing array vanish."""
    return apps.select("deviceId", F.to_date("run_date").alias("dump_day"), F.explode("Application").alias("app")).select(
        "deviceId", "dump_day", "app.package_name", "app.first_install_time")


def device_packages(apps: DataFrame, devices: DataFrame, p: Params | None = None) -> DataFrame:
    """Packages per tracked device and dump day with their earliest install.

    Inventories of other devices go before their arrays are exploded, and with ``p`` those dumped after the last cutoff
    of their device, which count for nobody. Everything about apps builds on this table. A caller with several uses writes
    it, or what it needs of it, once.
    """
    if p is None:
        mine = apps.join(devices.select("deviceId").distinct(), "deviceId", "left_semi")
    else:
        last = dumped_by(devices, p).groupBy("deviceId").agg(F.max("cutoff").alias("cutoff"))
        mine = apps.filter(F.size("Application") > 0).join(last, "deviceId").filter(F.to_date("run_date") <= F.col("cutoff"))
    return (installed_apps(mine).groupBy("deviceId", "package_name", "dump_day")
            .agg(F.min("first_install_time").alias("first_install_time")))


def equipped(apps: DataFrame) -> DataFrame:
    """Devices with any app. Those of ``device_packages`` without parameters are the tracked ones among them."""
    return apps.filter(F.size("Application") > 0).select("deviceId")


def _dumped(devices: DataFrame, dump: DataFrame, with_apps: DataFrame, p: Params) -> DataFrame:
    """Tracked devices that are in ``with_apps`` with their dumps on or before the cutoff."""
    cutoff = F.col(f"day_{p.offsets[0]}")
    flat = dump.select(
        F.col("deviceId").alias("_dumped"), "run_date", "GeneralInfo.brand", "Hardware.device__brand",
        "Hardware.device__manufacturer", "Hardware.device__model", "GeneralData.telephony_info__network_operator_name",
        "GeneralData.telephony_info__network_operator", "GeneralData.sim_operator_name")
    mine = devices.join(with_apps.select("deviceId").distinct(), "deviceId", "left_semi")
    joined = mine.join(flat, (mine["deviceId"] == F.col("_dumped")) & (F.to_date("run_date") <= cutoff), "left")
    return joined.drop("_dumped", "deviceId")


def device_snapshot(devices: DataFrame, dump: DataFrame, with_apps: DataFrame, p: Params) -> DataFrame:
    """Distinct device attributes dumped on or before the cutoff, for devices that are in ``with_apps``.

    The cutoff belongs to the join with the dump: a customer whose dumps are all later keeps a row.
    """
    return _dumped(devices, dump, with_apps, p).distinct()


def latest_snapshot(devices: DataFrame, dump: DataFrame, with_apps: DataFrame, p: Params) -> DataFrame:
    """The row of ``device_snapshot`` that ``latest_dump`` keeps of a customer's device mart.

    Chosen before anything joins it and among repeated rows, so that of a customer one row leaves each task. What the mart adds
    is the same in all rows of a customer. Dumps after the last cutoff of all, which no device can use, do not move.
    """
    last = devices.agg(F.max(f"day_{p.offsets[0]}")).scalar()
    found = _dumped(devices, dump.filter(F.to_date("run_date") <= last), with_apps, p).filter(~F.col("kycStatus").eqNullSafe(EXCLUDED_KYC))
    order = ["onboarding_date", *[f"day_{n}" for n in p.offsets], "kycStatus", *SCORE_COLUMNS, *DEVICE_COLUMNS]
    return first_per_key(found, ["cust_id"], [F.col("run_date").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order]])


def earliest_install(devices: DataFrame, packages: DataFrame, p: Params) -> DataFrame:
    """Earliest install time per customer, from dumps up to the cutoff; one row per device and day before the join.

    ``packages`` are those of devices, or those of customers (``customer_packages``), whose dumps are chosen already.
    """
    if "cust_id" in packages.columns:
        return packages.groupBy("cust_id").agg(F.min("first_install_time").alias("first_install_time"))
    per_day = packages.groupBy("deviceId", "dump_day").agg(F.min("first_install_time").alias("first_install_time"))
    return (dumped_by(devices, p).join(per_day, "deviceId").filter(F.col("dump_day") <= F.col("cutoff"))
            .groupBy("cust_id").agg(F.min("first_install_time").alias("first_install_time")))


def customer_packages(devices: DataFrame, packages: DataFrame, p: Params) -> DataFrame:
    """Distinct customer-package pairs with their earliest install, from dumps up to the cutoff."""
    return (dumped_by(devices, p).join(packages, "deviceId").filter(F.col("dump_day") <= F.col("cutoff"))
            .groupBy("cust_id", "package_name").agg(F.min("first_install_time").alias("first_install_time")))


def keyword_category(name: Column, category: Column) -> Column:
    """Keyword rules win over the catalogue."""
    return first_match([(name.rlike(JOB_APPS), "Job"), (name.rlike(OFFICE_APPS), "Professional")], category)


def catalogue(raw: DataFrame) -> DataFrame:
    """App catalogue with normalised names and keyword categories."""
    return raw.select(normalised_package(F.col("package_name")).alias("package"),
                      keyword_category(F.col("package_name"), F.col("category")).alias("category"),
                      "rating", "rating_description", "is_paid")


def categorised(packages: DataFrame, apps: DataFrame) -> DataFrame:
    """Customer packages with category, rating and price; unlisted ones are 'Others'.

    The reference frame is a full outer merge whose rows without a customer are dropped right
    after, which is a left join.
    """
    return (packages.withColumn("package", normalised_package(F.col("package_name")))
            .join(catalogue(apps), "package", "left")
            .withColumn("category", F.coalesce("category", F.lit(OTHERS))))


def app_counts(rows: DataFrame) -> DataFrame:
    """Distinct packages per customer by category, rating and price, in one pass.

    Categories count 0 where a customer has none, ratings stay NULL, prices count 0 for customers
    with any priced package. ``unlisted_*`` count what is in none of the columns, so that nothing vanishes.
    """
    wide = pivot_many(rows, "cust_id", "package",
                      {"category": ("category", category_columns()), "rating": ("rating", RATINGS), "price": ("is_paid", PRICES)},
                      present={"priced": "is_paid"})
    count = lambda prefix, label: F.col(f"`{prefix}:{label}`")
    zero = F.lit(0)
    cells = [(x, F.coalesce(count("category", x), zero)) for x in category_columns()]
    cells += [(x, count("rating", x)) for x in RATINGS]
    cells += [(x, F.when(F.col("priced").isNotNull(), F.coalesce(count("price", x), zero))) for x in PRICES]
    rest = [F.coalesce(count(k, "*"), zero).alias(f"unlisted_{k}") for k in ("category", "rating", "price")]
    return wide.select("cust_id", *[c.cast("double").alias(published_name(x)) for x, c in cells], *rest)


def purchase_date(rows: DataFrame) -> DataFrame:
    """Earliest install of an uncategorised (pre-installed) app as the purchase date."""
    return (rows.filter(F.col("category") == OTHERS).groupBy("cust_id")
            .agg(F.min("first_install_time").alias("device_purchase_date")))


def device_mart(snapshot: DataFrame, installs: DataFrame, counts: DataFrame, p: Params) -> DataFrame:
    """Snapshot with install time and app counts, without BKYC; a NULL status stays."""
    wide = assemble(snapshot, [installs, counts], "cust_id").filter(~F.col("kycStatus").eqNullSafe(EXCLUDED_KYC))
    return wide.select(
        "cust_id", F.col("onboarding_date").cast("timestamp_ntz").alias("onboardingDate"),
        *[F.col(f"day_{n}").cast("timestamp_ntz").alias(f"cl_day_{n}") for n in p.offsets],
        *[F.col(c).alias(f"cl_{c}") for c in ("kycStatus", *SCORE_COLUMNS, "run_date", *DEVICE_COLUMNS, "first_install_time")],
        *[published_name(c) for c in (*category_columns(), *RATINGS, *PRICES)])


def latest_dump(mart: DataFrame) -> DataFrame:
    """One row per customer of the device mart: the latest dump, ties by the remaining columns."""
    rest = [c for c in mart.columns if c not in ("cust_id", "cl_run_date")]
    return first_per_key(mart, ["cust_id"], [F.col("cl_run_date").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest]])


def package_reach(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct customers per category or rating."""
    return reach(rows, by, "cust_id", "n_customers")
