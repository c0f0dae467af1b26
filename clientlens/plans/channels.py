"""Acquisition channel, channel group, mobile network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clientlens.functions.rules import first_match, lookup
from clientlens.functions.scalars import phone_prefix
from clientlens.params import Params

# fixed values: source texts and the channel they stand for, first match wins
# (how to compare, text, channel); "lowered" tests run on the lowered source
SOURCE_RULES_BEFORE_REFERRAL = [
    ("lowered contains", "social", "Social"),
    ("equals", "af_app_invites", "FWB"),
]
SOURCE_RULES = [
    ("lowered contains", "refer", "FWB"),
    ("lowered contains", "moengage", "FWB"),
    ("lowered contains", "apple search ads", "AppleSearch"),
    ("contains", "Facebook Ads", "Ads_Meta"),
    ("contains", "meta", "Ads_Meta"),
    ("equals", "facebook", "Ads_Meta"),
    ("lowered equals", "restricted", "Ads_Meta"),
    ("contains", "google", "Ads_Google"),
    ("contains", "bytedanceglobal", "TikTok_Paid"),
    ("lowered contains", "pokkt", "Aff_Pokkt"),
    ("contains", "{bank}_CPA", "Aff_Pokkt"),
    ("contains", "campaign_name", "Aff_Pokkt"),
    ("lowered equals", "tyrads_int", "Aff_TyrAds"),
    ("lowered equals", "tjzymob_int", "Aff_TyrAds"),
    ("lowered equals", "tyrads", "Aff_TyrAds"),
    ("lowered equals", "ta_{bank}_aos_ph", "Aff_TyrAds"),
    ("lowered contains", "salesdoubler", "Aff_SalesDoubler"),
    ("contains", "imoney", "Aff_iMoney"),
    ("contains", "moneymax", "Aff_MoneyMax"),
    ("contains", "jeff", "Aff_Jeff"),
    ("contains", "shareit", "Aff_ShareIt"),
    ("contains", "appnext", "Aff_AppNext"),
    ("lowered contains", "mediadonuts", "Aff_Mediadonuts"),
    ("lowered contains", "entravision", "Aff_Mediadonuts"),
    ("lowered contains", "shopback_int", "Aff_Shopback"),
    ("lowered contains", "deepsea", "Aff_DeepSea"),
    ("contains", "avow", "Aff_AvowTech"),
    ("contains", "vivo", "Aff_Vivo"),
    ("contains", "SevenEleven", "SevenEleven"),
    ("equals", "af_banner", "af_Banner"),
    ("contains", "sendgrid", "Organic"),
    ("equals", "Website", "Website"),
]
MEDIA_RULES = {
    "PRFlexLoans_WebAndroidPressRelease": "Owned Media",
    "invalid_media_source_name": "Invalid Media Source",
    "None": "Broken OneLink",
}

# fixed values: channel to channel group
DIRECT = ("Ads_Google", "Ads_Meta", "AppleSearch", "FWB", "TikTok_Paid")
AFFILIATES = ("Aff_AppNext", "Aff_AvowTech", "Aff_DeepSea", "Aff_Jeff", "Aff_Mediadonuts", "Aff_MoneyMax", "Aff_Pokkt",
              "Aff_SalesDoubler", "Aff_ShareIt", "Aff_Shopback", "Aff_TyrAds", "Aff_Vivo", "Aff_iMoney", "acesaatchi")
ORGANIC = ("Organic", "Social", "Website", "af_Banner")
OTHERS = ("Broken OneLink", "Email", "OpsEngine_post", "Owned Media", "Partnership", "SevenEleven", "Test", "{bank}_PHL_default")


def acquisition_channel(media: Column, partner: Column, campaign: Column, p: Params) -> Column:
    """Channel of an install: the first rule that fits, else the raw source.

    A contained text is a LIKE pattern: its underscores stand for any character.
    """
    source = F.coalesce(media, partner, campaign)
    lowered = F.lower(source)

    def test(how: str, text: str) -> Column:
        side = lowered if how.startswith("lowered") else source
        text = text.format(bank=p.bank.lower() if how.startswith("lowered") else p.bank)
        return side.like(f"%{text}%") if how.endswith("contains") else side == text

    referral = (media.isNull() | (media == "invalid_media_source_name")) & F.lower(campaign).contains("refer")
    rules = [(test(how, text), label) for how, text, label in SOURCE_RULES_BEFORE_REFERRAL]
    rules.append((referral, "FWB"))
    rules += [(test(how, text), label) for how, text, label in SOURCE_RULES]
    rules += [(media == text, label) for text, label in MEDIA_RULES.items()]
    rules.append((source.isNull(), "Organic"))
    return first_match(rules, source)


def channel_group(channel: Column, p: Params) -> Column:
    """Direct, Affiliates, Organic or Others; NULL for an unlisted channel."""
    members = {"Direct": DIRECT, "Affiliates": AFFILIATES, "Organic": ORGANIC, "Others": OTHERS}
    return lookup(channel, {c.format(bank=p.bank): group for group, names in members.items() for c in names})


def with_network(df: DataFrame, carriers: DataFrame, number: str = "mobile_no") -> DataFrame:
    """Network group and prepaid or postpaid, from the three- and the four-digit prefix."""
    def side(tag: str) -> DataFrame:
        return carriers.select(F.col("number_prefix").cast("string").alias(f"_prefix_{tag}"),
                               F.col("network_group").alias(f"_group_{tag}"), F.col("network").alias(f"_network_{tag}"))

    phone = F.col(number)
    short, long = F.col("_group_short"), F.col("_network_long")
    plan = first_match([
        ((short == "Globe") & long.isNull(), "Prepaid"),
        ((short == "Globe") & long.isNotNull(), "Postpaid"),
        ((short == "Smart") & (phone.startswith("63920") | phone.startswith("63918")), "Postpaid"),
        (~short.isin("Globe", "Smart"), F.lit(None).cast("string")),
    ], F.lit("Prepaid"))
    return (df.join(side("short"), phone_prefix(phone, 3) == F.col("_prefix_short"), "left")
            .join(side("long"), phone_prefix(phone, 4) == F.col("_prefix_long"), "left")
            .withColumns({"network_group": F.coalesce(F.col("_group_long"), short), "network": plan})
            .drop(*[f"_{c}_{t}" for c in ("prefix", "group", "network") for t in ("short", "long")]))


def customer_channels(customers: DataFrame, cohort: DataFrame, link: DataFrame, carriers: DataFrame, p: Params) -> DataFrame:
    """One row per cohort customer: network and the channel of the earliest install."""
    installs = link.select(F.col("customer_user_id").alias("cust_id"), "install_id", "install_time",
                           "media_source", "partner", "campaign")
    order = W.partitionBy("cust_id").orderBy(F.asc("install_time"), F.asc("install_id"))
    one = installs.withColumn("rnk", F.row_number().over(order)).filter("rnk = 1")
    rows = with_network(customers.join(cohort, "cust_id", "left_semi"), carriers).join(one, "cust_id", "left")
    channel = acquisition_channel(F.col("media_source"), F.col("partner"), F.col("campaign"), p)
    return (rows.withColumn("Source", channel)
            .select("cust_id", "network_group", "network", "Source", channel_group(F.col("Source"), p).alias("SourceGroups"),
                    "media_source", "partner", "campaign", F.coalesce("rnk", F.lit(1)).cast("bigint").alias("rnk")))
