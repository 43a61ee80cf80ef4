"""Ad platforms: performance facts and campaign dimensions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from tributary.registry import register_engine
from tributary.sources.sinks import conform

# Star columns that have another name in a platform's unpacked rows, or
# that the platform cannot fill (account- or campaign-level reports).
OVERRIDES = {
    "facebook_ads": {"ad_group_id": "adset_id"},
    "instagram_ads": {"ad_group_id": "adset_id"},
    "bing_ads": dict.fromkeys(("campaign_id", "ad_group_id", "ad_id", "conversions"), "NULL"),
    "linkedin_ads": dict.fromkeys(("ad_group_id", "ad_id"), "NULL"),
}
AD_SOURCES = (
    "facebook_ads",
    "instagram_ads",
    "google_ads",
    "bing_ads",
    "linkedin_ads",
    "amazon_ads",
    "tiktok_ads",
)
PERFORMANCE_OBJECT = {
    "facebook_ads": "facebook_insights",
    "instagram_ads": "facebook_insights",
    "google_ads": "ad_performance",
    "bing_ads": "account_performance_report",
    "linkedin_ads": "ad_analytics_by_campaign",
    "amazon_ads": "sponsored_products_product_ads",
    "tiktok_ads": "ads_reports_daily",
}
CAMPAIGN_OBJECT = {s: "campaigns" for s in AD_SOURCES} | {"amazon_ads": "sponsored_products_campaigns"}


def ad_performance(rows: DataFrame, source: str) -> DataFrame:
    """Projection to the fact's columns; what the platform lacks is a typed NULL."""
    return conform(rows, "fct_ad_performance", **OVERRIDES.get(source, {}))


def campaigns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "tenant_slug",
        "source_platform",
        "campaign_id",
        "campaign_name",
        F.col("status").alias("campaign_status"),
    )


for _source in AD_SOURCES:
    register_engine(_source, "ad_performance", partial(ad_performance, source=_source))
    register_engine(_source, "campaigns", campaigns)
