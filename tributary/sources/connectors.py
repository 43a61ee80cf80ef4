"""The connector catalogue: 13 sources, their versions, hub ids and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.sources.local import local_frame

# Source, version, hub model id, objects.
CONNECTORS = (
    ("linkedin_ads", "v202401", "linkedin_ads_api_v1", ("campaigns", "ad_analytics", "ad_analytics_by_campaign")),
    ("bing_ads", "v13", "bing_ads_api_v1", ("campaigns", "ad_groups", "ads", "account_performance_report")),
    (
        "amazon_ads",
        "v3",
        "amazon_ads_api_v1",
        ("sponsored_products_campaigns", "sponsored_products_ad_groups", "sponsored_products_product_ads"),
    ),
    ("amplitude", "v2", "amplitude_api_v1", ("events", "users")),
    ("mixpanel", "v2", "mixpanel_api_v1", ("events", "people")),
    ("woocommerce", "v3", "woocommerce_api_v1", ("orders", "products")),
    ("bigcommerce", "v3", "bigcommerce_api_v1", ("orders", "products")),
    ("facebook_ads", "v19", "facebook_ads_api_v1", ("ads", "ad_sets", "campaigns", "facebook_insights")),
    ("instagram_ads", "v19", "facebook_ads_api_v1", ("ads", "ad_sets", "campaigns", "facebook_insights")),
    ("google_ads", "v16", "google_ads_api_v1", ("ads", "ad_groups", "ad_performance", "campaigns", "customers")),
    ("google_analytics", "ga4_v1", "google_analytics_api_v1", ("events",)),
    ("tiktok_ads", "v1.3", "tiktok_ads_api_v1", ("campaigns", "ad_groups", "ads", "ads_reports_daily")),
    ("shopify", "v1", "shopify_api_v1", ("products", "orders")),
)

SOURCES = tuple(c[0] for c in CONNECTORS)


def connector_catalog(spark: SparkSession) -> DataFrame:
    """One row per (source, object); ``hub_table_id`` is the hub id of that object."""
    base = local_frame(
        spark, CONNECTORS, "source_name string, version string, master_model_id string, objects array<string>"
    )
    exploded = base.select(
        "source_name",
        "version",
        "master_model_id",
        F.explode("objects").alias("source_table_name"),
    )
    return exploded.withColumn(
        "hub_table_id", F.concat_ws("_", "master_model_id", "source_table_name")
    )
