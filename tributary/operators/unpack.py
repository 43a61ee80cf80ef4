"""Typed rows out of hub payloads: one JSON parse per row, then safe casts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tributary.functions.casts import typed

CARRIED = ("tenant_slug", "source_platform", "tenant_skey", "loaded_at")


@dataclass(frozen=True)
class Field:
    """One output column: the first present key wins, or a SQL expression over ``p``.

    ``expression`` sees the parsed payload as struct ``p`` whose members are text.
    """

    alias: str
    keys: tuple[str, ...]
    kind: str = "string"
    expression: str | None = None


@dataclass(frozen=True)
class Spec:
    platform: str
    object_name: str
    fields: tuple[Field, ...]


def _f(alias: str, keys: str | None = None, kind: str = "string", expression: str | None = None) -> Field:
    return Field(alias, tuple((keys or alias).split("|")), kind, expression)


def _same(*names: str, kind: str = "string") -> tuple[Field, ...]:
    return tuple(_f(n, kind=kind) for n in names)


_COUNTS = (*_same("impressions", "clicks", kind="bigint"), _f("conversions", kind="double"))
_SPEND = (_f("spend", kind="double"),)
_META_INSIGHTS = (
    _f("report_date", "date_start", "date"),
    *_SPEND,
    *_COUNTS,
    *_same("campaign_id", "adset_id", "ad_id"),
)
_CAMPAIGN = (
    _f("campaign_id", "id|campaign_id"),
    _f("campaign_name", "name|campaign_name"),
    _f("status", "status|state"),
)

# Payload keys, output names and types of every connector object.
SPECS: dict[tuple[str, str], Spec] = {
    (s.platform, s.object_name): s
    for s in (
        Spec("facebook_ads", "facebook_insights", _META_INSIGHTS),
        Spec("instagram_ads", "facebook_insights", _META_INSIGHTS),
        Spec(
            "google_ads",
            "ad_performance",
            (
                _f("report_date", "date_start", "date"),
                _f(
                    "spend",
                    "cost_micros",
                    "double",
                    "cast(try_cast(p.cost_micros as bigint) as double) / 1000000",
                ),
                *_COUNTS,
                *_same("campaign_id", "ad_group_id", "ad_id"),
            ),
        ),
        Spec(
            "bing_ads",
            "account_performance_report",
            (_f("report_date", "time_period", "date"), *_SPEND, *_same("impressions", "clicks", kind="bigint")),
        ),
        Spec(
            "linkedin_ads",
            "ad_analytics_by_campaign",
            (
                _f("report_date", "date_start|date_range_start", "date"),
                _f("spend", "spend|cost_in_local_currency", "double"),
                *_COUNTS,
                _f("campaign_id"),
            ),
        ),
        Spec(
            "amazon_ads",
            "sponsored_products_product_ads",
            (_f("report_date", "date", "date"), *_same("campaign_id", "ad_group_id", "ad_id"), *_SPEND, *_COUNTS),
        ),
        Spec(
            "tiktok_ads",
            "ads_reports_daily",
            (
                _f("report_date", "stat_time_day", "date"),
                _f("campaign_id"),
                _f("ad_group_id", "adgroup_id"),
                _f("ad_id"),
                *_SPEND,
                *_COUNTS,
            ),
        ),
        *(
            Spec(platform, "campaigns", _CAMPAIGN)
            for platform in (
                "facebook_ads",
                "instagram_ads",
                "google_ads",
                "bing_ads",
                "linkedin_ads",
                "tiktok_ads",
            )
        ),
        Spec("amazon_ads", "sponsored_products_campaigns", _CAMPAIGN),
        Spec(
            "shopify",
            "orders",
            (
                _f("order_id", "id", "bigint"),
                _f("order_name", "name"),
                _f("email"),
                _f("total_price", kind="double"),
                *_same("currency", "financial_status", "customer_email", "customer_id"),
                _f("order_created_at", "created_at", "timestamp"),
                _f("line_items_json", "line_items"),
            ),
        ),
        Spec(
            "woocommerce",
            "orders",
            (
                _f("order_id", "number"),
                _f("woocommerce_id", "id", "bigint"),
                _f("order_status", "status"),
                _f("total_price", kind="double"),
                _f("currency"),
                _f("customer_id", kind="bigint"),
                _f("customer_email", "billing_email"),
                _f("order_created_at", "created_at", "timestamp"),
                _f("line_items_json", "line_items"),
            ),
        ),
        Spec(
            "bigcommerce",
            "orders",
            (
                _f("order_id", "id", "bigint"),
                _f("order_status", "status"),
                _f("total_price", kind="double"),
                _f("currency"),
                _f("customer_id", kind="bigint"),
                _f("billing_email"),
                _f("order_created_at", "created_at", "timestamp"),
            ),
        ),
        Spec(
            "google_analytics",
            "events",
            (
                *_same("event_name", "event_date"),
                _f("event_timestamp", kind="bigint"),
                *_same("user_pseudo_id", "user_id", "geo_country", "geo_city"),
                _f("traffic_source", "traffic_source_source"),
                _f("traffic_medium", "traffic_source_medium"),
                _f("traffic_campaign", "traffic_source_campaign"),
                *_same("device_category", "ga_session_id"),
                _f("transaction_id", "ecommerce_transaction_id"),
                _f("purchase_revenue", "ecommerce_value", "double"),
                _f("ecommerce_currency"),
            ),
        ),
        Spec(
            "mixpanel",
            "events",
            (
                _f("event_name", "event"),
                _f("user_pseudo_id", "prop_distinct_id"),
                _f("user_id", "prop_distinct_id"),
                _f("event_timestamp", "prop_time", "bigint", "try_cast(p.prop_time as bigint) * 1000"),
                _f("geo_city", "prop_city"),
                _f("geo_country", "prop_country_code"),
                _f("device_category", "prop_device_type"),
                _f("traffic_source", "prop_utm_source"),
                _f("traffic_medium", "prop_utm_medium"),
                _f("traffic_campaign", "prop_utm_campaign"),
                _f("prop_order_id"),
                _f("prop_revenue", kind="double"),
            ),
        ),
        Spec(
            "amplitude",
            "events",
            (
                _f("event_name", "event_type"),
                _f("user_pseudo_id", "user_id"),
                _f("user_id"),
                _f(
                    "event_timestamp",
                    "event_time",
                    "bigint",
                    "coalesce(try_cast(p.event_time as bigint),"
                    " unix_millis(try_to_timestamp(p.event_time, 'yyyy-MM-dd HH:mm:ss')))",
                ),
                _f("session_id"),
                _f("geo_city", "city"),
                _f("geo_country", "country"),
                _f("device_category", "device_type"),
                _f("traffic_source", "utm_source"),
                _f("traffic_medium", "utm_medium"),
                _f("traffic_campaign", "utm_campaign"),
                _f("order_id"),
                _f("order_total", "revenue", "double"),
            ),
        ),
    )
}


def unpack(
    hub: DataFrame,
    spec: Spec,
    tenant: str | None = None,
    schema_hashes: list[str] | None = None,
) -> DataFrame:
    """Typed columns of one connector object, for one tenant or for all of them.

    The filters name the hub's partition columns, so other platforms' folders are not
    read.  ``schema_hashes`` selects one object's rows when a hub holds several.
    """
    rows = hub.filter(F.col("source_platform") == spec.platform)
    if tenant is not None:
        rows = rows.filter(F.col("tenant_slug") == tenant)
    if schema_hashes is not None:
        rows = rows.filter(F.col("source_schema_hash").isin(schema_hashes))
    keys = sorted({key for field in spec.fields for key in field.keys})
    shape = T.StructType([T.StructField(key, T.StringType()) for key in keys])
    parsed = rows.withColumn("p", F.from_json("raw_data_payload", shape))
    fields = [f"{_value(f)} AS `{f.alias}`" for f in spec.fields]
    return parsed.selectExpr(*CARRIED, *fields, "raw_data_payload")


def _value(field: Field) -> str:
    if field.expression:
        return field.expression
    keys = [f"p.`{key}`" for key in field.keys]
    return typed(keys[0] if len(keys) == 1 else f"coalesce({', '.join(keys)})", field.kind)


LINE_ITEM = "array<struct<product_id: string, name: string, quantity: double, price: double>>"


def explode_line_items(orders: DataFrame) -> DataFrame:
    """One row per (order, item) from the orders' JSON item list."""
    items = F.from_json("line_items_json", LINE_ITEM)
    return orders.select(
        "tenant_slug", "source_platform", "order_id", F.explode(items).alias("item")
    ).select("tenant_slug", "source_platform", "order_id", "item.*")
