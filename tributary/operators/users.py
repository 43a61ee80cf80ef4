"""User dimension: activity per user and identity resolution through orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.functions.attribution import earliest_value
from tributary.sources.sinks import conform

USER = ("tenant_slug", "source_platform", "user_pseudo_id")


def user_aggregate(events: DataFrame) -> DataFrame:
    """Activity per (tenant, platform, user).

    The distinct session count makes the planner aggregate per (user, session) first,
    so a user with very many events is spread over tasks before the final merge.
    """
    return events.groupBy(*USER).agg(
        F.max("user_id").alias("user_id"),
        F.min("event_timestamp").alias("first_seen_at"),
        F.max("event_timestamp").alias("last_seen_at"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.expr(f"{earliest_value('geo_country', 'event_timestamp')} AS first_geo_country"),
        F.expr(f"{earliest_value('device_category', 'event_timestamp')} AS first_device_category"),
    )


def purchase_links(events: DataFrame) -> DataFrame:
    """Distinct (tenant, user, order) pairs."""
    return (
        events.filter(F.col("order_id").isNotNull())
        .select("tenant_slug", "user_pseudo_id", F.col("order_id").cast("string").alias("order_id"))
        .distinct()
    )


def resolve_identities(links: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer email and id per user, through orders of the same tenant.

    Orders are reduced to one row per order id before the join, so repeated order rows
    cannot multiply links; adaptive execution splits a hot order id on the link side.
    """
    per_order = orders.groupBy("tenant_slug", F.col("order_id").cast("string").alias("order_id")).agg(
        F.max("customer_email").alias("customer_email"), F.max("customer_id").alias("customer_id")
    )
    return (
        links.join(per_order, ["tenant_slug", "order_id"])
        .groupBy("tenant_slug", "user_pseudo_id")
        .agg(F.max("customer_email").alias("customer_email"), F.max("customer_id").alias("customer_id"))
    )


def users(events: DataFrame, orders: DataFrame) -> DataFrame:
    """user_aggregate LEFT JOIN resolved identities; a customer is a user with an email."""
    resolved = resolve_identities(purchase_links(events), orders)
    joined = user_aggregate(events).join(resolved, ["tenant_slug", "user_pseudo_id"], "left")
    return conform(joined, "dim_users", is_customer="customer_email IS NOT NULL")
