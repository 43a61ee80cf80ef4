"""Star tables for all tenants at once, from each tenant's enabled sources."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import tributary.operators.ads  # noqa: F401  (registers engines)
import tributary.operators.analytics  # noqa: F401
import tributary.operators.orders  # noqa: F401
from tributary.registry import engine, sources_for
from tributary.sources.local import local_frame
from tributary.sources.sinks import conform, empty_star

TABLE_OF = {
    "ad_performance": "fct_ad_performance",
    "orders": "fct_orders",
    "sessions": "fct_sessions",
    "events": "fct_events",
    "campaigns": "dim_campaigns",
    "users": "dim_users",
}


def enabled_pairs(sources: DataFrame, subject: str, first_only: bool) -> DataFrame:
    """Enabled (tenant, source) rows whose source has an engine for the subject.

    ``first_only`` keeps each tenant's first such source in configuration order.
    """
    known = sources.filter(F.col("enabled") & F.col("source").isin(*sources_for(subject)))
    if not first_only:
        return known
    order = Window.partitionBy("tenant_slug").orderBy("rank")
    return known.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def enabled_rows(sources: DataFrame, subject: str, first_only: bool) -> list:
    """The enabled pairs on the driver: configuration, one row per tenant and source."""
    return enabled_pairs(sources, subject, first_only).collect()


def of_tenants(rows: DataFrame, pairs: list, names: set[str]) -> DataFrame:
    """Rows of the tenants that use one of the sources ``names``.

    The tenants are a literal list, which prunes ``tenant_slug`` partitions without a join.
    """
    return rows.filter(F.col("tenant_slug").isin(sorted({p["tenant_slug"] for p in pairs if p["source"] in names})))


def _assemble(
    spark: SparkSession,
    subject: str,
    frames: Mapping[str, DataFrame],
    pairs: list,
    **extra,
) -> DataFrame:
    table = TABLE_OF[subject]
    parts = [
        conform(engine(source, subject)(of_tenants(rows, pairs, {source}), **extra), table)
        for source, rows in frames.items()
        if any(p["source"] == source for p in pairs)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else empty_star(spark, table)


def build_ad_performance(spark, frames: Mapping[str, DataFrame], sources: DataFrame) -> DataFrame:
    """Union over every enabled ad source."""
    return _assemble(spark, "ad_performance", frames, enabled_rows(sources, "ad_performance", first_only=False))


def build_campaigns(spark, frames: Mapping[str, DataFrame], sources: DataFrame) -> DataFrame:
    return _assemble(spark, "campaigns", frames, enabled_rows(sources, "campaigns", first_only=False))


def build_orders(spark, frames: Mapping[str, DataFrame], sources: DataFrame) -> DataFrame:
    """First enabled store source per tenant."""
    return _assemble(spark, "orders", frames, enabled_rows(sources, "orders", first_only=True))


def build_events(spark, frames: Mapping[str, DataFrame], sources: DataFrame) -> DataFrame:
    return _assemble(spark, "events", frames, enabled_rows(sources, "events", first_only=True))


def build_sessions(spark, frames: Mapping[str, DataFrame], sources: DataFrame) -> DataFrame:
    """First enabled analytics source per tenant, with that source's conversion events.

    The lists are one row per tenant, a local relation whose size the planner knows.
    """
    pairs = enabled_rows(sources, "sessions", first_only=True)
    schema = "tenant_slug string, source string, conversion_events array<string>"
    lists = local_frame(spark, [(p["tenant_slug"], p["source"], p["conversion_events"]) for p in pairs], schema)
    return _assemble(spark, "sessions", frames, pairs, conversions=lists)


def build_users(spark, events: DataFrame, orders: DataFrame, sources: DataFrame) -> DataFrame:
    """Users of each tenant's first analytics source, from the assembled facts.

    Sources that share an engine are one plan; a source with an engine of its own adds one.
    """
    pairs = enabled_rows(sources, "users", first_only=True)
    by_engine: dict = {}
    for source in sorted({p["source"] for p in pairs}):
        by_engine.setdefault(engine(source, "users"), set()).add(source)
    parts = []
    for build, names in by_engine.items():
        rows = [(p["tenant_slug"], p["source"]) for p in pairs if p["source"] in names]
        own = local_frame(spark, rows, "tenant_slug string, source_platform string")
        mine = of_tenants(events, pairs, names).join(own, ["tenant_slug", "source_platform"], "left_semi")
        parts.append(conform(build(mine, orders), TABLE_OF["users"]))
    return reduce(DataFrame.unionByName, parts) if parts else empty_star(spark, TABLE_OF["users"])
