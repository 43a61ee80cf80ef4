"""Raw tables to star tables for all tenants: land, fingerprint, route, push, unpack, build."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.functions.casts import epoch_to_timestamp
from tributary.functions.keys import schema_fingerprint
from tributary.operators import factories
from tributary.operators.ads import AD_SOURCES, CAMPAIGN_OBJECT, PERFORMANCE_OBJECT
from tributary.operators.analytics import ANALYTICS_SOURCES
from tributary.operators.hub import pack_payload, push_into
from tributary.operators.orders import STORE_SOURCES
from tributary.operators.unpack import SPECS, unpack
from tributary.schemas import STAR
from tributary.sources.raw import normalize_landing
from tributary.sources.sinks import (
    current_version, overwrite_current, path_exists, read_hub, read_version, replace_partitions,
)
from tributary.sources.connectors import CONNECTORS


@dataclass(frozen=True)
class RawTable:
    """One landed table: its rows, where they come from and whose they are."""

    source: str
    object_name: str
    rows: DataFrame
    tenant: str | Column


HUB_ID = {source: hub_id for source, _version, hub_id, _objects in CONNECTORS}


def hub_table_id(source: str, object_name: str) -> str:
    return f"{HUB_ID[source]}_{object_name}"


def hub_path(root: str, source: str, object_name: str) -> str:
    """One hub table per connector object; sources that share an id share the table."""
    return f"{root.rstrip('/')}/{hub_table_id(source, object_name)}"


def land(spark: SparkSession, root: str, tables: list[RawTable]) -> dict[str, str]:
    """Push raw tables into their hub tables; returns the schema hash of each table."""
    hashes = {}
    for table in tables:
        rows = normalize_landing(table.rows)
        body = [c for c in rows.columns if c != "tenant_slug"]
        digest = schema_fingerprint(rows.select(*body).schema)
        packed = pack_payload(rows, table.tenant, table.source, digest, payload=body)
        push_into(spark, hub_path(root, table.source, table.object_name), packed)
        hashes[f"{table.source}.{table.object_name}"] = digest
    return hashes


def stored_objects(spark: SparkSession, root: str) -> set[tuple[str, str]]:
    """The (source, object) pairs whose hub table exists, whichever refresh landed them."""
    known = {hub_path(root, source, name): set() for source, name in SPECS if source in HUB_ID}
    for source, name in SPECS:
        if source in HUB_ID:
            known[hub_path(root, source, name)].add((source, name))
    return {pair for path, pairs in known.items() if path_exists(spark, path) for pair in pairs}


def star_tables(
    spark: SparkSession, root: str, sources: DataFrame, landed: set[tuple[str, str]] | None = None
) -> dict[str, DataFrame]:
    """The six star tables as lazy plans over the stored hub.

    They are built from every hub table there is, so that a refresh that lands one
    connector keeps the rows of the others; ``landed`` narrows them to some objects.
    """
    landed = stored_objects(spark, root) if landed is None else landed

    def rows(source: str, object_name: str) -> DataFrame:
        hub = read_hub(spark, hub_path(root, source, object_name))
        return unpack(hub, SPECS[(source, object_name)])

    def frames(objects: Mapping[str, str]) -> dict[str, DataFrame]:
        return {s: rows(s, o) for s, o in objects.items() if (s, o) in landed}

    performance = frames({s: PERFORMANCE_OBJECT[s] for s in AD_SOURCES})
    campaigns = frames({s: CAMPAIGN_OBJECT[s] for s in AD_SOURCES})
    stores = frames({s: "orders" for s in STORE_SOURCES})
    analytics = frames({s: "events" for s in ANALYTICS_SOURCES})
    events = factories.build_events(spark, analytics, sources)
    orders = factories.build_orders(spark, stores, sources)
    return {
        "ad_performance": factories.build_ad_performance(spark, performance, sources),
        "campaigns": factories.build_campaigns(spark, campaigns, sources),
        "orders": orders,
        "events": events,
        "sessions": factories.build_sessions(spark, analytics, sources),
        "users": factories.build_users(spark, events, orders, sources),
    }


#: Rows are ordered by these inside a tenant, so date filters skip row groups.
SORT_KEYS = {
    "ad_performance": ("report_date",),
    "orders": ("order_date",),
    "events": ("event_timestamp",),
    "sessions": ("session_start_ts",),
    "campaigns": (),
    "users": (),
}


def _month(subject: str) -> Column:
    """The month of a star row; tables without a time have one."""
    platform = F.col("source_platform")
    moments = {
        "ad_performance": lambda: F.col("report_date"),
        "orders": lambda: F.col("order_date"),
        "events": lambda: epoch_to_timestamp(F.col("event_timestamp"), platform),
        "sessions": lambda: epoch_to_timestamp(F.col("session_start_ts"), platform),
    }
    return F.trunc(moments[subject](), "MM") if subject in moments else F.lit(None).cast("date")


def laid_out(df: DataFrame, subject: str) -> DataFrame:
    """Rows rebalanced by tenant and month and sorted, so that files and row groups hold few dates."""
    return (
        df.withColumn("_month", _month(subject))
        .hint("rebalance", F.col("tenant_slug"), F.col("_month"))
        .sortWithinPartitions("tenant_slug", *SORT_KEYS[subject])
        .drop("_month")
    )


def write_star(tables: Mapping[str, DataFrame], root: str, tenants: list[str] | None = None) -> None:
    """Write every star table partitioned by tenant, its rows spread by tenant and month by AQE.

    Without ``tenants`` a new version of the table becomes current when it is complete, so
    a failed job leaves the old one.  With ``tenants`` their partitions of the current
    version are replaced, also by nothing when a tenant has no rows any more, by one
    manifest swap: readers see the old or the new partitions, never neither.
    """
    for subject, df in tables.items():
        path = star_path(root, subject)
        current = None if tenants is None else current_version(df.sparkSession, path)
        if tenants is not None:
            df = df.filter(F.col("tenant_slug").isin(tenants))
        rows = laid_out(df, subject)
        if current is None:
            overwrite_current(rows, path, "tenant_slug")
        else:
            replace_partitions(rows, current, "tenant_slug", tenants)


def star_path(root: str, subject: str) -> str:
    return f"{root.rstrip('/')}/{factories.TABLE_OF[subject]}"


def read_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current star tables; a tenant filter prunes partitions."""
    stored = {}
    for subject, table in factories.TABLE_OF.items():
        version = current_version(spark, star_path(root, subject))
        if version is not None:
            stored[subject] = read_version(spark, version, STAR[table]).select(*STAR[table].fieldNames())
    return stored


def refresh(
    spark: SparkSession,
    hub_root: str,
    star_root: str,
    tables: list[RawTable],
    sources: DataFrame,
    tenants: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Hub first, then the star tables, so fresh rows are visible in the same run.

    The star tables hold what all refreshes so far have landed.  Users come from the
    stored events and orders, so payloads are not parsed again.
    """
    land(spark, hub_root, tables)
    built = star_tables(spark, hub_root, sources)
    write_star({s: df for s, df in built.items() if s != "users"}, star_root, tenants)
    stored = read_star(spark, star_root)
    users = factories.build_users(spark, stored["events"], stored["orders"], sources)
    write_star({"users": users}, star_root, tenants)
    return read_star(spark, star_root)
