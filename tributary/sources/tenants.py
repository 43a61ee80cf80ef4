"""Tenant manifest and the per-tenant source configuration.

A manifest row is (slug, status, sources) where ``sources`` is JSON text keyed by
source name.  Key order in that text is the configuration order, which decides the
"first enabled source" of a tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SOURCE_CONFIG = (
    "map<string, struct<enabled: boolean, logic: string,"
    " tables: array<struct<name: string, logic: string>>>>"
)
LOGIC = "struct<conversion_events: array<string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines manifest: slug, status, sources (object kept as text)."""
    schema = "slug string, business_name string, status string, sources string"
    return spark.read.schema(schema).json(path)


def tenant_manifest(raw: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """One row per tenant with a hash of its source configuration."""
    return raw.select(
        F.col("slug").alias("tenant_slug"),
        "status",
        F.col("sources").alias("sources_config"),
        F.md5("sources").alias("config_hash"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("loaded_at"),
    )


def _configured(manifest: DataFrame, *carried: str) -> DataFrame:
    """One row per (tenant, source) in configuration order (rank from 1)."""
    entries = F.map_entries(F.from_json("sources_config", SOURCE_CONFIG))
    return manifest.select("tenant_slug", *carried, F.posexplode(entries).alias("pos", "entry")).select(
        "tenant_slug",
        *carried,
        F.col("entry.key").alias("source"),
        (F.col("pos") + 1).alias("rank"),
        F.coalesce("entry.value.enabled", F.lit(False)).alias("enabled"),
        F.col("entry.value.logic").alias("logic"),
        F.col("entry.value.tables").alias("tables"),
    )


def tenant_sources(manifest: DataFrame, injected: DataFrame | None = None) -> DataFrame:
    """tenant_slug, source, rank, enabled, conversion_events.

    Conversion events come from the source-level logic, else from the first table
    that lists some.  Tenants present in ``injected`` take their whole configuration
    from there.
    """
    if injected is not None:
        manifest = manifest.join(injected, "tenant_slug", "left_anti").unionByName(
            injected, allowMissingColumns=True
        )

    def events(logic: Column) -> Column:
        return F.from_json(logic, LOGIC).getField("conversion_events")

    from_tables = F.filter(
        F.transform("tables", lambda t: events(t["logic"])), lambda e: F.size(e) > 0
    )
    return _configured(manifest).select(
        "tenant_slug",
        "source",
        "rank",
        "enabled",
        F.coalesce(
            events(F.col("logic")),
            F.get(from_tables, F.lit(0)),
            F.array().cast("array<string>"),
        ).alias("conversion_events"),
    )


def tenant_config(sources: DataFrame, tenant: str, source: str | None = None) -> DataFrame:
    found = sources.filter(F.col("tenant_slug") == tenant)
    return found if source is None else found.filter(F.col("source") == source)


def configured_tables(manifest: DataFrame, *carried: str) -> DataFrame:
    """One row per (tenant, source, configured table) with its logic text."""
    return (
        _configured(manifest, *carried)
        .select("tenant_slug", *carried, "source", F.explode("tables").alias("t"))
        .select(
            "tenant_slug",
            *carried,
            F.col("source").alias("source_name"),
            F.col("t.name").alias("table_name"),
            F.col("t.logic").alias("table_logic"),
        )
    )
