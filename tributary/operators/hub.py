"""The hub: packing, routing, insert-only pushes and the histories around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.operators import hub_log
from tributary.functions.keys import NULL_MARKER, fingerprint_tables, surrogate_key
from tributary.operators.latest import latest_per
from tributary.schemas import HUB, HUB_DIGEST
from tributary.sources.local import local_frame
from tributary.sources.connectors import SOURCES
from tributary.sources.sinks import path_exists, read_hub, write_hub
from tributary.sources.tenants import configured_tables

__all__ = ["NULL_MARKER", "fingerprint_tables", "pack_payload", "push", "push_into"]


def _now(at: Column | None) -> Column:
    return F.current_timestamp() if at is None else at


def pack_payload(
    df: DataFrame,
    tenant: str | Column,
    source: str | Column,
    schema_hash: str | Column,
    loaded_at: Column | None = None,
    payload: list[str] | None = None,
) -> DataFrame:
    """One hub row per raw row; the payload is the whole row as JSON, nulls kept."""
    fields = payload or df.columns

    def lit(value: str | Column) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
    return df.select(
        lit(tenant).cast("string").alias("tenant_slug"),
        surrogate_key(lit(tenant)).alias("tenant_skey"),
        lit(source).cast("string").alias("source_platform"),
        lit(schema_hash).cast("string").alias("source_schema_hash"),
        F.lit(None).cast("string").alias("source_schema"),
        body.alias("raw_data_payload"),
        _now(loaded_at).alias("loaded_at"),
    )


def route(fingerprints: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Attach the hub id registered for a schema hash, else ``unknown``.

    The blueprint side is reduced to one row per hash first.  No broadcast is forced:
    the planner broadcasts it when its measured size is under the threshold.
    """
    ids = blueprints.groupBy("source_schema_hash").agg(
        F.min(F.struct("registered_at", "master_model_id"))["master_model_id"].alias("_id")
    )
    return (
        fingerprints.join(ids, "source_schema_hash", "left")
        .withColumn("master_model_id", F.coalesce("_id", F.lit("unknown")))
        .drop("_id")
    )


def routed_only(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("master_model_id") != "unknown")


def register_blueprints(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: one per hash not registered yet, earliest candidate first."""
    unseen = new.join(existing.select("source_schema_hash").distinct(), "source_schema_hash", "left_anti")
    order = [F.asc("registered_at"), F.asc("source_name"), F.asc("source_table_name")]
    return latest_per(unseen, ["source_schema_hash"], order).select(
        "source_name",
        "source_table_name",
        "source_schema_hash",
        "master_model_id",
        "version",
        "registered_at",
    )


def parse_raw_name(tables: DataFrame, name: str = "table_name") -> DataFrame:
    """``raw_{tenant}_{source}_{object}`` -> tenant_slug, source_platform, source_object.

    With a ``tenant_slug`` column the tenant is known and the prefix must match it;
    without one the shortest tenant followed by a known source is taken.
    """
    sources = "|".join(SOURCES)
    full = F.col(name)
    kept = tables.filter(~full.contains("_dlt"))
    if "tenant_slug" in tables.columns:
        prefix = F.concat(F.lit("raw_"), "tenant_slug", F.lit("_"))
        rest = F.substr(full, F.length(prefix) + 1)
        kept = kept.filter(full.startswith(prefix)).withColumn("_rest", rest)
        pattern = f"^({sources})_(.*)$"
        source_group, object_group = 1, 2
    else:
        kept = kept.withColumn("_rest", full)
        pattern = f"^raw_(.+?)_({sources})_(.*)$"
        source_group, object_group = 2, 3
        kept = kept.withColumn("tenant_slug", F.regexp_extract("_rest", pattern, 1))
    return (
        kept.withColumn("source_platform", F.regexp_extract("_rest", pattern, source_group))
        .filter(F.col("source_platform") != "")
        .withColumn("source_object", F.regexp_extract("_rest", pattern, object_group))
        .drop("_rest")
    )


def with_digest(df: DataFrame) -> DataFrame:
    return df if HUB_DIGEST in df.columns else df.withColumn(HUB_DIGEST, F.md5("raw_data_payload"))


_PUSH_KEY = ["tenant_slug", "source_platform", HUB_DIGEST]


def _keys(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in _PUSH_KEY])


def _equal(left: str, right: str) -> Column:
    """Equality of two push keys; NULL equals NULL."""
    return reduce(Column.__and__, [F.col(left + c).eqNullSafe(F.col(right + c)) for c in _PUSH_KEY])


def push(hub: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows whose (tenant, platform, payload digest) is not in the hub yet.

    Insert-only: nothing is updated, and copies inside one batch are all returned.  A NULL
    tenant is a tenant like any other.  The stored keys are first cut down to those of the
    batch, by a semi join whose small side is the batch's distinct keys, so what is
    shuffled afterwards follows the batch and not the history.
    """
    rows = with_digest(batch)
    wanted = _keys(rows, "_wanted_").distinct()
    stored = _keys(with_digest(hub), "_stored_").join(wanted, _equal("_stored_", "_wanted_"), "left_semi").distinct()
    return rows.join(stored, _equal("", "_stored_"), "left_anti")


def _among(column: str, values: set) -> Column:
    """Partition predicate; the values are tenants or platforms of a batch, so few."""
    named = F.col(column).isin(sorted(v for v in values if v is not None))
    return named | F.col(column).isNull() if None in values else named


def push_into(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """Push a batch into the stored hub; returns the number of its commit.

    Only the digest index buckets of the batch's digests are read (``hub_log``), and the
    new rows become visible in one commit that a second writer cannot duplicate.  Columns
    beyond the contract are kept; ``read_hub(evolve=True)`` shows them.
    """
    return hub_log.push_logged(spark, path, batch)


def schema_observations(batch: DataFrame) -> DataFrame:
    """Distinct (tenant, platform, table, hash, schema) of a batch with its surrogate key.

    ``batch`` carries ``_src_table``; the platform prefix is removed from it.
    """
    table = F.replace(F.col("_src_table"), F.concat("source_platform", F.lit("_")), F.lit(""))
    seen = batch.select(
        "tenant_slug",
        F.col("source_platform").alias("platform_name"),
        table.alias("source_table_name"),
        "source_schema_hash",
        "source_schema",
    ).distinct()
    key = surrogate_key("tenant_slug", "platform_name", "source_table_name", "source_schema_hash")
    return seen.withColumn("source_schema_skey", key)


def push_schema_history(history: DataFrame, batch: DataFrame, at: Column | None = None) -> DataFrame:
    """Next state of the schema history: seen again -> updated_at, new -> inserted."""
    now = _now(at)
    seen = schema_observations(batch)
    key = "source_schema_skey"
    touched = seen.select(key).distinct()
    kept = history.join(touched.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    )
    fresh = seen.join(history.select(key).distinct(), key, "left_anti").withColumns(
        {"first_seen_at": now, "updated_at": now}
    )
    columns = history.columns
    return kept.select(columns).unionByName(fresh, allowMissingColumns=True).select(columns)


# Landing type of a stored type.
LANDING_TYPES = {
    "string": "text",
    "boolean": "bool",
    "tinyint": "bigint",
    "smallint": "bigint",
    "int": "bigint",
    "float": "double",
    "timestamp_ntz": "timestamp",
}


def landing_columns(tables: dict[str, DataFrame]) -> list[tuple]:
    """(table_name, column_name, data_type, ordinal_position) of raw tables, from their schemas."""
    rows = []
    for name, df in tables.items():
        for i, (column, kind) in enumerate(df.dtypes, start=1):
            kind = "decimal" if kind.startswith("decimal") else LANDING_TYPES.get(kind, kind)
            rows.append((name, column, kind, i))
    return rows


def schema_manifest(spark: SparkSession, tenant: str, tables: dict[str, DataFrame], at: Column | None = None) -> DataFrame:
    """One row per raw table: its schema as JSON and its manifest; metadata only, no data is read."""
    rows = [(tenant, name, df.schema.json()) for name, df in tables.items()]
    schema = "tenant_slug string, table_name string, source_schema string"
    columns = "table_name string, column_name string, data_type string, ordinal_position int"
    described = raw_manifest(local_frame(spark, landing_columns(tables), columns)).select(
        "table_name", F.to_json(F.struct("dimensions", "measures", "primary_key")).alias("boring_semantic_manifest")
    )
    return local_frame(spark, rows, schema).join(described, "table_name", "left").select(
        "tenant_slug", "table_name", "source_schema", "boring_semantic_manifest", _now(at).alias("updated_at")
    )


# Landing types by semantic role.
DIMENSION_LANDING_TYPES = ("text", "timestamp", "date", "bool")
MEASURE_LANDING_TYPES = ("double", "bigint", "integer", "decimal")


def raw_manifest(columns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per raw table: dimension list, measure list (always summed) and primary key.

    ``columns`` has column_name, data_type (landing type), ordinal_position and
    optionally primary_key; loader tables are dropped.
    """
    by = by or ["table_name"]
    kind = F.col("data_type")
    is_dimension = kind.isin(*DIMENSION_LANDING_TYPES)
    is_measure = kind.isin(*MEASURE_LANDING_TYPES)
    dimension = F.struct(
        "ordinal_position",
        F.col("column_name").alias("name"),
        F.when(kind == "text", "string").otherwise(kind).alias("type"),
    )
    measure = F.struct(
        "ordinal_position",
        F.col("column_name").alias("name"),
        F.lit("number").alias("type"),
        F.lit("sum").alias("agg"),
    )
    is_key = F.col("primary_key") if "primary_key" in columns.columns else F.lit(False)
    keyed = F.max(F.when(is_key, F.struct("ordinal_position", "column_name")))

    def listed(condition: Column, item: Column) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(condition, item)))
        return F.transform(ordered, lambda x: x.dropFields("ordinal_position"))

    return (
        columns.filter(~F.col("table_name").startswith("_dlt"))
        .groupBy(*by)
        .agg(
            listed(is_dimension, dimension).alias("dimensions"),
            listed(is_measure, measure).alias("measures"),
            keyed.getField("column_name").alias("primary_key"),
        )
    )


def config_history(manifest: DataFrame) -> DataFrame:
    """Newest row per (tenant, source, table, logic hash); sources without tables drop out."""
    rows = configured_tables(manifest, "loaded_at").select(
        "tenant_slug",
        surrogate_key("tenant_slug").alias("tenant_skey"),
        "source_name",
        "table_name",
        "table_logic",
        F.md5("table_logic").alias("logic_hash"),
        F.col("loaded_at").alias("updated_at"),
    )
    return latest_per(
        rows, ["tenant_slug", "source_name", "table_name", "logic_hash"], [F.desc("updated_at")]
    )


_TABLE_KEY = ["tenant_slug", "source_name", "table_name"]


def latest_configs(history: DataFrame) -> DataFrame:
    return latest_per(history, _TABLE_KEY, [F.desc("updated_at"), F.desc("logic_hash")])


def latest_source_configs(history: DataFrame) -> DataFrame:
    return latest_configs(history).select(
        "tenant_skey",
        "tenant_slug",
        F.col("source_name").alias("platform_name"),
        "table_name",
        "table_logic",
        "logic_hash",
        "updated_at",
    )


def hub_keys(history: DataFrame, at: Column | None = None) -> DataFrame:
    key = surrogate_key("tenant_slug", "source_name", "updated_at", "logic_hash")
    return latest_configs(history).select(
        F.col("tenant_slug").alias("client_slug"),
        F.col("source_name").alias("platform_name"),
        "table_name",
        key.alias("generated_hash"),
        "tenant_skey",
        F.col("updated_at").alias("logic_version_at"),
        F.col("logic_hash").alias("logic_config_hash"),
        _now(at).alias("logged_at"),
    )


def master_registry(blueprints: DataFrame) -> DataFrame:
    return blueprints.select(
        "source_schema_hash",
        F.col("source_name").alias("source_platform"),
        "source_table_name",
        "master_model_id",
        F.col("version").alias("blueprint_version"),
        "registered_at",
    )


def schema_drift(history: DataFrame) -> DataFrame:
    """Every change of a table's schema hash, in order of first appearance.

    The history holds one row per distinct hash of a table, so a window partition is
    bounded by the number of schema versions, not by data volume.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("tenant_slug", "platform_name", "source_table_name").orderBy(
        "first_seen_at", "source_schema_hash"
    )
    previous = F.lag("source_schema_hash").over(order)
    return (
        history.withColumn("previous_hash", previous)
        .filter(F.col("previous_hash") != F.col("source_schema_hash"))
        .select(
            "tenant_slug",
            "platform_name",
            "source_table_name",
            "previous_hash",
            F.col("source_schema_hash").alias("current_hash"),
            F.col("first_seen_at").alias("changed_at"),
            F.col("updated_at").alias("last_seen_at"),
        )
    )
