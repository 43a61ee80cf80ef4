"""Semantic catalogue: star tables, classified columns, inferred measures and joins.

Everything works on a *columns* frame (one row per tenant, table and column), for all
tenants in one job.  Groups are single tables, so collected lists are bounded by table
width and never by data volume.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.sources.local import local_frame

# Type groups of the classification.
TEXTUAL = ("VARCHAR", "TEXT")
TEMPORAL = ("DATE", "TIMESTAMP")
LOGICAL = ("BOOLEAN", "BOOL")
FRACTIONAL = ("DOUBLE", "FLOAT", "DECIMAL", "REAL")
INTEGRAL = ("BIGINT", "INTEGER", "INT", "SMALLINT", "TINYINT", "HUGEINT")
UNQUERYABLE = ("JSON", "BLOB")
HIDDEN_COLUMNS = ("tenant_slug",)
SHARED_COLUMNS = ("tenant_slug", "source_platform")
FUNNEL_PREFIX = "funnel_"
EPOCH_SUFFIXES = ("_start", "_end", "_ts", "_at", "_timestamp", "_date")
DIMENSION_SUFFIXES = (
    "_id", "_key", "_slug", "_name", "_status", "_type", "_category", "_email", "_source", "_medium",
    "_campaign", "_country", "_device",
)


@dataclass(frozen=True)
class CalcMeasure:
    name: str
    label: str
    requires: tuple[str, ...]
    sql: str
    format: str


def _ratio(numerator: str, denominator: str) -> str:
    return f"CASE WHEN {denominator} > 0 THEN {numerator} / {denominator} ELSE 0 END"


# The calculated measures and the columns each one needs.
CALC_MEASURES = (
    CalcMeasure("ctr", "CTR", ("clicks", "impressions"), _ratio("SUM(clicks) * 1.0D", "SUM(impressions)"), "percent"),
    CalcMeasure("cpc", "CPC", ("spend", "clicks"), _ratio("SUM(spend)", "SUM(clicks)"), "currency"),
    CalcMeasure(
        "cpm", "CPM", ("spend", "impressions"), _ratio("SUM(spend) * 1000.0D", "SUM(impressions)"), "currency"
    ),
    CalcMeasure(
        "aov", "AOV", ("total_price", "order_id"), _ratio("SUM(total_price)", "COUNT(DISTINCT order_id)"), "currency"
    ),
    CalcMeasure(
        "conversion_rate",
        "Conversion Rate",
        ("funnel_step_6_purchase", "session_id"),
        _ratio("COUNT_IF(funnel_step_6_purchase > 0) * 1.0D", "COUNT(DISTINCT session_id)"),
        "percent",
    ),
)
CALC_BY_NAME = {c.name: c for c in CALC_MEASURES}


def _one_of(column: Column, values: tuple[str, ...]) -> Column:
    return column.isin(*values)


def _suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    return name.rlike(f"({'|'.join(suffixes)})$")


# --- star tables -----------------------------------------------------------------


def star_catalog(tables: DataFrame) -> DataFrame:
    """Fact and dimension tables with tenant and subject read from their names.

    The name patterns keep ``_`` as a one-character wildcard; names without a tenant
    part are dropped.
    """
    name = F.col("table_name")
    is_fact, is_dimension = name.like("fct_%"), name.like("dim_%")
    tenant = F.when(is_fact, F.regexp_extract(name, "fct_(.+?)__", 1)).otherwise(
        F.regexp_extract(name, "dim_(.+?)__", 1)
    )
    return (
        tables.filter(is_fact | is_dimension)
        .withColumns(
            {
                "tenant_slug": F.nullif(tenant, F.lit("")),
                "table_type": F.when(is_fact, "fact").otherwise("dimension"),
                "subject": F.nullif(F.regexp_extract(name, "__(.+)$", 1), F.lit("")),
            }
        )
        .filter(F.col("tenant_slug").isNotNull())
    )


_MANIFEST = "array<struct<column_name: string, data_type: string, ordinal_position: int>>"


def _manifest_of(items: Column) -> Column:
    """JSON list of a table's columns in order, from a list of them."""
    ordered = F.transform(
        F.sort_array(items),
        lambda c: F.struct(
            c["column_name"].alias("column_name"),
            c["data_type"].alias("data_type"),
            c["ordinal_position"].alias("ordinal_position"),
        ),
    )
    return F.to_json(ordered)


_MANIFEST_ITEM = ("ordinal_position", "column_name", "data_type")


def column_manifest(columns: DataFrame, by: list[str]) -> DataFrame:
    """Per table: JSON list of its columns in order."""
    items = F.collect_list(F.struct(*_MANIFEST_ITEM))
    return columns.groupBy(*by).agg(_manifest_of(items).alias("semantic_manifest"))


def _follows_tables(side: DataFrame) -> DataFrame:
    """A join side with rows for every table: never broadcast, nor hashed in memory.

    Built of exploded rows and lists, such a side is planned by the size of its source files,
    a small part of its own; sorted sides spill.
    """
    return side.hint("merge")


def _follows_overlay(side: DataFrame) -> DataFrame:
    """A join side with a few rows per overlaid table: hashed per partition, never broadcast.

    The other side has a row per column of every table, which a merge join would sort.
    """
    return side.hint("shuffle_hash")


def _all_known(key: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in key])


def semantic_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per star table with its column manifest; NULL when it has no columns.

    Tables and columns are grouped together instead of joined: one aggregate, which spills,
    and no side of manifests to hash or to sort.
    """
    key = [c for c in ("table_schema", "table_name") if c in tables.columns and c in columns.columns]
    head = ["tenant_slug", "table_type", "subject", "table_name"]
    stars = star_catalog(tables).select(*key, F.struct(*head).alias("_table"))
    # an unknown key names no table
    items = columns.filter(_all_known(key)).select(*key, F.struct(*_MANIFEST_ITEM).alias("_item"))
    grouped = items.unionByName(stars, allowMissingColumns=True).groupBy(*key).agg(
        F.collect_list("_item").alias("_items"), F.collect_list("_table").alias("_tables")
    )
    manifest = F.when(F.size("_items") > 0, _manifest_of(F.col("_items")))
    return grouped.select(F.explode("_tables").alias("_table"), manifest.alias("semantic_manifest")).select(
        *[f"_table.{c}" for c in head], "semantic_manifest"
    )


def flatten_manifest(catalog: DataFrame) -> DataFrame:
    """JSON manifests back to one row per column."""
    items = F.from_json("semantic_manifest", _MANIFEST)
    return catalog.select(
        "tenant_slug", "table_type", "subject", "table_name", F.explode(items).alias("c")
    ).select("tenant_slug", "table_type", "subject", "table_name", "c.*")


# --- classification ----------------------------------------------------------------


def semantic_role(name: Column, data_type: Column) -> Column:
    """skip, dimension or measure; integers are decided by name, suffix first."""
    named_dimension = ~name.startswith(FUNNEL_PREFIX) & (
        _suffix(name, DIMENSION_SUFFIXES) | _suffix(name, EPOCH_SUFFIXES)
    )
    return (
        F.when(_one_of(name, HIDDEN_COLUMNS) | _one_of(data_type, UNQUERYABLE), "skip")
        .when(_one_of(data_type, FRACTIONAL), "measure")
        .when(_one_of(data_type, INTEGRAL) & ~named_dimension, "measure")
        .otherwise("dimension")
    )


def is_epoch(name: Column, data_type: Column) -> Column:
    return data_type.isin("BIGINT", "INTEGER") & _suffix(name, EPOCH_SUFFIXES) & ~name.startswith(FUNNEL_PREFIX)


def bsl_type(name: Column, data_type: Column) -> Column:
    return (
        F.when(_one_of(data_type, TEXTUAL), "string")
        .when(data_type == "DATE", "date")
        .when(data_type == "TIMESTAMP", "timestamp")
        .when(_one_of(data_type, LOGICAL), "boolean")
        .when(is_epoch(name, data_type), "timestamp_epoch")
        .otherwise("number")
    )


def is_time_dimension(name: Column, data_type: Column) -> Column:
    return _one_of(data_type, TEMPORAL) | is_epoch(name, data_type)


def inferred_agg(name: Column, role: Column) -> Column:
    """Aggregation of a measure; NULL for dimensions."""
    averaged = name.contains("duration") | name.contains("avg")
    counted = name.contains("count") | name.contains("events_in")
    return F.when(
        role == "measure",
        F.when(averaged, "avg")
        .when(name.endswith("_id") & ~counted, "count_distinct")
        .otherwise("sum"),
    )


def classify(columns: DataFrame) -> DataFrame:
    """Add role, type, time flag and aggregation; hidden columns are dropped."""
    name, kind = F.col("column_name"), F.col("data_type")
    return (
        columns.withColumns(
            {
                "semantic_role": semantic_role(name, kind),
                "bsl_type": bsl_type(name, kind),
                "is_time_dimension": is_time_dimension(name, kind),
            }
        )
        .filter(F.col("semantic_role") != "skip")
        .withColumn("inferred_agg", inferred_agg(name, F.col("semantic_role")))
    )


def column_catalog(catalog: DataFrame, ordered: bool = False) -> DataFrame:
    """Flatten and classify.  ``ordered`` adds the catalogue's global order for listings."""
    classified = classify(flatten_manifest(catalog))
    return classified.orderBy("tenant_slug", "table_name", "ordinal_position") if ordered else classified


# --- inference -----------------------------------------------------------------------

_TABLE = ("tenant_slug", "subject", "table_name")


def infer_calc_measures(columns: DataFrame) -> DataFrame:
    """One row per (table, calculated measure) whose required columns all exist."""
    rules = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("name"),
                F.lit(c.label).alias("label"),
                F.lit(c.sql).alias("sql"),
                F.lit(c.format).alias("format"),
                F.array(*map(F.lit, c.requires)).alias("requires"),
            )
            for c in CALC_MEASURES
        ]
    )
    needed = sorted({column for c in CALC_MEASURES for column in c.requires})
    present = (
        columns.filter(F.col("column_name").isin(needed))
        .groupBy(*_TABLE)
        .agg(F.collect_set("column_name").alias("present"))
    )
    return (
        present.withColumn("rule", F.explode(rules))
        .filter(F.size(F.array_except("rule.requires", "present")) == 0)
        .select(*_TABLE, "rule.name", "rule.label", "rule.sql", "rule.format")
    )


def infer_joins(columns: DataFrame) -> DataFrame:
    """One left join per (fact, dimension) of a tenant that share a column.

    The key is the shared ``_id`` column that comes first in the dimension, else the
    alphabetically first shared column.
    """
    kind = F.col("table_type")
    target = F.struct(F.col("subject").alias("to"), F.col("table_name").alias("to_table"), "ordinal_position")
    # the columns are read once and the dimensions that share one collected over it, so
    # that no side has to be hashed or planned a second time
    same = Window.partitionBy("tenant_slug", "column_name")
    shared = (
        columns.filter(
            ~F.col("column_name").isin(*SHARED_COLUMNS)
            & F.col("tenant_slug").isNotNull()
            & kind.isin("fact", "dimension")
        )
        .select("tenant_slug", "table_type", "subject", "table_name", "column_name", "ordinal_position")
        .withColumn("_targets", F.collect_list(F.when(kind == "dimension", target)).over(same))
        .filter(kind == "fact")
        .select("tenant_slug", "subject", "table_name", "column_name", F.explode("_targets").alias("_target"))
        .select("tenant_slug", "subject", "table_name", "column_name", "_target.*")
    )
    is_id = F.col("column_name").endswith("_id")
    preference = F.struct(
        (~is_id).alias("no_id"),
        F.when(is_id, F.col("ordinal_position")).alias("position"),
        F.col("column_name").alias("key"),
    )
    return (
        shared.groupBy("tenant_slug", "subject", "table_name", "to", "to_table")
        .agg(F.min(preference)["key"].alias("key"))
        .select(
            "tenant_slug",
            "subject",
            "table_name",
            "to",
            "to_table",
            F.lit("left").alias("type"),
            F.col("key").alias("left_on"),
            F.col("key").alias("right_on"),
        )
    )


def derived_date_name(name: Column) -> Column:
    """Name of the date derived from an epoch column."""
    replaced = F.replace(F.replace(name, F.lit("_timestamp"), F.lit("_date")), F.lit("_ts"), F.lit("_date"))
    return F.when(replaced == name, F.concat(name, F.lit("_date"))).otherwise(replaced)


def _has_derived_date() -> Column:
    return F.col("is_time_dimension") & (F.col("bsl_type") == "timestamp_epoch")


def derived_dates(classified: DataFrame) -> DataFrame:
    """Catalogue rows for the derived dates of all epoch dimensions."""
    epochs = classified.filter(_has_derived_date())
    return epochs.select(
        "tenant_slug",
        "table_type",
        "subject",
        "table_name",
        derived_date_name(F.col("column_name")).alias("column_name"),
        F.col("column_name").alias("source_column"),
        "ordinal_position",
    )


def count_measure_name(name: Column) -> Column:
    base = F.replace(name, F.lit("_id"), F.lit(""))
    return F.concat(F.lit("total_"), base, F.when(base.endswith("s"), "").otherwise("s"))


def auto_count_measures(columns: DataFrame) -> DataFrame:
    """COUNT(DISTINCT) measures for text ids of fact tables, unless the name is taken.

    Measure names are ``total_…s`` and ids end with ``_id``, so a column is an id, may take a
    measure's name or neither: ids and takers meet in one window over the name.
    """
    name = F.col("column_name")
    is_id = (
        (F.col("table_type") == "fact")
        & name.endswith("_id")
        & (F.col("data_type") == "VARCHAR")
        & ~name.isin(*SHARED_COLUMNS)
    )
    takes = name.startswith("total_") & name.endswith("s")
    named = columns.filter(is_id | takes).select(
        "tenant_slug",
        "table_type",
        "subject",
        "table_name",
        F.when(takes, name).otherwise(count_measure_name(name)).alias("measure_name"),
        F.when(~takes, name).alias("source_column"),
        "ordinal_position",
    )
    alike = Window.partitionBy("tenant_slug", "table_name", "measure_name")
    taken = F.max(F.col("source_column").isNull()).over(alike) & _all_known(["tenant_slug", "table_name"])
    return named.withColumn("_taken", taken).filter(F.col("source_column").isNotNull() & ~F.col("_taken")).drop("_taken")


# --- metadata with overlays ---------------------------------------------------------

OVERLAY_COLUMNS = (
    "tenant_slug string, table_name string, column_name string, kind string, type string, agg string"
)
OVERLAY_TABLES = "tenant_slug string, table_name string, label string, description string"
OVERLAY_CALCS = "tenant_slug string, table_name string, name string, label string, sql string, format string"
OVERLAY_JOINS = "tenant_slug string, table_name string, to_table string, type string, left_on string, right_on string"

DATE_TYPES = ("date", "timestamp", "timestamp_epoch")


def _with_overrides(rows: DataFrame, overlay: DataFrame | None) -> DataFrame:
    """Apply per-column overrides: a dimension override beats a measure override."""
    if overlay is None:
        return rows
    key = ["tenant_slug", "table_name", "column_name"]
    is_dim, is_measure = F.col("kind") == "dimension", F.col("kind") == "measure"
    picked = overlay.groupBy(*key).agg(
        F.max(is_dim).alias("_dim"),
        F.max(F.when(is_dim, F.col("type"))).alias("_dim_type"),
        F.max(F.when(is_measure, F.col("type"))).alias("_measure_type"),
        F.max(F.when(is_measure, F.col("agg"))).alias("_agg"),
    )
    joined = rows.join(_follows_overlay(picked), key, "left")
    as_dim = F.coalesce("_dim", F.lit(False))
    new_type = F.when(as_dim, F.col("_dim_type")).otherwise(F.col("_measure_type"))
    dated = as_dim & F.coalesce(F.col("_dim_type").isin(*DATE_TYPES), F.lit(False))
    return joined.withColumns(
        {
            "bsl_type": F.coalesce(new_type, "bsl_type"),
            "is_time_dimension": F.col("is_time_dimension") | dated,
            "agg": F.coalesce(F.when(~as_dim, F.col("_agg")), "agg"),
        }
    ).drop("_dim", "_dim_type", "_measure_type", "_agg")


def column_metadata(classified: DataFrame, overlay: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Every queryable field of every model: columns, derived dates, count measures.

    ``position`` orders fields inside a model: a derived date follows its column and
    count measures come last.
    """
    head = ["tenant_slug", "table_type", "subject", "table_name"]
    own = classified.select(
        *head,
        "column_name",
        "bsl_type",
        F.col("semantic_role").alias("role"),
        "is_time_dimension",
        F.col("inferred_agg").alias("agg"),
        F.lit(None).cast("string").alias("source_column"),
        (F.col("ordinal_position") * 2).alias("position"),
        _has_derived_date().alias("_dated"),
    )
    own = _with_overrides(own, overlay)
    # a column and its derived date come out of one row: the columns are not read again for the dates
    date = F.struct(
        derived_date_name(F.col("column_name")).alias("column_name"),
        F.lit("date").alias("bsl_type"),
        F.lit("dimension").alias("role"),
        F.lit(True).alias("is_time_dimension"),
        F.lit(None).cast("string").alias("agg"),
        F.col("column_name").alias("source_column"),
        (F.col("position") + 1).alias("position"),
    )
    itself = F.struct("column_name", "bsl_type", "role", "is_time_dimension", "agg", "source_column", "position")
    fields = own.select(
        *head, F.inline(F.when(F.col("_dated"), F.array(itself, date)).otherwise(F.array(itself)))
    )
    counts = auto_count_measures(classified).select(
        *head,
        F.col("measure_name").alias("column_name"),
        F.lit("number").alias("bsl_type"),
        F.lit("measure").alias("role"),
        F.lit(False).alias("is_time_dimension"),
        F.lit("count_distinct").alias("agg"),
        "source_column",
        (F.col("ordinal_position") + 10_000).alias("position"),
    )
    fields = fields.unionByName(counts)
    label = F.initcap(F.replace("subject", F.lit("_"), F.lit(" ")))
    description = F.concat(F.initcap("table_type"), F.lit(": "), F.col("subject"))
    if tables is None:
        return fields.withColumns({"label": label, "description": description})
    named = tables.select(
        "tenant_slug", "table_name", F.col("label").alias("_label"), F.col("description").alias("_description")
    )
    empty = F.lit("")
    return (
        fields.join(_follows_overlay(named), ["tenant_slug", "table_name"], "left")
        .withColumns(
            {
                "label": F.coalesce(F.nullif("_label", empty), label),
                "description": F.coalesce(F.nullif("_description", empty), description),
            }
        )
        .drop("_label", "_description")
    )


def merge_calc_measures(inferred: DataFrame, overlay: DataFrame) -> DataFrame:
    """Inferred calculated measures plus overlay ones whose name is new on the table."""
    key = ["tenant_slug", "table_name", "name"]
    subjects = F.regexp_extract("table_name", "__(.+)$", 1)
    extra = overlay.join(_follows_tables(inferred.select(*key)), key, "left_anti").withColumn("subject", subjects)
    return inferred.unionByName(extra.select(inferred.columns))


def merge_joins(inferred: DataFrame, overlay: DataFrame) -> DataFrame:
    """Joins per (table, target); an overlay join replaces the inferred one."""
    key = ["tenant_slug", "table_name", "to_table"]
    kept = inferred.join(_follows_tables(overlay.select(*key).distinct()), key, "left_anti")
    named = overlay.withColumns(
        {
            "subject": F.regexp_extract("table_name", "__(.+)$", 1),
            "to": F.regexp_extract("to_table", "__(.+)$", 1),
        }
    )
    return kept.select(inferred.columns).unionByName(named.select(inferred.columns))


def join_cardinality(joins: DataFrame) -> DataFrame:
    """``one`` for dimension targets, ``many`` for fact targets."""
    return joins.withColumn("cardinality", F.when(F.col("to_table").startswith("fct_"), "many").otherwise("one"))


# --- listings ---------------------------------------------------------------------------


def list_models(metadata: DataFrame, joins: DataFrame) -> DataFrame:
    """Per tenant and model: label, description, field counts, whether it has joins."""
    is_dim, is_measure = F.col("role") == "dimension", F.col("role") == "measure"
    key = ["tenant_slug", "subject"]
    # counted per text first: the maximum of a text sorts its rows, counts are hashed
    counted = metadata.groupBy(*key, "label", "description").agg(
        F.count_if(is_dim).alias("dimension_count"), F.count_if(is_measure).alias("measure_count")
    )
    joined = joins.filter(_all_known(key)).select(*key).distinct().withColumn("has_joins", F.lit(True))
    return (
        counted.unionByName(joined, allowMissingColumns=True)
        .groupBy(*key)
        .agg(
            F.max("label").alias("label"),
            F.max("description").alias("description"),
            F.sum("dimension_count").alias("dimension_count"),
            F.sum("measure_count").alias("measure_count"),
            F.coalesce(F.max("has_joins"), F.lit(False)).alias("has_joins"),
        )
        .filter(F.col("dimension_count").isNotNull())
    )


_FIELD = ("name", "type")


def _listed(item: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("position"))


def model_details(
    metadata: DataFrame, calcs: DataFrame, joins: DataFrame, tenant: str | None = None, model: str | None = None
) -> DataFrame:
    """Per tenant and model: dimensions, measures, calculated measures and joins as lists."""
    if tenant is not None:
        metadata, calcs, joins = (d.filter(F.col("tenant_slug") == tenant) for d in (metadata, calcs, joins))
    if model is not None:
        metadata, calcs, joins = (d.filter(F.col("subject") == model) for d in (metadata, calcs, joins))
    key = ["tenant_slug", "subject"]
    pair = [c for c in ("to", "type", "left_on", "right_on", "cardinality") if c in joins.columns]
    dimension = F.struct("position", *_FIELD, "is_time_dimension")
    measure = F.struct("position", *_FIELD, "agg", "source_column")
    named = metadata.withColumns({"name": F.col("column_name"), "type": F.col("bsl_type")})
    # fields, calculated measures and joins are grouped together: no list is sorted for a join
    parts = (
        named.select(
            *key,
            "table_name",
            "label",
            "description",
            F.when(F.col("role") == "dimension", dimension).alias("_dimension"),
            F.when(F.col("role") == "measure", measure).alias("_measure"),
            F.lit(True).alias("_field"),
        )
        .unionByName(calcs.select(*key, F.struct("name", "label", "sql", "format").alias("_calc")), allowMissingColumns=True)
        .unionByName(joins.select(*key, F.struct(*pair).alias("_join")), allowMissingColumns=True)
    )
    grouped = parts.groupBy(*key).agg(
        F.max("table_name").alias("table_name"),
        F.max("label").alias("label"),
        F.max("description").alias("description"),
        _listed("_dimension").alias("dimensions"),
        _listed("_measure").alias("measures"),
        F.sort_array(F.collect_list("_calc")).alias("_calcs"),
        F.sort_array(F.collect_list("_join")).alias("_joins"),
        F.max("_field").alias("_field"),
    )

    def known(items: str) -> Column:
        return F.when(_all_known(key) & (F.size(items) > 0), F.col(items))

    return grouped.filter("_field").select(
        *key,
        "table_name",
        "label",
        "description",
        "dimensions",
        "measures",
        known("_calcs").alias("calculated_measures"),
        known("_joins").alias("joins"),
    )


def require_model(details: DataFrame, model: str) -> DataFrame:
    found = details.filter(F.col("subject") == model)
    if found.isEmpty():
        raise ValueError(f"Model '{model}' not found")
    return found


def all_tenant_models(catalog: DataFrame) -> DataFrame:
    """Models of every tenant, namespaced ``{tenant}__{subject}``."""
    return catalog.select(
        "tenant_slug", "subject", F.concat_ws("__", "tenant_slug", "subject").alias("model_name")
    ).distinct()


def readiness(manifest: DataFrame, catalog: DataFrame, columns: DataFrame) -> DataFrame:
    """Pipeline state per tenant from what has been catalogued so far.

    Tenants that appear in the catalogue but not in the manifest are kept; asking for a
    tenant in neither gives no row, which callers report as ``error``.
    """
    column_counts = columns.groupBy("tenant_slug").agg(F.count(F.lit(1)).alias("column_count"))
    table_counts = catalog.groupBy("tenant_slug").agg(
        F.count(F.lit(1)).alias("table_count"), F.min("table_name").alias("first_table")
    )
    known = manifest.select("tenant_slug", F.col("status").alias("tenant_status"), F.lit(True).alias("registered"))
    joined = known.join(table_counts, "tenant_slug", "full_outer").join(column_counts, "tenant_slug", "full_outer")
    has_columns = F.coalesce("column_count", F.lit(0)) > 0
    has_tables = F.coalesce("table_count", F.lit(0)) > 0
    status = (
        F.when(has_columns, "ready")
        .when(has_tables, "cataloging")
        .when(F.col("registered").isNull(), "error")
        .when(F.col("tenant_status") == "onboarding", "modeling")
        .when(F.col("tenant_status") == "active", "cataloging")
        .otherwise("starting")
    )
    return joined.select(
        "tenant_slug",
        has_columns.alias("is_ready"),
        status.alias("status"),
        F.when(has_columns, F.col("first_table")).alias("last_load_id"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
    )


def tenant_readiness(states: DataFrame, tenant: str) -> DataFrame:
    """One row for a tenant, ``error`` when nothing is known about it."""
    wanted = local_frame(states.sparkSession, [(tenant,)], "tenant_slug string")
    joined = wanted.join(states, "tenant_slug", "left")
    return joined.withColumns(
        {
            "is_ready": F.coalesce("is_ready", F.lit(False)),
            "status": F.coalesce("status", F.lit("error")),
            "column_count": F.coalesce("column_count", F.lit(0)),
        }
    )


def dimension_listing(metadata: DataFrame) -> DataFrame:
    return metadata.filter(F.col("role") == "dimension").select(
        "tenant_slug",
        "subject",
        F.col("column_name").alias("name"),
        F.col("column_name").alias("description"),
        "is_time_dimension",
    )


def measure_listing(metadata: DataFrame) -> DataFrame:
    return metadata.filter(F.col("role") == "measure").select(
        "tenant_slug",
        "subject",
        F.col("column_name").alias("name"),
        F.col("column_name").alias("description"),
    )


def manifest_listing(catalog: DataFrame, tenant: str) -> DataFrame:
    """Raw manifests of one tenant; no rows when it has none."""
    return catalog.filter(F.col("tenant_slug") == tenant).select("subject", "table_name", "semantic_manifest")


def model_order(tables: DataFrame) -> DataFrame:
    """Facts before dimensions, then by table name."""
    order = Window.partitionBy("tenant_slug").orderBy(F.desc("table_type"), F.asc("table_name"))
    return tables.withColumn("model_position", F.row_number().over(order))
