"""Raw connector tables: reading, landing normalisation, load ids, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tributary.sources.local import local_frame

DEFAULT_LOAD_ID = "manual_run"  # fixed value
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def read_raw(
    spark: SparkSession,
    path: str,
    tenant: str | Column,
    source: str,
    object_name: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Scan one raw table and stamp where it came from.

    ``tenant`` may be a column expression when one landing table serves all tenants.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    tenant_col = tenant if isinstance(tenant, Column) else F.lit(tenant)
    return reader.load(path).withColumns(
        {
            "tenant_slug": tenant_col,
            "source_platform": F.lit(source),
            "source_object": F.lit(object_name),
        }
    )


def normalize_landing(df: DataFrame) -> DataFrame:
    """Dates and timestamps land as text, so a fingerprint does not depend on inference."""
    return df.select(
        [
            F.col(f"`{f.name}`").cast("string").alias(f.name)
            if isinstance(f.dataType, _TEMPORAL)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def stamp_load_id(df: DataFrame, load_id: str = DEFAULT_LOAD_ID) -> DataFrame:
    return df.withColumn("dlt_load_id", F.lit(load_id))


def describe_columns(df: DataFrame, **labels: str) -> list[tuple]:
    """(labels…, column, type, position) rows of one frame's schema; schema metadata only."""
    from tributary.schemas import catalogue_type

    return [
        (*labels.values(), f.name, catalogue_type(f.name, f.dataType.simpleString()), i)
        for i, f in enumerate(df.schema.fields, start=1)
    ]


def physical_tables(spark: SparkSession, databases: str = "*") -> DataFrame:
    """All catalogued tables of the databases like a pattern: (table_catalog, table_schema, table_name).

    Reads catalogue entries database by database, one call each; no table data is touched.
    """
    rows = []
    for database in spark.catalog.listDatabases(databases):
        for table in spark.catalog.listTables(database.name):
            if not table.isTemporary:  # a session's temporary views are listed with every database
                rows.append((spark.catalog.currentCatalog(), database.name, table.name))
    schema = "table_catalog string, table_schema string, table_name string"
    return local_frame(spark, rows, schema)


def tenant_inventory(tables: DataFrame) -> DataFrame:
    """Tenant tables only: build schemas, system schemas and the default one are dropped."""
    schema = F.col("table_schema")
    # Schemas that never hold tenant tables.
    system = ["information_schema", "pg_catalog", "main"]
    return tables.filter(~schema.like("%dbt%") & ~schema.isin(system)).select(
        F.col("table_catalog").alias("project_id"),
        schema.alias("source_schema"),
        F.col("table_name").alias("source_table"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
