"""Cases for sources, sinks, the hub and its histories, and the streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tributary.functions.keys import surrogate_key
from tributary.operators import hub
from tributary.operators.factories import build_users
from tributary.operators.unpack import unpack
from tributary.plans.pipeline import RawTable, refresh
from tributary.registry import engine, register_engine
from tributary.schemas import BLUEPRINTS, SCHEMA_HISTORY, STAR
from tributary.session import scratch_path
from tributary.sources import raw, sinks, tenants
from tributary.sources.local import local_frame
from tributary.sources.connectors import CONNECTORS, connector_catalog
from tributary.streaming.hub_stream import push_stream, raw_stream
from tributary.streaming.run_stream import compact, current_runs, run_results_stream, runs_stream
from validation import inputs as src, sqltext as sql
from validation.case import case
from validation.star_cases import config, ga_sessions_sql, ga_star_events

MARKER = "_dbt_utils_surrogate_key_null_"


def early():
    return F.expr("timestamp'2024-01-01 00:00:00'")


def late():
    return F.expr("timestamp'2024-02-01 00:00:00'")


# --- sources ------------------------------------------------------------------------


@case(
    "src_1_read_raw",
    "SELECT 't' || (s_suppkey % 3) AS tenant_slug, 'facebook_ads' AS source_platform, 'campaigns' AS source_object, count(*) AS row_count, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1",
)
def src_1(spark, sf):
    tenant = F.concat(F.lit("t"), (F.col("s_suppkey") % 3).cast("string"))
    rows = raw.read_raw(spark, f"{sf}/supplier.parquet", tenant, "facebook_ads", "campaigns")
    return rows.groupBy("tenant_slug", "source_platform", "source_object").agg(
        F.count(F.lit(1)).alias("row_count"), F.round(F.sum("s_acctbal"), 2).alias("balance")
    )


def _read_back(number: str, fmt: str) -> None:
    @case(
        f"src_1_read_raw_{fmt}",
        "SELECT 'c' || (c_custkey % 3) AS tenant_slug, c_mktsegment, count(*) AS row_count, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1, 2",
    )
    def run(spark, sf):
        customer = src.table(spark, sf, "customer")
        path = scratch_path(spark, f"raw-{fmt}")
        customer.write.format(fmt).save(path)
        tenant = F.concat(F.lit("c"), (F.col("c_custkey") % 3).cast("string"))
        rows = raw.read_raw(spark, path, tenant, "shopify", "customers", fmt=fmt, schema=customer.schema)
        return rows.groupBy("tenant_slug", "c_mktsegment").agg(
            F.count(F.lit(1)).alias("row_count"), F.round(F.sum("c_acctbal"), 2).alias("balance")
        )


_read_back("1", "json")
_read_back("1", "csv")


@case("src_2_normalize_landing", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def src_2(spark, sf):
    return raw.normalize_landing(src.table(spark, sf, "orders")).select("o_orderkey", "o_orderdate")


@case("src_3_stamp_load_id", "SELECT 'manual_run' AS dlt_load_id, o_orderstatus, count(*) AS row_count FROM orders GROUP BY 2")
def src_3(spark, sf):
    stamped = raw.stamp_load_id(src.table(spark, sf, "orders"))
    return stamped.groupBy("dlt_load_id", "o_orderstatus").agg(F.count(F.lit(1)).alias("row_count"))


def _logic(supplier: bool = True):
    return F.concat(F.lit('{"nation":'), F.col("s_nationkey").cast("string"), F.lit("}"))


def manifest(spark, sf) -> DataFrame:
    """One tenant per supplier: two configured tables and one source without tables."""
    text = F.concat(
        F.lit('{"shopify": {"enabled": true, "tables": [{"name": "orders", "logic": '), _logic(),
        F.lit('}, {"name": "products", "logic": {}}]}, "google_ads": {"enabled": false}, "facebook_ads": {"enabled": true, "tables": [{"name": "facebook_insights", "logic": '),
        _logic(), F.lit("}]}}"),
    )
    status = F.when(F.col("s_acctbal") > 0, "active").otherwise("onboarding")
    rows = src.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), status.alias("status"), text.alias("sources")
    )
    return tenants.tenant_manifest(rows, loaded_at=early())


MANIFEST = """
manifest AS (SELECT 's' || s_suppkey AS tenant_slug, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'onboarding' END AS status,
  '{"shopify": {"enabled": true, "tables": [{"name": "orders", "logic": ' || '{"nation":' || s_nationkey || '}' ||
  '}, {"name": "products", "logic": {}}]}, "google_ads": {"enabled": false}, "facebook_ads": {"enabled": true, "tables": [{"name": "facebook_insights", "logic": '
  || '{"nation":' || s_nationkey || '}' || '}]}}' AS sources_config, '{"nation":' || s_nationkey || '}' AS logic FROM supplier)"""
CONFIGS = f"""{MANIFEST},
configs AS (SELECT tenant_slug, md5(tenant_slug) AS tenant_skey, source_name, table_name, CASE table_name WHEN 'products' THEN '{{}}' ELSE logic END AS table_logic
  FROM manifest, (VALUES ('shopify', 'orders'), ('shopify', 'products'), ('facebook_ads', 'facebook_insights')) v(source_name, table_name))"""


@case("src_4_tenant_manifest", f"WITH {MANIFEST} SELECT tenant_slug, status, md5(sources_config) AS config_hash FROM manifest")
def src_4(spark, sf):
    return manifest(spark, sf).select("tenant_slug", "status", "config_hash")


_CONNECTOR_VALUES = ", ".join(
    f"('{name}', '{version}', '{hub_id}', '{obj}')" for name, version, hub_id, objects in CONNECTORS for obj in objects
)
CATALOG = f"catalog(source_name, version, master_model_id, source_table_name) AS (VALUES {_CONNECTOR_VALUES})"


@case(
    "src_5_connector_catalog",
    f"""WITH {CATALOG}, {sql.RUNS} SELECT c.*, master_model_id || '_' || source_table_name AS hub_table_id, count(r.node_name) AS runs
    FROM catalog c LEFT JOIN runs r ON ends_with(r.node_name, '__shopify_' || c.source_table_name) GROUP BY ALL""",
)
def src_5(spark, sf):
    runs = src.run_results(spark, sf).select(F.regexp_extract("node_name", "__shopify_(.+)$", 1).alias("source_table_name"))
    counted = runs.groupBy("source_table_name").agg(F.count(F.lit(1)).alias("runs"))
    catalogue = connector_catalog(spark).join(counted, "source_table_name", "left")
    return catalogue.withColumn("runs", F.coalesce("runs", F.lit(0)))


def inventory_tables(spark, sf) -> DataFrame:
    """Physical tables: two per supplier in a tenant schema or a shared one, plus internals."""
    key = F.col("s_suppkey").cast("string")
    slug = F.concat(F.lit("s"), key)
    tables = F.array(
        F.struct(slug.alias("table_schema"), F.concat(F.lit("raw_"), slug, F.lit("_shopify_orders")).alias("table_name")),
        F.struct(F.lit("landing").alias("table_schema"), F.concat(slug, F.lit("_events")).alias("table_name")),
        F.struct(F.lit("main").alias("table_schema"), F.concat(slug, F.lit("_events")).alias("table_name")),
        F.struct(F.lit("my_dbt_artifacts").alias("table_schema"), slug.alias("table_name")),
    )
    return src.table(spark, sf, "supplier").select(
        F.lit("db").alias("table_catalog"), F.explode(tables).alias("t")
    ).select("table_catalog", "t.*")


INVENTORY = """
inventory AS (SELECT 'db' AS project_id, 's' || s_suppkey AS source_schema, 'raw_s' || s_suppkey || '_shopify_orders' AS source_table FROM supplier
  UNION ALL SELECT 'db', 'landing', 's' || s_suppkey || '_events' FROM supplier)"""


@case("src_6_tenant_inventory", f"WITH {INVENTORY} SELECT * FROM inventory")
def src_6(spark, sf):
    return raw.tenant_inventory(inventory_tables(spark, sf)).drop("created_at")


@case(
    "src_6_physical_tables",
    """SELECT 'raw_t' || (o_orderkey % 3) || '_shopify_orders' AS source_table, count(*) AS row_count FROM orders GROUP BY 1""",
)
def src_6_physical(spark, sf):
    """One catalogued table per tenant, made here and found in the catalogue."""
    path = scratch_path(spark, "inventory")
    database = "inventory_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    orders = src.table(spark, sf, "orders")
    for n in range(3):
        orders.filter(f"o_orderkey % 3 = {n}").write.saveAsTable(f"{database}.raw_t{n}_shopify_orders")
    found = raw.tenant_inventory(raw.physical_tables(spark, database))
    counts = [
        spark.table(f"{r.source_schema}.{r.source_table}").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(r.source_table).alias("source_table"), "row_count")
        for r in found.collect()
    ]
    return reduce(DataFrame.unionByName, counts)


# --- sinks ---------------------------------------------------------------------------

ORDER_HUB_SQL = f"WITH {sql.ORDERS} SELECT tenant_slug, 'bigcommerce' AS source_platform, md5(tenant_slug) AS tenant_skey, count(*) AS row_count FROM orders_base GROUP BY 1"


def order_hub(spark, sf) -> DataFrame:
    return src.packed(src.raw_orders(spark, sf, "bigcommerce"), "bigcommerce")


def hub_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tenant_slug", "source_platform", "tenant_skey").agg(F.count(F.lit(1)).alias("row_count"))


@case("snk_1_write_hub", ORDER_HUB_SQL)
def snk_1(spark, sf):
    path = scratch_path(spark, "hub")
    sinks.write_hub(order_hub(spark, sf), path)
    return hub_counts(sinks.read_hub(spark, path))


_SEGMENTS = "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY 1"


def segments(spark, sf) -> DataFrame:
    return src.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


def _own_table(spark, label: str) -> str:
    """A new table name whose files go to the shared scratch folder."""
    return f"{label}_{scratch_path(spark, 'x').rsplit('-', 1)[1]}"


@case("snk_2_materialize", _SEGMENTS)
def snk_2(spark, sf):
    path = scratch_path(spark, "materialized")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS scratch_db LOCATION '{path}'")
    name = f"scratch_db.{_own_table(spark, 'segments')}"
    sinks.materialize(segments(spark, sf).selectExpr("c_mktsegment", "0L AS customers"), name)
    sinks.materialize(segments(spark, sf), name)
    return spark.table(name)


@case(
    "snk_3_persistence_kinds",
    "SELECT kind, c_mktsegment, CASE kind WHEN 'incremental' THEN 2 ELSE 1 END * customers AS customers FROM "
    f"({_SEGMENTS}), (VALUES ('inline'), ('view'), ('table'), ('incremental')) k(kind)",
)
def snk_3(spark, sf):
    path = scratch_path(spark, "persisted")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS scratch_db LOCATION '{path}'")
    base = segments(spark, sf)
    parts = []
    for kind in ("inline", "view", "table", "incremental"):
        own = _own_table(spark, kind)
        name = own if kind == "view" else f"scratch_db.{own}"
        stored = sinks.persist(base, name, kind)
        if kind == "incremental":
            stored = sinks.persist(base, name, kind)
        totals = stored.groupBy("c_mktsegment").agg(F.sum("customers").alias("customers"))
        parts.append(totals.withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@case(
    "snk_4_empty_star",
    f"""WITH {sql.ORDERS} SELECT 'dim_campaigns' AS table_name, 5 AS columns, 0 AS row_count UNION ALL SELECT 'dim_users', 13, 0
    UNION ALL SELECT 'fct_ad_performance', 10, 0 UNION ALL SELECT 'fct_events', 14, 0 UNION ALL SELECT 'fct_sessions', 25, 0
    UNION ALL SELECT 'fct_orders', 10, count(*) FROM star_orders""",
)
def snk_4(spark, sf):
    """Empty relations union with filled ones: the contract's columns and types agree."""
    parts = []
    for name in STAR:
        df = sinks.empty_star(spark, name)
        df = df.unionByName(src.orders(spark, sf)) if name == "fct_orders" else df
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), "row_count"
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@case("snk_5_overwrite_current", f"WITH {sql.RUNS} SELECT invocation_id, status, count(*) AS runs FROM runs WHERE status <> 'error' GROUP BY 1, 2")
def snk_5(spark, sf):
    path = scratch_path(spark, "current")
    runs = src.run_results(spark, sf)
    sinks.overwrite_current(runs, path)
    # the next snapshot is computed from the one it replaces
    sinks.overwrite_current(sinks.read_current(spark, path).filter("status <> 'error'"), path)
    return sinks.read_current(spark, path).groupBy("invocation_id", "status").agg(F.count(F.lit(1)).alias("runs"))


# --- hub -----------------------------------------------------------------------------


@case(
    "hub_1_pack_payload",
    f"""WITH {sql.ORDERS} SELECT tenant_slug, md5(tenant_slug) AS tenant_skey, 'shopify' AS source_platform, 'abc' AS source_schema_hash,
    o_orderkey AS id, order_status AS status, CAST(NULL AS VARCHAR) AS source_schema, 3 AS payload_keys FROM orders_base""",
)
def hub_1(spark, sf):
    rows = src.orders_base(spark, sf).select(
        "tenant_slug", F.col("order_key").alias("id"), F.col("order_status").alias("status"), F.lit(None).cast("string").alias("note")
    )
    packed = hub.pack_payload(rows, F.col("tenant_slug"), "shopify", "abc", payload=["id", "status", "note"])
    return packed.select(
        "tenant_slug", "tenant_skey", "source_platform", "source_schema_hash", "source_schema",
        F.get_json_object("raw_data_payload", "$.id").cast("bigint").alias("id"),
        F.get_json_object("raw_data_payload", "$.status").alias("status"),
        F.size(F.json_object_keys("raw_data_payload")).alias("payload_keys"),
    )


@case(
    "hub_2_surrogate_key",
    f"SELECT o_orderkey, md5(o_orderkey || '-' || coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, '{MARKER}') || '-' || o_orderstatus) AS skey FROM orders",
)
def hub_2(spark, sf):
    priority = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return src.table(spark, sf, "orders").select(
        "o_orderkey", surrogate_key("o_orderkey", priority, "o_orderstatus").alias("skey")
    )


def landing_columns(spark, sf) -> DataFrame:
    """Raw table columns of one tenant per customer; some tenants have an extra column."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.lit(i).alias("ordinal_position"))
            for i, (n, t) in enumerate(
                (("id", "bigint"), ("name", "text"), ("status", "text"), ("spend", "double"), ("day", "date"),
                 ("active", "bool"), ("notes", "json"), ("_dlt_id", "text"), ("budget", "decimal")), 1)
        ]
    )
    customer = src.table(spark, sf, "customer")
    return (
        customer.select("c_custkey", "c_nationkey", F.explode(rows).alias("c"))
        .filter((F.col("c.column_name") != "budget") | (F.col("c_nationkey") % 2 == 0))
        .select(
            F.concat(F.lit("raw_c"), F.col("c_custkey").cast("string"), F.lit("_facebook_ads_campaigns")).alias("table_name"),
            "c.*", (F.col("c.column_name") == "id").alias("primary_key"),
        )
    )


LANDING = """
landing AS (SELECT 'raw_c' || c_custkey || '_facebook_ads_campaigns' AS table_name, column_name, data_type, ordinal_position
  FROM customer, (VALUES ('id', 'bigint', 1), ('name', 'text', 2), ('status', 'text', 3), ('spend', 'double', 4), ('day', 'date', 5),
    ('active', 'bool', 6), ('notes', 'json', 7), ('_dlt_id', 'text', 8), ('budget', 'decimal', 9)) v(column_name, data_type, ordinal_position)
  WHERE column_name <> 'budget' OR c_nationkey % 2 = 0),
prints AS (SELECT table_name, md5(string_agg(column_name || ':' || data_type, '|' ORDER BY column_name)) AS source_schema_hash
  FROM landing WHERE NOT starts_with(column_name, '_dlt') GROUP BY 1)"""


@case("hub_3_schema_fingerprint", f"WITH {LANDING} SELECT * FROM prints")
def hub_3(spark, sf):
    return hub.fingerprint_tables(landing_columns(spark, sf), ["table_name"])


def blueprint_rows(spark, sf) -> DataFrame:
    """Candidate blueprints: a hash per landed table, stamped with the customer key's second."""
    prints = hub.fingerprint_tables(landing_columns(spark, sf), ["table_name"])
    key = F.regexp_extract("table_name", r"raw_c(\d+)_", 1).cast("bigint")
    return prints.select(
        F.lit("facebook_ads").alias("source_name"), F.lit("campaigns").alias("source_table_name"), "source_schema_hash",
        F.concat(F.lit("facebook_ads_api_v1_campaigns_"), key.cast("string")).alias("master_model_id"),
        F.lit("v19").alias("version"), F.timestamp_seconds(key).alias("registered_at"),
    )


_BLUE = """
keyed AS (SELECT *, CAST(regexp_extract(table_name, 'raw_c(\\d+)_', 1) AS BIGINT) AS k FROM prints),
blue AS (SELECT source_schema_hash, 'facebook_ads_api_v1_campaigns_' || min(k) AS master_model_id, min(k) AS k FROM keyed GROUP BY 1)"""


@case(
    "hub_4_route",
    f"""WITH {LANDING}, {_BLUE}, known AS (SELECT * FROM blue WHERE k = 0)
    SELECT p.table_name, p.source_schema_hash, coalesce(b.master_model_id, 'unknown') AS master_model_id FROM prints p LEFT JOIN known b ON p.source_schema_hash = b.source_schema_hash""",
)
def hub_4(spark, sf):
    prints = hub.fingerprint_tables(landing_columns(spark, sf), ["table_name"])
    registered = hub.register_blueprints(blueprint_rows(spark, sf), local_frame(spark, [], BLUEPRINTS))
    known = registered.filter(F.unix_seconds("registered_at") == 0)
    return hub.route(prints, known)


@case(
    "hub_5_register_blueprints",
    f"WITH {LANDING}, {_BLUE} SELECT 'facebook_ads' AS source_name, 'campaigns' AS source_table_name, source_schema_hash, master_model_id, 'v19' AS version FROM blue WHERE k <> 0",
)
def hub_5(spark, sf):
    candidates = blueprint_rows(spark, sf)
    existing = candidates.filter(F.unix_seconds("registered_at") == 0)
    return hub.register_blueprints(candidates, existing).drop("registered_at")


@case(
    "hub_6_parse_raw_name",
    """SELECT 'raw_s' || s_suppkey || '_' || v.source || '_' || v.object AS table_name, 's' || s_suppkey AS tenant_slug, v.source AS source_platform, v.object AS source_object
    FROM supplier, (VALUES ('facebook_ads', 'ad_sets'), ('google_analytics', 'events'), ('shopify', 'orders')) v(source, object)""",
)
def hub_6(spark, sf):
    rest = ("facebook_ads_ad_sets", "google_analytics_events", "shopify_orders", "stripe_charges", "shopify_orders_dlt_loads")
    names = src.table(spark, sf, "supplier").select(
        F.concat(F.lit("raw_s"), F.col("s_suppkey").cast("string")).alias("head"), F.explode(F.array(*map(F.lit, rest))).alias("rest")
    )
    return hub.parse_raw_name(names.select(F.concat_ws("_", "head", "rest").alias("table_name")))


def order_batch(spark, sf, condition: str) -> DataFrame:
    rows = src.raw_orders(spark, sf, "bigcommerce").filter(condition)
    return src.packed(rows, "bigcommerce")


@case(
    "hub_7_insert_only_push",
    f"""WITH {sql.ORDERS} SELECT tenant_slug, CAST(sum(CASE WHEN order_status = 'F' THEN 1 ELSE 2 END) AS BIGINT) AS row_count, count(DISTINCT o_orderkey) AS orders
    FROM orders_base GROUP BY 1""",
)
def hub_7(spark, sf):
    """First push: fulfilled orders.  Second: everything twice.  Third: everything again."""
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, order_batch(spark, sf, "status = 'F'"))
    everything = order_batch(spark, sf, "true")
    hub.push_into(spark, path, everything.unionByName(everything))
    hub.push_into(spark, path, everything)
    stored = sinks.read_hub(spark, path)
    order_id = F.get_json_object("raw_data_payload", "$.id")
    return stored.groupBy("tenant_slug").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(order_id).alias("orders")
    )


@case(
    "hub_7_null_tenants_and_new_column",
    f"""WITH {sql.ORDERS} SELECT CASE WHEN o_orderkey % 5 > 0 THEN tenant_slug END AS tenant_slug, count(*) AS row_count,
    count(*) FILTER (WHERE order_status <> 'F') AS with_region FROM orders_base GROUP BY 1""",
)
def hub_7_evolving(spark, sf):
    """Orders with and without a tenant, pushed three times; the later pushes bring a column."""
    path = scratch_path(spark, "hub")
    key = F.get_json_object("raw_data_payload", "$.id").cast("bigint")
    tenant = F.when(key % 5 > 0, F.col("tenant_slug"))
    hub.push_into(spark, path, order_batch(spark, sf, "status = 'F'").withColumn("tenant_slug", tenant))
    everything = order_batch(spark, sf, "true").withColumn("tenant_slug", tenant).withColumn("region", F.lit("EU"))
    for _ in range(3):
        hub.push_into(spark, path, everything)
    stored = sinks.read_hub(spark, path, evolve=True)
    return stored.groupBy("tenant_slug").agg(F.count(F.lit(1)).alias("row_count"), F.count("region").alias("with_region"))


def observations(spark, sf, condition: str = "true") -> DataFrame:
    tenant = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    digest = F.md5(F.concat(F.lit("v"), F.year("o_orderdate").cast("string")))
    return src.table(spark, sf, "orders").filter(condition).select(
        tenant.alias("tenant_slug"), F.lit("shopify").alias("source_platform"), F.lit("shopify_orders").alias("_src_table"),
        digest.alias("source_schema_hash"), F.concat(F.lit('{"year":'), F.year("o_orderdate").cast("string"), F.lit("}")).alias("source_schema"),
    )


def schema_history(spark, sf) -> DataFrame:
    empty = local_frame(spark, [], SCHEMA_HISTORY)
    first = hub.push_schema_history(empty, observations(spark, sf, "year(o_orderdate) <= 1997"), early())
    return hub.push_schema_history(first, observations(spark, sf, "year(o_orderdate) >= 1997"), late())


_HISTORY = """
versions AS (SELECT DISTINCT 'c' || o_custkey AS tenant_slug, year(o_orderdate) AS y FROM orders),
history AS (SELECT tenant_slug, 'shopify' AS platform_name, 'orders' AS source_table_name, md5('v' || y) AS source_schema_hash,
  md5(tenant_slug || '-shopify-orders-' || md5('v' || y)) AS source_schema_skey, CASE WHEN y <= 1997 THEN '2024-01-01' ELSE '2024-02-01' END AS first_seen_at,
  CASE WHEN y < 1997 THEN '2024-01-01' ELSE '2024-02-01' END AS updated_at FROM versions)"""


@case("hub_8_schema_history", f"WITH {_HISTORY} SELECT * FROM history")
def hub_8(spark, sf):
    day = "yyyy-MM-dd"
    return schema_history(spark, sf).select(
        "tenant_slug", "platform_name", "source_table_name", "source_schema_hash", "source_schema_skey",
        F.date_format("first_seen_at", day).alias("first_seen_at"), F.date_format("updated_at", day).alias("updated_at"),
    )


@case(
    "hub_9_schema_manifest",
    """SELECT 't0' AS tenant_slug, v.table_name, v.columns, v.dimensions, v.measures, n.row_count FROM (VALUES
    ('orders', 6, 'o_orderstatus,o_orderdate,o_orderpriority', 'o_orderkey,o_custkey,o_totalprice'),
    ('customer', 5, 'c_name,c_mktsegment', 'c_custkey,c_nationkey,c_acctbal')) v(table_name, columns, dimensions, measures)
    JOIN (SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer) n USING (table_name)""",
)
def hub_9(spark, sf):
    """Schemas and manifests of two raw tables, next to their row counts."""
    tables = {name: src.table(spark, sf, name) for name in ("orders", "customer")}
    rows = hub.schema_manifest(spark, "t0", tables)
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(n)) for n, df in tables.items()]
    listed = "dimensions array<struct<name:string>>, measures array<struct<name:string>>"
    manifest = F.from_json("boring_semantic_manifest", listed)
    return rows.join(reduce(DataFrame.unionByName, counts), "table_name").select(
        "tenant_slug", "table_name",
        F.json_array_length(F.get_json_object("source_schema", "$.fields")).alias("columns"),
        F.array_join(manifest.getField("dimensions").getField("name"), ",").alias("dimensions"),
        F.array_join(manifest.getField("measures").getField("name"), ",").alias("measures"), "row_count",
    )


@case(
    "hub_10_raw_manifest",
    f"""WITH {LANDING} SELECT table_name, 'id' AS primary_key,
    string_agg(column_name || ':' || CASE data_type WHEN 'text' THEN 'string' ELSE data_type END, ',' ORDER BY ordinal_position) FILTER (WHERE data_type IN ('text', 'timestamp', 'date', 'bool')) AS dimensions,
    string_agg(column_name || ':sum', ',' ORDER BY ordinal_position) FILTER (WHERE data_type IN ('double', 'bigint', 'integer', 'decimal')) AS measures FROM landing GROUP BY 1""",
)
def hub_10(spark, sf):
    rows = hub.raw_manifest(landing_columns(spark, sf))
    return rows.select(
        "table_name", "primary_key",
        F.array_join(F.transform("dimensions", lambda d: F.concat_ws(":", d["name"], d["type"])), ",").alias("dimensions"),
        F.array_join(F.transform("measures", lambda m: F.concat_ws(":", m["name"], m["agg"])), ",").alias("measures"),
    )


@case("hub_11_config_history", f"WITH {CONFIGS} SELECT *, md5(table_logic) AS logic_hash FROM configs")
def hub_11(spark, sf):
    return hub.config_history(manifest(spark, sf)).drop("updated_at")


def versioned_history(spark, sf) -> DataFrame:
    """Two generations of configuration; the later one changes the logic of half the tenants."""
    old = hub.config_history(manifest(spark, sf))
    changed = old.filter("tenant_slug like '%1' or tenant_slug like '%3'").withColumns(
        {"table_logic": F.lit("[]"), "logic_hash": F.md5(F.lit("[]")), "updated_at": late()}
    )
    return old.unionByName(changed)


_LATEST = f"""{CONFIGS},
latest AS (SELECT tenant_slug, tenant_skey, source_name, table_name, CASE WHEN newer THEN '[]' ELSE table_logic END AS table_logic,
  md5(CASE WHEN newer THEN '[]' ELSE table_logic END) AS logic_hash, CASE WHEN newer THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated_at
  FROM (SELECT *, tenant_slug LIKE '%1' OR tenant_slug LIKE '%3' AS newer FROM configs))"""


@case(
    "hub_12_latest_source_configs",
    f"WITH {_LATEST} SELECT tenant_skey, tenant_slug, source_name AS platform_name, table_name, table_logic, logic_hash, updated_at FROM latest",
)
def hub_12(spark, sf):
    rows = hub.latest_source_configs(versioned_history(spark, sf))
    return rows.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@case(
    "hub_13_hub_keys",
    f"""WITH {_LATEST} SELECT tenant_slug AS client_slug, source_name AS platform_name, table_name, tenant_skey, logic_hash AS logic_config_hash,
    md5(tenant_slug || '-' || source_name || '-' || updated_at || '-' || logic_hash) AS generated_hash FROM latest""",
)
def hub_13(spark, sf):
    return hub.hub_keys(versioned_history(spark, sf)).drop("logic_version_at", "logged_at")


@case(
    "hub_14_master_registry",
    f"WITH {LANDING}, {_BLUE} SELECT source_schema_hash, 'facebook_ads' AS source_platform, 'campaigns' AS source_table_name, master_model_id, 'v19' AS blueprint_version, k AS registered FROM blue",
)
def hub_14(spark, sf):
    registered = hub.register_blueprints(blueprint_rows(spark, sf), local_frame(spark, [], BLUEPRINTS))
    return hub.master_registry(registered).select("*", F.unix_seconds("registered_at").alias("registered")).drop("registered_at")


@case(
    "hub_15_schema_drift",
    f"""WITH {_HISTORY} SELECT tenant_slug, platform_name, source_table_name, previous_hash, source_schema_hash AS current_hash, first_seen_at AS changed_at FROM
    (SELECT *, lag(source_schema_hash) OVER (PARTITION BY tenant_slug ORDER BY first_seen_at, source_schema_hash) AS previous_hash FROM history) WHERE previous_hash <> source_schema_hash""",
)
def hub_15(spark, sf):
    drift = hub.schema_drift(schema_history(spark, sf))
    return drift.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd")).drop("last_seen_at")


_CONVERSION = "((tenant_slug = 't0' AND event_name = 'purchase'))"


def _refresh_sql(ads: str) -> str:
    return f"""WITH {ga_sessions_sql(1800, _CONVERSION)}, {sql.ADS_BASE}, {sql.ORDERS}
    SELECT 'sessions' AS subject, tenant_slug, source_platform, count(*) AS row_count, CAST(sum(funnel_conversion_count) AS BIGINT) AS measure FROM sessions WHERE tenant_slug = 't0' GROUP BY 1, 2, 3
    UNION ALL SELECT 'events', tenant_slug, source_platform, count(*), count(user_id) FROM ga WHERE tenant_slug = 't0' GROUP BY 1, 2, 3
    UNION ALL SELECT 'users', tenant_slug, source_platform, count(DISTINCT user_pseudo_id), count(*) FROM ga WHERE tenant_slug = 't0' GROUP BY 1, 2, 3
    UNION ALL SELECT 'orders', tenant_slug, 'shopify', count(*), count(o_custkey) FROM orders_base WHERE tenant_slug = 't0' GROUP BY 1, 2, 3
    UNION ALL SELECT 'ad_performance', tenant_slug, p.source_platform, count(*), CAST(sum(clicks) AS BIGINT)
      FROM ads_base, (VALUES ('facebook_ads'), ('google_ads')) p(source_platform) WHERE tenant_slug IN ({ads}) GROUP BY 1, 2, 3"""


def _star_summary(star) -> DataFrame:
    measures = {
        "sessions": F.sum("funnel_conversion_count"), "events": F.count("user_id"), "users": F.sum("total_events"),
        "orders": F.count("customer_id"), "ad_performance": F.sum("clicks"),
    }
    parts = [
        star[subject].groupBy("tenant_slug", "source_platform").agg(F.count(F.lit(1)).alias("row_count"), m.alias("measure"))
        .withColumn("subject", F.lit(subject))
        for subject, m in measures.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _raw_tables(spark, sf):
    def of(source, name, rows):
        return RawTable(source, name, rows, F.col("tenant_slug"))

    first = [
        of("google_analytics", "events", src.raw_ga(spark, sf).drop("source_platform")),
        of("shopify", "orders", src.raw_orders(spark, sf, "shopify")),
        of("facebook_ads", "facebook_insights", src.raw_ads(spark, sf, "facebook_ads")),
    ]
    return first, [of("google_ads", "ad_performance", src.raw_ads(spark, sf, "google_ads"))]


@case("hub_16_refresh", _refresh_sql("'t0', 't2'"))
def hub_16(spark, sf):
    """Two refreshes with different connectors: the second keeps what the first landed.

    t1 and t2 are configured with other stores and analytics sources first, so only t0 has
    orders, events, sessions and users here.
    """
    hubs, star = scratch_path(spark, "hubs"), scratch_path(spark, "star")
    for tables in _raw_tables(spark, sf):
        result = refresh(spark, hubs, star, tables, config(spark))
    return _star_summary(result)


@case("hub_16_source_disabled", _refresh_sql("'t2'"))
def hub_16_disabled(spark, sf):
    """A refresh of one tenant after its ad sources were disabled empties its partition only."""
    hubs, star = scratch_path(spark, "hubs"), scratch_path(spark, "star")
    first, second = _raw_tables(spark, sf)
    refresh(spark, hubs, star, first + second, config(spark))
    less = config(spark).withColumn("enabled", F.expr("enabled AND NOT (tenant_slug = 't0' AND source LIKE '%ads')"))
    return _star_summary(refresh(spark, hubs, star, [], less, tenants=["t0"]))


# --- extension points ------------------------------------------------------------------


@case("ext_1_registered_engine", "SELECT 't' || (o_orderkey % 3) AS tenant_slug, 'custom_store' AS source_platform, count(*) AS orders FROM orders GROUP BY 1")
def ext_1(spark, sf):
    def custom(rows: DataFrame) -> DataFrame:
        return sinks.conform(rows.withColumn("source_platform", F.lit("custom_store")), "fct_orders")

    register_engine("custom_store", "orders", custom)
    result = engine("custom_store", "orders")(src.orders(spark, sf))
    return result.groupBy("tenant_slug", "source_platform").agg(F.count(F.lit(1)).alias("orders"))


@case(
    "ext_1_users_engine",
    f"""WITH {sql.GA} SELECT tenant_slug, 'custom_analytics' AS source_platform, count(DISTINCT user_pseudo_id) AS users,
    count(*) AS total_events FROM ga WHERE tenant_slug = 't1' GROUP BY 1""",
)
def ext_1_users(spark, sf):
    """A source with a users engine of its own goes through the factory; t0 keeps the built-in one."""

    def custom(events: DataFrame, orders: DataFrame) -> DataFrame:
        counted = events.groupBy("tenant_slug", "source_platform", "user_pseudo_id").agg(F.count(F.lit(1)).alias("total_events"))
        return sinks.conform(counted, "dim_users")

    register_engine("custom_analytics", "users", custom)
    schema = "tenant_slug string, source string, rank int, enabled boolean, conversion_events array<string>"
    pairs = [("t0", "google_analytics", 1, True, []), ("t1", "custom_analytics", 1, True, []), ("t2", "mixpanel", 1, False, [])]
    events = ga_star_events(spark, sf).withColumn(
        "source_platform", F.when(F.col("tenant_slug") == "t1", "custom_analytics").otherwise(F.col("source_platform"))
    )
    built = build_users(spark, events, src.orders(spark, sf), local_frame(spark, pairs, schema))
    mine = built.filter("source_platform = 'custom_analytics'").groupBy("tenant_slug", "source_platform")
    return mine.agg(F.count_distinct("user_pseudo_id").alias("users"), F.sum("total_events").alias("total_events"))


@case("ext_2_expression_field", "SELECT 't' || (o_orderkey % 3) AS tenant_slug, CAST(sum(o_orderkey * 2 + 1) AS BIGINT) AS doubled FROM orders GROUP BY 1")
def ext_2(spark, sf):
    from tributary.operators.unpack import Field, Spec

    spec = Spec("bigcommerce", "orders", (Field("doubled", ("id",), "bigint", "cast(p.id as bigint) * 2 + 1"),))
    rows = unpack(order_hub(spark, sf), spec)
    return rows.groupBy("tenant_slug").agg(F.sum("doubled").alias("doubled"))


# --- streams -----------------------------------------------------------------------------


@case(
    "str_1_push_stream",
    f"WITH {sql.ORDERS} SELECT tenant_slug, 'bigcommerce' AS source_platform, md5(tenant_slug) AS tenant_skey, count(*) AS row_count FROM orders_base GROUP BY 1",
)
def str_1(spark, sf):
    """The whole orders table as raw files, delivered twice; the second delivery adds nothing."""
    landing, stored, progress = (scratch_path(spark, x) for x in ("landing", "hub", "progress"))
    rows = src.raw_orders(spark, sf, "bigcommerce")
    for _ in range(2):
        rows.write.mode("append").json(landing)
        stream = raw_stream(spark, landing, T.StructType(sorted(rows.schema.fields, key=lambda f: f.name)))
        body = sorted(c for c in rows.columns if c != "tenant_slug")
        push_stream(stream, stored, progress, F.col("tenant_slug"), "bigcommerce", "h", payload=body).awaitTermination()
    return hub_counts(sinks.read_hub(spark, stored))


@case(
    "str_2_run_results_stream",
    f"""WITH {sql.RUNS}, staged AS (SELECT *, row_number() OVER (PARTITION BY invocation_id, node_id ORDER BY run_started_at DESC, extracted_at DESC, status, node_name) AS rn FROM runs)
    SELECT invocation_id, node_id, status AS run_result_status, rows_affected FROM staged WHERE rn = 1""",
)
def str_2(spark, sf):
    """Three deliveries of the run log, a snapshot before the last: rows fold in by key."""
    landing, stored, progress, snapshot = (scratch_path(spark, x) for x in ("runlog", "runs", "progress", "snapshot"))
    runs = src.run_results(spark, sf)
    for condition in ("year(run_started_at) >= 1997", "year(run_started_at) < 1997", "year(run_started_at) = 1997"):
        runs.filter(condition).write.mode("append").parquet(landing)
        run_results_stream(runs_stream(spark, landing), stored, progress).awaitTermination()
        if condition.endswith("< 1997"):
            compact(spark, stored, snapshot)
    return current_runs(spark, stored, snapshot).select("invocation_id", "node_id", "run_result_status", "rows_affected")

