"""Cases for the catalogue, inference, structured queries and dashboards."""

from __future__ import annotations

import datetime as dt
import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.operators import analytics, catalog, dashboard, profile
from tributary.operators.factories import TABLE_OF
from tributary.operators.questions import KEYWORDS, route_questions
from tributary.plans.alias import AliasDimension, AliasMeasure, AliasModel, date_safe
from tributary.plans.model import SemanticLayer
from tributary.plans.query import Filter, OrderBy, Request, preview, semantic_query
from tributary.schemas import STAR, catalogue_type
from tributary.sources.local import local_frame
from validation import inputs as src, sqltext as sql
from validation.case import case
from validation.star_cases import DAY, PURCHASE, _amp_sessions, _mix_sql, ga_sessions, ga_sessions_sql, ga_star_events, rounded, users_sql
from tributary.operators.users import users

# --- a multi-tenant columns frame: every customer is a tenant ------------------------------

#: (prefix, subject, column, type, position) of the six star tables.
CONTRACT = [
    (table.split("_", 1)[0], subject, f.name, catalogue_type(f.name, f.dataType.simpleString()), i)
    for subject, table in TABLE_OF.items()
    for i, f in enumerate(STAR[table].fields, start=1)
]
CONTRACT_FIELDS = ("prefix", "subject", "column_name", "data_type", "ordinal_position")


def _tenant():
    return F.concat(F.lit("c"), F.col("c_custkey").cast("string"))


def _has(subject):
    """Tenants of every fifth nation have no orders table, of every seventh no users table."""
    nation = F.col("c_nationkey")
    return ~((subject == "orders") & (nation % 5 == 0)) & ~((subject == "users") & (nation % 7 == 0))


def physical_columns(spark, sf) -> DataFrame:
    """information_schema-like rows (table_schema, table_name, column_name, …) of all tenants."""
    shape = "array<struct<prefix:string,subject:string,column_name:string,data_type:string,ordinal_position:int>>"
    items = F.from_json(F.lit(json.dumps([dict(zip(CONTRACT_FIELDS, c, strict=True)) for c in CONTRACT])), shape)
    customers = src.spread(spark, sf, "customer", "c_custkey c_nationkey", "c_custkey")
    exploded = customers.select("c_custkey", "c_nationkey", F.explode(items).alias("x"))
    return exploded.filter(_has(F.col("x.subject"))).select(
        F.lit("main").alias("table_schema"),
        F.concat("x.prefix", F.lit("_"), _tenant(), F.lit("__"), "x.subject").alias("table_name"),
        "x.column_name",
        "x.data_type",
        "x.ordinal_position",
    )


def physical_tables(spark, sf) -> DataFrame:
    """Star tables of all tenants plus tables whose names carry no tenant."""
    names = F.from_json(F.lit(json.dumps(sorted({c[:2] for c in CONTRACT}))), "array<array<string>>")
    customers = src.spread(spark, sf, "customer", "c_custkey c_nationkey", "c_custkey")
    exploded = customers.select("c_custkey", "c_nationkey", F.explode(names).alias("x"))
    star = exploded.filter(_has(F.col("x")[1])).select(
        F.lit("main").alias("table_schema"),
        F.concat(F.col("x")[0], F.lit("_"), _tenant(), F.lit("__"), F.col("x")[1]).alias("table_name"),
    )
    odd = src.table(spark, sf, "supplier").select(
        F.lit("main").alias("table_schema"), F.concat(F.lit("fct_"), F.lower("s_name")).alias("table_name")
    )
    return star.unionByName(odd)


def classified_columns(spark, sf) -> DataFrame:
    return catalog.column_catalog(semantic(spark, sf))


def semantic(spark, sf) -> DataFrame:
    return catalog.semantic_tables(physical_tables(spark, sf), physical_columns(spark, sf))


def star_columns(spark, sf) -> DataFrame:
    return catalog.flatten_manifest(semantic(spark, sf))


_VALUES = ", ".join(f"('{p}', '{s}', '{c}', '{k}', {i})" for p, s, c, k, i in CONTRACT)
COLS = f"""
contract(prefix, subject, column_name, data_type, ordinal_position) AS (VALUES {_VALUES}),
cols AS (
  SELECT 'c' || c_custkey AS tenant_slug, CASE prefix WHEN 'fct' THEN 'fact' ELSE 'dimension' END AS table_type, subject,
    prefix || '_c' || c_custkey || '__' || subject AS table_name, column_name, data_type, ordinal_position, c_mktsegment
  FROM customer, contract
  WHERE NOT (subject = 'orders' AND c_nationkey % 5 = 0) AND NOT (subject = 'users' AND c_nationkey % 7 = 0))"""

#: The column names of each table, so that a rule about several columns needs no self-join.
_HELD = "held AS (SELECT tenant_slug, subject, table_name, list(column_name) AS names FROM cols GROUP BY ALL)"
_EPOCH = r"(data_type IN ('BIGINT', 'INTEGER') AND regexp_matches(column_name, '_(start|end|ts|at|timestamp|date)$') AND NOT starts_with(column_name, 'funnel_'))"
_ROLE = r"""CASE WHEN column_name = 'tenant_slug' OR data_type IN ('JSON', 'BLOB') THEN 'skip'
  WHEN data_type IN ('DOUBLE', 'FLOAT', 'DECIMAL', 'REAL') THEN 'measure'
  WHEN data_type IN ('BIGINT', 'INTEGER', 'INT', 'SMALLINT', 'TINYINT', 'HUGEINT') THEN
    CASE WHEN starts_with(column_name, 'funnel_') THEN 'measure'
      WHEN regexp_matches(column_name, '_(id|key|slug|name|status|type|category|email|source|medium|campaign|country|device|start|end|ts|at|timestamp|date)$') THEN 'dimension'
      ELSE 'measure' END
  ELSE 'dimension' END"""
_TYPE = f"""CASE WHEN data_type IN ('VARCHAR', 'TEXT') THEN 'string' WHEN data_type = 'DATE' THEN 'date'
  WHEN data_type = 'TIMESTAMP' THEN 'timestamp' WHEN data_type IN ('BOOLEAN', 'BOOL') THEN 'boolean'
  WHEN {_EPOCH} THEN 'timestamp_epoch' ELSE 'number' END"""
CLASSIFIED = f"""{COLS},
roles AS (SELECT *, {_ROLE} AS semantic_role, {_TYPE} AS bsl_type,
    data_type IN ('DATE', 'TIMESTAMP') OR {_EPOCH} AS is_time_dimension FROM cols),
classified AS (SELECT *, CASE WHEN semantic_role <> 'measure' THEN NULL
    WHEN column_name LIKE '%duration%' OR column_name LIKE '%avg%' THEN 'avg'
    WHEN column_name LIKE '%count%' OR column_name LIKE '%events_in%' THEN 'sum'
    WHEN ends_with(column_name, '_id') THEN 'count_distinct' ELSE 'sum' END AS inferred_agg
  FROM roles WHERE semantic_role <> 'skip')"""


@case("sem_1_star_catalog", f"WITH {COLS} SELECT DISTINCT 'main' AS table_schema, table_name, tenant_slug, table_type, subject FROM cols")
def sem_1(spark, sf):
    return catalog.star_catalog(physical_tables(spark, sf))


@case(
    "sem_2_column_manifest",
    f"""WITH {COLS} SELECT tenant_slug, table_type, subject, table_name, '[' || string_agg('{{"column_name":"' || column_name || '","data_type":"' || data_type
    || '","ordinal_position":' || ordinal_position || '}}', ',' ORDER BY ordinal_position) || ']' AS semantic_manifest
    FROM cols GROUP BY 1, 2, 3, 4""",
)
def sem_2(spark, sf):
    return semantic(spark, sf)


@case(
    "sem_3_flatten_manifest",
    f"WITH {COLS} SELECT tenant_slug, table_type, subject, table_name, column_name, data_type, ordinal_position FROM cols",
)
def sem_3(spark, sf):
    return star_columns(spark, sf)


@case("sem_4_semantic_role", f"WITH {CLASSIFIED} SELECT subject, column_name, data_type, semantic_role, count(*) AS tenants FROM roles GROUP BY 1, 2, 3, 4")
def sem_4(spark, sf):
    columns = star_columns(spark, sf)
    role = catalog.semantic_role(F.col("column_name"), F.col("data_type"))
    return columns.groupBy("subject", "column_name", "data_type", role.alias("semantic_role")).agg(
        F.count(F.lit(1)).alias("tenants")
    )


@case("sem_5_bsl_type", f"WITH {CLASSIFIED} SELECT subject, column_name, bsl_type, count(*) AS tenants FROM roles GROUP BY 1, 2, 3")
def sem_5(spark, sf):
    kind = catalog.bsl_type(F.col("column_name"), F.col("data_type"))
    return star_columns(spark, sf).groupBy("subject", "column_name", kind.alias("bsl_type")).agg(
        F.count(F.lit(1)).alias("tenants")
    )


@case("sem_6_time_dimensions", f"WITH {CLASSIFIED} SELECT tenant_slug, subject, column_name, data_type FROM roles WHERE is_time_dimension")
def sem_6(spark, sf):
    is_time = catalog.is_time_dimension(F.col("column_name"), F.col("data_type"))
    return star_columns(spark, sf).filter(is_time).select("tenant_slug", "subject", "column_name", "data_type")


@case("sem_7_inferred_aggregation", f"WITH {CLASSIFIED} SELECT tenant_slug, subject, column_name, inferred_agg FROM classified WHERE semantic_role = 'measure'")
def sem_7(spark, sf):
    rows = classified_columns(spark, sf).filter("semantic_role = 'measure'")
    return rows.select("tenant_slug", "subject", "column_name", "inferred_agg")


@case("sem_8_column_catalog", f"WITH {CLASSIFIED} SELECT * EXCLUDE (c_mktsegment) FROM classified")
def sem_8(spark, sf):
    return classified_columns(spark, sf)


@case(
    "sem_9_calculated_measures",
    f"""WITH {COLS}, need(name, format, a, b) AS (VALUES ('ctr', 'percent', 'clicks', 'impressions'), ('cpc', 'currency', 'spend', 'clicks'),
    ('cpm', 'currency', 'spend', 'impressions'), ('aov', 'currency', 'total_price', 'order_id'),
    ('conversion_rate', 'percent', 'funnel_step_6_purchase', 'session_id')), {_HELD}
    SELECT tenant_slug, subject, name, format FROM held JOIN need ON list_contains(names, a) AND list_contains(names, b)""",
)
def sem_9(spark, sf):
    return catalog.infer_calc_measures(star_columns(spark, sf)).select("tenant_slug", "subject", "name", "format")


_JOINS = f"""{COLS},
shared AS (SELECT f.tenant_slug, f.subject, d.subject AS "to", f.column_name, d.ordinal_position,
    row_number() OVER (PARTITION BY f.table_name, d.table_name ORDER BY NOT ends_with(f.column_name, '_id'),
      CASE WHEN ends_with(f.column_name, '_id') THEN d.ordinal_position END, f.column_name) AS rn
  FROM cols f JOIN cols d ON f.tenant_slug = d.tenant_slug AND f.column_name = d.column_name
  WHERE f.table_type = 'fact' AND d.table_type = 'dimension' AND f.column_name NOT IN ('tenant_slug', 'source_platform')),
joins AS (SELECT tenant_slug, subject, "to", 'left' AS type, column_name AS left_on, column_name AS right_on FROM shared WHERE rn = 1)"""


@case("sem_15_inferred_joins", f"WITH {_JOINS} SELECT * FROM joins")
def sem_15(spark, sf):
    joins = catalog.infer_joins(star_columns(spark, sf))
    return joins.select("tenant_slug", "subject", "to", "type", "left_on", "right_on")


_DERIVED = """CASE WHEN replace(replace(column_name, '_timestamp', '_date'), '_ts', '_date') = column_name
    THEN column_name || '_date' ELSE replace(replace(column_name, '_timestamp', '_date'), '_ts', '_date') END"""
_COUNTS = """counts AS (SELECT i.tenant_slug, i.table_type, i.subject, i.table_name, 'total_' || replace(column_name, '_id', '') ||
    CASE WHEN ends_with(replace(column_name, '_id', ''), 's') THEN '' ELSE 's' END AS column_name, 'number' AS bsl_type, 'measure' AS role,
    false AS is_time_dimension, 'count_distinct' AS agg, column_name AS source_column, i.c_mktsegment FROM cols i
  WHERE table_type = 'fact' AND ends_with(column_name, '_id') AND data_type = 'VARCHAR')"""
_META = f"""{CLASSIFIED}, {_COUNTS},
meta AS (
  SELECT tenant_slug, table_type, subject, table_name, column_name, bsl_type, semantic_role AS role, is_time_dimension,
    inferred_agg AS agg, CAST(NULL AS VARCHAR) AS source_column, c_mktsegment FROM classified
  UNION ALL
  SELECT tenant_slug, table_type, subject, table_name, {_DERIVED}, 'date', 'dimension', true, NULL, column_name, c_mktsegment
  FROM classified WHERE bsl_type = 'timestamp_epoch'
  UNION ALL SELECT * FROM counts)"""
_LABEL = """CASE subject WHEN 'ad_performance' THEN 'Ad Performance' WHEN 'orders' THEN 'Orders' WHEN 'sessions' THEN 'Sessions'
    WHEN 'events' THEN 'Events' WHEN 'campaigns' THEN 'Campaigns' ELSE 'Users' END AS label,
    CASE table_type WHEN 'fact' THEN 'Fact: ' ELSE 'Dimension: ' END || subject AS description"""


@case(
    "sem_17_auto_count_measures",
    f"""WITH {COLS}, {_COUNTS}, {_HELD} SELECT c.tenant_slug, c.subject, column_name AS measure_name, source_column
    FROM counts c JOIN held USING (table_name) WHERE NOT list_contains(names, column_name)""",
)
def sem_17(spark, sf):
    counts = catalog.auto_count_measures(star_columns(spark, sf))
    return counts.select("tenant_slug", "subject", "measure_name", "source_column")


def metadata(spark, sf) -> DataFrame:
    return catalog.column_metadata(classified_columns(spark, sf))


@case("sem_18_column_metadata", f"WITH {_META} SELECT * EXCLUDE (c_mktsegment), {_LABEL} FROM meta")
def sem_18(spark, sf):
    return metadata(spark, sf).drop("position")


def overlay(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Tenants of one market segment override two session columns and the label."""
    chosen = src.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    name = F.concat(F.lit("fct_"), _tenant(), F.lit("__sessions"))
    none = F.lit(None).cast("string")
    rules = F.array(
        F.struct(F.lit("funnel_max_step").alias("c"), F.lit("measure").alias("k"), none.alias("t"), F.lit("max").alias("a")),
        F.struct(F.lit("session_start_ts").alias("c"), F.lit("dimension").alias("k"), F.lit("timestamp").alias("t"), none.alias("a")),
    )
    columns = chosen.select(_tenant().alias("tenant_slug"), name.alias("table_name"), F.explode(rules).alias("r")).select(
        "tenant_slug", "table_name", F.col("r.c").alias("column_name"), F.col("r.k").alias("kind"),
        F.col("r.t").alias("type"), F.col("r.a").alias("agg"),
    )
    tables = chosen.select(
        _tenant().alias("tenant_slug"), name.alias("table_name"), F.lit("Web Sessions").alias("label"), F.lit("").alias("description")
    )
    return columns, tables


@case(
    "sem_19_overlay_metadata",
    f"""WITH {_META}, o AS (SELECT *, c_mktsegment = 'BUILDING' AND subject = 'sessions' AS hit FROM meta)
    SELECT tenant_slug, table_type, subject, table_name, column_name, role, source_column,
    CASE WHEN hit AND column_name = 'session_start_ts' THEN 'timestamp' ELSE bsl_type END AS bsl_type, is_time_dimension,
    CASE WHEN hit AND column_name = 'funnel_max_step' THEN 'max' ELSE agg END AS agg,
    CASE WHEN hit THEN 'Web Sessions' ELSE label END AS label, description FROM (SELECT *, {_LABEL} FROM o)""",
)
def sem_19(spark, sf):
    columns, tables = overlay(spark, sf)
    return catalog.column_metadata(classified_columns(spark, sf), columns, tables).drop("position")


@case(
    "sem_19_overlay_joins_and_measures",
    f"""WITH {_JOINS}, b AS (SELECT 'c' || c_custkey AS tenant_slug FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT tenant_slug, subject, "to" AS name, left_on AS detail FROM joins
      WHERE NOT (subject = 'sessions' AND "to" = 'campaigns' AND tenant_slug IN (SELECT tenant_slug FROM b))
    UNION ALL SELECT tenant_slug, 'sessions', 'campaigns', 'traffic_campaign' FROM b
    UNION ALL SELECT tenant_slug, 'sessions', 'revenue_per_session', 'currency' FROM b""",
)
def sem_19_rest(spark, sf):
    chosen = overlay(spark, sf)[1].select("tenant_slug", "table_name")
    to_table = F.concat(F.lit("dim_"), "tenant_slug", F.lit("__campaigns"))
    extra_joins = chosen.select(
        "*", to_table.alias("to_table"), F.lit("left").alias("type"),
        F.lit("traffic_campaign").alias("left_on"), F.lit("campaign_name").alias("right_on"),
    )
    extra_calcs = chosen.select(
        "*", F.explode(F.array(F.lit("revenue_per_session"), F.lit("conversion_rate"))).alias("name")
    ).select(
        "*", F.col("name").alias("label"), F.lit("SUM(session_revenue) / COUNT(1)").alias("sql"), F.lit("currency").alias("format")
    )
    columns = star_columns(spark, sf)
    joins = catalog.merge_joins(catalog.infer_joins(columns), extra_joins)
    inferred = catalog.infer_calc_measures(columns)
    known = inferred.select("tenant_slug", "table_name", "name").hint("merge")
    calcs = catalog.merge_calc_measures(inferred, extra_calcs).join(known, ["tenant_slug", "table_name", "name"], "left_anti")
    return joins.select("tenant_slug", "subject", F.col("to").alias("name"), F.col("left_on").alias("detail")).unionByName(
        calcs.select("tenant_slug", "subject", "name", F.col("format").alias("detail"))
    )


_MODELS = f"""{_META}, {_JOINS.replace(COLS + ',', '')},
models AS (SELECT m.tenant_slug, m.subject, max(label) AS label, max(description) AS description,
    count(*) FILTER (WHERE role = 'dimension') AS dimension_count, count(*) FILTER (WHERE role = 'measure') AS measure_count
  FROM (SELECT *, {_LABEL} FROM meta) m GROUP BY 1, 2)"""


@case(
    "sem_21_list_models",
    f"""WITH {_MODELS} SELECT m.*, EXISTS (SELECT 1 FROM joins j WHERE j.tenant_slug = m.tenant_slug AND j.subject = m.subject) AS has_joins
    FROM models m""",
)
def sem_21(spark, sf):
    return catalog.list_models(metadata(spark, sf), catalog.infer_joins(star_columns(spark, sf)))


@case(
    "sem_22_model_detail",
    f"""WITH {_META}, {_JOINS.replace(COLS + ',', '')}
    SELECT m.tenant_slug, m.subject,
      string_agg(column_name || ':' || bsl_type, ',' ORDER BY column_name) FILTER (WHERE role = 'dimension') AS dimensions,
      string_agg(column_name || ':' || agg, ',' ORDER BY column_name) FILTER (WHERE role = 'measure') AS measures,
      (SELECT string_agg("to" || ':' || left_on, ',' ORDER BY "to") FROM joins j WHERE j.tenant_slug = m.tenant_slug AND j.subject = m.subject) AS joins,
      CASE m.subject WHEN 'ad_performance' THEN 3 WHEN 'orders' THEN 1 WHEN 'sessions' THEN 1 END AS calc_count
    FROM meta m GROUP BY 1, 2""",
)
def sem_22(spark, sf):
    columns = star_columns(spark, sf)
    details = catalog.model_details(
        metadata(spark, sf), catalog.infer_calc_measures(columns), catalog.infer_joins(columns)
    )

    def flat(column: str, left: str, right: str):
        items = F.transform(column, lambda x: F.concat_ws(":", x[left], x[right]))
        return F.nullif(F.array_join(F.array_sort(items), ","), F.lit("")).alias(column)

    return details.select(
        "tenant_slug", "subject", flat("dimensions", "name", "type"), flat("measures", "name", "agg"),
        flat("joins", "to", "left_on"), F.size("calculated_measures").alias("calc_count"),
    )


@case("sem_23_all_tenant_catalog", f"WITH {COLS} SELECT DISTINCT tenant_slug, subject, tenant_slug || '__' || subject AS model_name FROM cols")
def sem_23(spark, sf):
    return catalog.all_tenant_models(semantic(spark, sf))


_SEGMENT_STATUS = {"BUILDING": "active", "MACHINERY": "onboarding", "AUTOMOBILE": "pending"}


@case(
    "sem_24_readiness",
    f"""WITH {CLASSIFIED}, t AS (SELECT 'c' || c_custkey AS tenant_slug, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'active'
      WHEN 'MACHINERY' THEN 'onboarding' ELSE 'pending' END AS status, c_nationkey >= 10 AS has_tables, c_nationkey >= 18 AS has_columns FROM customer),
    n AS (SELECT tenant_slug, count(*) AS columns, min(table_name) AS first_table FROM classified GROUP BY 1)
    SELECT t.tenant_slug, has_columns AS is_ready,
      CASE WHEN has_columns THEN 'ready' WHEN has_tables THEN 'cataloging' WHEN status = 'onboarding' THEN 'modeling'
        WHEN status = 'active' THEN 'cataloging' ELSE 'starting' END AS status,
      CASE WHEN has_columns THEN first_table END AS last_load_id, CASE WHEN has_columns THEN columns ELSE 0 END AS column_count
    FROM t JOIN n ON t.tenant_slug = n.tenant_slug""",
)
def sem_24(spark, sf):
    status = F.when(F.col("c_mktsegment") == "BUILDING", "active").when(F.col("c_mktsegment") == "MACHINERY", "onboarding")
    customers = src.table(spark, sf, "customer").withColumn("tenant_slug", _tenant())
    manifest = customers.select("tenant_slug", status.otherwise("pending").alias("status"))
    stage = customers.select("tenant_slug", "c_nationkey").hint("shuffle_hash")
    tables = semantic(spark, sf).join(stage.filter("c_nationkey >= 10"), "tenant_slug", "left_semi")
    columns = classified_columns(spark, sf).join(stage.filter("c_nationkey >= 18"), "tenant_slug", "left_semi")
    return catalog.readiness(manifest, tables, columns)


@case(
    "sem_25_listings",
    f"""WITH {_META} SELECT tenant_slug, subject, column_name AS name, role = 'measure' AS is_measure, coalesce(is_time_dimension AND role = 'dimension', false) AS is_time_dimension FROM meta""",
)
def sem_25(spark, sf):
    fields = metadata(spark, sf)
    dims = catalog.dimension_listing(fields).withColumn("is_measure", F.lit(False))
    measures = catalog.measure_listing(fields).withColumns({"is_measure": F.lit(True), "is_time_dimension": F.lit(False)})
    return dims.unionByName(measures).drop("description")


@case(
    "sem_25_manifests_of_tenant",
    f"WITH {COLS} SELECT subject, table_name, count(*) AS columns FROM cols WHERE tenant_slug = 'c7' GROUP BY 1, 2",
)
def sem_25_manifests(spark, sf):
    rows = catalog.manifest_listing(semantic(spark, sf), "c7")
    return rows.select("subject", "table_name", F.json_array_length("semantic_manifest").cast("bigint").alias("columns"))


# --- the semantic layer over the star tables ------------------------------------------------


@lru_cache(maxsize=4)
def layer(spark: SparkSession, sf: str) -> SemanticLayer:
    frames = {
        "ad_performance": src.ad_performance(spark, sf),
        "orders": src.orders(spark, sf),
        "sessions": ga_sessions(spark, sf, DAY),
        "events": ga_star_events(spark, sf),
        "campaigns": src.campaigns(spark, sf),
        "users": users(ga_star_events(spark, sf), src.orders(spark, sf)),
    }
    return SemanticLayer.from_frames(spark, frames)


def ask(spark, sf, tenant: str, **request) -> DataFrame:
    request["filters"] = tuple(Filter(*f) for f in request.get("filters", ()))
    request["order_by"] = tuple(OrderBy(*o) for o in request.get("order_by", ()))
    return semantic_query(layer(spark, sf), tenant, Request(**{"limit": None, **request}))


ADS = f"WITH {sql.ADS_BASE}"
GA_DAY = f"WITH {ga_sessions_sql(DAY)}"
_CTR = "CASE WHEN sum(impressions) > 0 THEN CAST(sum(clicks) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE) ELSE 0 END"
_CPC = "CASE WHEN sum(clicks) > 0 THEN sum(spend) / CAST(sum(clicks) AS DOUBLE) ELSE 0 END"
_CPM = "CASE WHEN sum(impressions) > 0 THEN sum(spend) * 1000 / CAST(sum(impressions) AS DOUBLE) ELSE 0 END"


def _calc_case(number: int, name: str, formula: str, model: str, dims: str, base: str) -> None:
    @case(
        f"sem_{number}_calc_{name}",
        f"{base[0]} SELECT tenant_slug, {dims}, round({formula}, 6) AS {name} FROM {base[1]} GROUP BY tenant_slug, {dims}",
    )
    def run(spark, sf):
        bound = layer(spark, sf).model(model).with_dimensions(tenant_slug=F.col("tenant_slug"))
        result = bound.group_by("tenant_slug", *dims.split(", ")).aggregate(name)
        return result.withColumn(name, F.round(F.col(name).cast("double"), 6))


_calc_case(10, "ctr", _CTR, "ad_performance", "source_platform, campaign_id", (ADS, "ads"))
_calc_case(11, "cpc", _CPC, "ad_performance", "source_platform, campaign_id", (ADS, "ads"))
_calc_case(12, "cpm", _CPM, "ad_performance", "source_platform, campaign_id", (ADS, "ads"))
_calc_case(
    13, "aov", "CASE WHEN count(DISTINCT order_id) > 0 THEN sum(total_price) / count(DISTINCT order_id) ELSE 0 END",
    "orders", "financial_status", (f"WITH {sql.ORDERS}, o AS (SELECT * FROM star_orders)", "o"),
)
_calc_case(
    14, "conversion_rate",
    "CASE WHEN count(DISTINCT session_id) > 0 THEN CAST(sum(CASE WHEN funnel_step_6_purchase > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(DISTINCT session_id) ELSE 0 END",
    "sessions", "traffic_source, device_category", (GA_DAY, "sessions"),
)


@case(
    "sem_16_derived_dates",
    f"{GA_DAY} SELECT tenant_slug, CAST(make_timestamp(session_start_ts) AS DATE) AS session_start_date, count(*) AS sessions FROM sessions GROUP BY 1, 2",
)
def sem_16(spark, sf):
    model = layer(spark, sf).model("sessions").with_dimensions(tenant_slug=F.col("tenant_slug"))
    grouped = model.group_by("tenant_slug", "session_start_date")
    return grouped.aggregate(sessions=F.count(F.lit(1)))


@case(
    "sem_20_join_wiring",
    f"""{GA_DAY}, {sql.GA_EVENTS}, {sql.ORDERS}, {users_sql('ga_events', False)}
    SELECT s.tenant_slug, u.is_customer AS "users.is_customer", count(DISTINCT s.session_id) AS total_sessions, round(sum(session_revenue), 4) AS session_revenue
    FROM sessions s LEFT JOIN users u ON s.tenant_slug = u.tenant_slug AND s.user_pseudo_id = u.user_pseudo_id GROUP BY 1, 2""",
)
def sem_20(spark, sf):
    models = layer(spark, sf)
    sessions = models.model("sessions")
    joined = sessions.join_one(models.model("users"), sessions.joins["users"])
    joined = joined.with_dimensions(tenant_slug=F.col("tenant_slug"))
    result = joined.group_by("tenant_slug", "users.is_customer").aggregate("total_sessions", "session_revenue")
    return rounded(result, session_revenue=4)


# --- structured queries -----------------------------------------------------------------------


def _refused(build) -> None:
    try:
        build()
    except ValueError:
        return
    raise AssertionError("an invalid request was accepted")


@case(
    "qry_1_validated_query",
    f"{ADS} SELECT source_platform, CAST(sum(clicks) AS BIGINT) AS clicks FROM ads WHERE tenant_slug = 't0' GROUP BY 1",
)
def qry_1(spark, sf):
    good = {"model": "ad_performance", "dimensions": ("source_platform",), "measures": ("clicks",)}
    for bad in (
        {"model": "nothing"}, {"dimensions": ("nothing",)}, {"measures": ("nothing",)}, {"joins": ("users",)},
        {"calculated_measures": ("aov",)}, {"filters": (("nothing", "=", 1),)}, {"filters": (("clicks", "~", 1),)},
        {"order_by": (("nothing",),)},
    ):
        _refused(lambda bad=bad: ask(spark, sf, "t0", **{**good, **bad}))
    _refused(lambda: preview(layer(spark, sf), "t0", Request("ad_performance", limit=10_001)))
    return ask(spark, sf, "t0", **good)


@case("qry_2_tenant_isolation", f"{ADS} SELECT tenant_slug, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM ads GROUP BY 1")
def qry_2(spark, sf):
    parts = [
        ask(spark, sf, t, model="ad_performance", measures=("clicks", "impressions")).withColumn("tenant_slug", F.lit(t))
        for t in ("t0", "t1", "t2")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@case("qry_3_projection", f"{ADS} SELECT source_platform, report_date FROM ads WHERE tenant_slug = 't1'")
def qry_3(spark, sf):
    return ask(spark, sf, "t1", model="ad_performance", dimensions=("source_platform", "report_date"))


@case(
    "qry_4_grouped",
    f"{ADS} SELECT source_platform, report_date, round(sum(spend), 4) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks FROM ads WHERE tenant_slug = 't1' GROUP BY 1, 2",
)
def qry_4(spark, sf):
    result = ask(
        spark, sf, "t1", model="ad_performance", dimensions=("source_platform", "report_date"), measures=("spend", "clicks")
    )
    return rounded(result, spend=4)


@case(
    "qry_5_global",
    f"{GA_DAY} SELECT CAST(sum(events_in_session) AS BIGINT) AS events_in_session, round(sum(session_revenue), 4) AS session_revenue, count(DISTINCT session_id) AS total_sessions FROM sessions WHERE tenant_slug = 't2'",
)
def qry_5(spark, sf):
    result = ask(spark, sf, "t2", model="sessions", measures=("events_in_session", "session_revenue", "total_sessions"))
    return rounded(result, session_revenue=4)


@case(
    "qry_6_aggregates",
    f"""{GA_DAY} SELECT tenant_slug, traffic_medium, CAST(sum(events_in_session) AS BIGINT) AS s, round(avg(session_duration_seconds), 4) AS a, count(transaction_id) AS n,
    count(DISTINCT user_pseudo_id) AS d, max(funnel_max_step) AS hi, min(funnel_max_step) AS lo FROM sessions GROUP BY 1, 2""",
)
def qry_6(spark, sf):
    from tributary.plans.model import Measure

    made = {
        "s": Measure("s", "sum", "events_in_session"), "a": Measure("a", "avg", "session_duration_seconds"),
        "n": Measure("n", "count", "transaction_id"), "d": Measure("d", "count_distinct", "user_pseudo_id"),
        "hi": Measure("hi", "max", "funnel_max_step"), "lo": Measure("lo", "min", "funnel_max_step"),
    }
    model = layer(spark, sf).model("sessions").with_dimensions(tenant_slug=F.col("tenant_slug"))
    model = model.with_measures(**{k: m.over(m.source()) for k, m in made.items()})
    return rounded(model.group_by("tenant_slug", "traffic_medium").aggregate(*made), a=4)


@case(
    "qry_7_calculated",
    f"{ADS} SELECT campaign_id, round({_CTR}, 6) AS ctr, round({_CPC}, 6) AS cpc, round({_CPM}, 6) AS cpm FROM ads WHERE tenant_slug = 't0' GROUP BY 1",
)
def qry_7(spark, sf):
    result = ask(
        spark, sf, "t0", model="ad_performance", dimensions=("campaign_id",), calculated_measures=("ctr", "cpc", "cpm")
    )
    return rounded(result, ctr=6, cpc=6, cpm=6)


@case("qry_8_select_all", f"WITH {sql.CAMPAIGNS} SELECT * FROM campaigns WHERE tenant_slug = 't2'")
def qry_8(spark, sf):
    return ask(spark, sf, "t2", model="campaigns")


_JOINED = "FROM ads a LEFT JOIN campaigns c ON a.campaign_id = c.campaign_id AND a.tenant_slug = c.tenant_slug"


@case(
    "qry_9_join",
    f"""{ADS}, {sql.CAMPAIGNS} SELECT a.source_platform, c.campaign_status AS "campaigns.campaign_status", CAST(sum(clicks) AS BIGINT) AS clicks,
    round(sum(spend), 2) AS spend {_JOINED} WHERE a.tenant_slug = 't0' GROUP BY 1, 2""",
)
def qry_9(spark, sf):
    result = ask(
        spark, sf, "t0", model="ad_performance", dimensions=("source_platform", "campaigns.campaign_status"),
        measures=("clicks", "spend"), joins=("campaigns",),
    )
    return rounded(result, spend=2)


@case(
    "qry_9_join_users",
    f"""{GA_DAY}, {sql.GA_EVENTS}, {sql.ORDERS}, {users_sql('ga_events', False)}
    SELECT s.traffic_source, u.is_customer AS "users.is_customer", u.first_geo_country AS "users.first_geo_country", count(DISTINCT s.session_id) AS total_sessions
    FROM sessions s LEFT JOIN users u ON s.tenant_slug = u.tenant_slug AND s.user_pseudo_id = u.user_pseudo_id WHERE s.tenant_slug = 't1' GROUP BY 1, 2, 3""",
)
def qry_9_users(spark, sf):
    return ask(
        spark, sf, "t1", model="sessions", dimensions=("traffic_source", "users.is_customer", "users.first_geo_country"),
        measures=("total_sessions",), joins=("users",),
    )


def _filter_case(number: int, label: str, condition: str, *filters: tuple) -> None:
    @case(
        f"qry_{number}_filter_{label}",
        f"{ADS} SELECT campaign_id, CAST(sum(clicks) AS BIGINT) AS clicks, count(DISTINCT ad_id) AS total_ads FROM ads WHERE tenant_slug = 't0' AND {condition} GROUP BY 1",
    )
    def run(spark, sf):
        return ask(
            spark, sf, "t0", model="ad_performance", dimensions=("campaign_id",), measures=("clicks", "total_ads"), filters=filters
        )


_filter_case(10, "equal", "source_platform = 'google_ads'", ("source_platform", "=", "google_ads"))
_filter_case(10, "not_equal", "source_platform <> 'google_ads'", ("source_platform", "!=", "google_ads"))
_filter_case(10, "range", "clicks > 10 AND clicks <= 40 AND spend >= 1000 AND spend < 50000",
             ("clicks", ">", 10), ("clicks", "<=", 40), ("spend", ">=", 1000), ("spend", "<", 50000))
_filter_case(11, "in", "source_platform IN ('google_ads', 'facebook_ads') AND ad_group_id IN ('7')",
             ("source_platform", "IN", ["google_ads", "facebook_ads"]), ("ad_group_id", "in", "7"))
_filter_case(12, "like", "source_platform LIKE '%gram_ads'", ("source_platform", "LIKE", "%gram_ads"))
_filter_case(13, "between", "report_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
             ("report_date", "BETWEEN", ["1997-01-01", "1997-12-31"]))


@case(
    "qry_14_filter_nulls",
    f"{GA_DAY} SELECT device_category, count(DISTINCT session_id) AS total_sessions FROM sessions WHERE tenant_slug = 't0' AND traffic_source IS NOT NULL AND session_revenue IS NOT NULL GROUP BY 1",
)
def qry_14(spark, sf):
    return ask(
        spark, sf, "t0", model="sessions", dimensions=("device_category",), measures=("total_sessions",),
        filters=(("traffic_source", "IS NOT NULL"), ("session_revenue", "is not null")),
    )


@case(
    "qry_14_filter_is_null",
    f"WITH {sql.GA}, {sql.GA_EVENTS} SELECT event_name, count(DISTINCT session_id) AS total_sessions FROM ga_events WHERE tenant_slug = 't0' AND order_id IS NULL GROUP BY 1",
)
def qry_14_null(spark, sf):
    return ask(
        spark, sf, "t0", model="events", dimensions=("event_name",), measures=("total_sessions",), filters=(("order_id", "IS NULL"),)
    )


@case(
    "qry_15_order_by",
    f"{ADS} SELECT campaign_id, round(spend, 4) AS spend, clicks FROM (SELECT campaign_id, sum(spend) AS spend, CAST(sum(clicks) AS BIGINT) AS clicks FROM ads WHERE tenant_slug = 't2' GROUP BY 1) ORDER BY clicks DESC, campaign_id LIMIT 20",
)
def qry_15(spark, sf):
    result = ask(
        spark, sf, "t2", model="ad_performance", dimensions=("campaign_id",), measures=("spend", "clicks"),
        order_by=(("clicks", "desc"), ("campaign_id", "asc")), limit=20,
    )
    return rounded(result, spend=4)


@case(
    "qry_16_top_k_report",
    f"WITH {sql.ORDERS} SELECT customer_id, count(DISTINCT order_id) AS total_orders, round(sum(total_price), 2) AS total_price FROM star_orders WHERE tenant_slug = 't1' GROUP BY 1 ORDER BY total_price DESC NULLS LAST, customer_id LIMIT 100",
)
def qry_16(spark, sf):
    result = ask(
        spark, sf, "t1", model="orders", dimensions=("customer_id",), measures=("total_orders", "total_price"),
        order_by=(("total_price", "desc"), ("customer_id",)), limit=100,
    )
    return rounded(result, total_price=2)


@case(
    "qry_17_table_name_resolution",
    f"{ADS}, {sql.CAMPAIGNS} SELECT c.campaign_name AS \"campaigns.campaign_name\", CAST(sum(impressions) AS BIGINT) AS impressions {_JOINED} WHERE a.tenant_slug = 't1' GROUP BY 1",
)
def qry_17(spark, sf):
    return ask(
        spark, sf, "t1", model="fct_all__ad_performance", dimensions=("campaigns.campaign_name",), measures=("impressions",),
        joins=("dim_all__campaigns",),
    )


@case(
    "qry_18_config_from_catalogue",
    f"WITH {sql.GA}, {sql.GA_EVENTS} SELECT event_name, count(DISTINCT user_id) AS total_users, count(DISTINCT session_id) AS total_sessions, count(DISTINCT order_id) AS total_orders, round(sum(order_total), 4) AS order_total FROM ga_events WHERE tenant_slug = 't0' GROUP BY 1",
)
def qry_18(spark, sf):
    result = ask(
        spark, sf, "t0", model="events", dimensions=("event_name",),
        measures=("total_users", "total_sessions", "total_orders", "order_total"),
    )
    return rounded(result, order_total=4)


@case(
    "qry_19_result_description",
    f"""{ADS}, n AS (SELECT count(*) AS row_count FROM (SELECT DISTINCT source_platform, campaign_id FROM ads WHERE tenant_slug = 't0'))
    SELECT v.name, v.type, n.row_count FROM n, (VALUES ('source_platform', 'string'), ('campaign_id', 'string'), ('clicks', 'bigint')) v(name, type)""",
)
def qry_19(spark, sf):
    result = ask(spark, sf, "t0", model="ad_performance", dimensions=("source_platform", "campaign_id"), measures=("clicks",))
    described = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in result.dtypes])
    return result.agg(F.count(F.lit(1)).alias("row_count")).select(F.explode(described).alias("d"), "row_count").select(
        "d.name", "d.type", "row_count"
    )


@case(
    "qry_20_fluent",
    f"{GA_DAY} SELECT traffic_source, events_in_session > 3 AS long_session, count(DISTINCT session_id) AS total_sessions, round(sum(session_revenue) / count(*), 6) AS mean_revenue FROM sessions WHERE tenant_slug = 't0' AND traffic_source IS NOT NULL GROUP BY 1, 2",
)
def qry_20(spark, sf):
    model = (
        layer(spark, sf).model("sessions").for_tenant("t0").filter(F.col("traffic_source").isNotNull())
        .with_dimensions(long_session=F.col("events_in_session") > 3)
        .with_measures(mean_revenue=F.round(F.sum("session_revenue") / F.count(F.lit(1)), 6))
    )
    return model.group_by("traffic_source", "long_session").aggregate("total_sessions", "mean_revenue")


@case(
    "qry_21_default_breakdown",
    f"{ADS} SELECT source_platform, round(sum(spend), 4) AS spend FROM ads WHERE tenant_slug = 't1' GROUP BY 1 ORDER BY 1 LIMIT 50",
)
def qry_21(spark, sf):
    return rounded(layer(spark, sf).model("ad_performance").for_tenant("t1").default_breakdown(), spend=4)


def _routed_sql(source: str, key: str) -> str:
    scores = {
        m: " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) for m, words in KEYWORDS.items()
    }
    listed = ", ".join(f"{s} AS s_{m}" for m, s in scores.items())
    best = "greatest(" + ", ".join(f"s_{m}" for m in scores) + ")"
    choice = "CASE " + " ".join(f"WHEN s_{m} = {best} THEN '{m}'" for m in scores) + " END"
    return f"SELECT {key}, {choice} AS model, {best} AS score FROM (SELECT {key}, {listed} FROM (SELECT {key}, lower(text) AS t FROM {source}))"


@case("qry_22_route_conversations", _routed_sql("conversations", "conv_id, turn"))
def qry_22(spark, sf):
    return route_questions(src.table(spark, sf, "conversations"), "text").select("conv_id", "turn", "model", "score")


@case("qry_22_route_documents", _routed_sql("documents", "doc_id"))
def qry_22_documents(spark, sf):
    return route_questions(src.spread(spark, sf, "documents", "doc_id text", "doc_id"), "text").select("doc_id", "model", "score")


def alias_model(spark, sf) -> AliasModel:
    orders = src.table(spark, sf, "orders").withColumns(
        {
            "price_text": F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")),
            "date_text": F.date_format(
                "o_orderdate", "yyyy-MM-dd"
            ),
        }
    )
    us = F.date_format("o_orderdate", "MM/dd/yyyy")
    orders = orders.withColumn("date_text", F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(F.col("date_text")))
    return AliasModel(
        orders,
        {
            "Order Status": AliasDimension("o_orderstatus"),
            "Priority Class": AliasDimension("o_orderpriority", "substring(o_orderpriority, 1, 1)"),
            "Order Day": AliasDimension("date_text", temporal_text=True),
        },
        {
            "orders": AliasMeasure("_count", "count"),
            "revenue": AliasMeasure("price_text", "sum"),
            "largest": AliasMeasure("price_text", "max"),
            "customers": AliasMeasure(formula="COUNT(DISTINCT o_custkey)"),
            "priced": AliasMeasure("price_text", "count"),
        },
    )


@case("qry_23_alias_dimensions_only", 'SELECT DISTINCT o_orderstatus AS "Order Status", substring(o_orderpriority, 1, 1) AS "Priority Class" FROM orders')
def qry_23(spark, sf):
    return alias_model(spark, sf).query(["Order Status", "Priority Class"])


_PRICE = "CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END"


@case(
    "qry_24_safe_aggregates",
    f'SELECT substring(o_orderpriority, 1, 1) AS "Priority Class", count(*) AS orders, round(sum({_PRICE}), 2) AS revenue, max({_PRICE}) AS largest, count(*) AS priced FROM orders WHERE o_custkey > 10 GROUP BY 1',
)
def qry_24(spark, sf):
    result = alias_model(spark, sf).query(
        ["Priority Class"], ["orders", "revenue", "largest", "priced"], filters=["o_custkey > 10"]
    )
    return rounded(result, revenue=2)


@case("qry_25_formula_measures", 'SELECT o_orderstatus AS "Order Status", count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1')
def qry_25(spark, sf):
    return alias_model(spark, sf).query(["Order Status"], ["customers"])


@case("qry_26_temporal_text", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS \"Order Day\", count(*) AS orders FROM orders GROUP BY 1")
def qry_26(spark, sf):
    return date_safe(alias_model(spark, sf).query(["Order Day"], ["orders"]))


# --- dashboards --------------------------------------------------------------------------------

AS_OF = dt.date(2001, 11, 4)


@case(
    "dsh_1_period_over_period",
    f"""{ADS}, f AS (SELECT *, report_date >= DATE '2001-11-04' - INTERVAL 30 DAY AS cur FROM ads WHERE tenant_slug = 't0' AND report_date >= DATE '2001-11-04' - INTERVAL 60 DAY),
    u AS (SELECT 'spend' AS name, 'spend' AS label, 'currency' AS format, coalesce(sum(spend) FILTER (WHERE cur), 0) AS c, coalesce(sum(spend) FILTER (WHERE NOT cur), 0) AS p FROM f
    UNION ALL SELECT 'impressions', 'impressions', 'number', CAST(coalesce(sum(impressions) FILTER (WHERE cur), 0) AS DOUBLE), CAST(coalesce(sum(impressions) FILTER (WHERE NOT cur), 0) AS DOUBLE) FROM f
    UNION ALL SELECT 'clicks', 'clicks', 'number', CAST(coalesce(sum(clicks) FILTER (WHERE cur), 0) AS DOUBLE), CAST(coalesce(sum(clicks) FILTER (WHERE NOT cur), 0) AS DOUBLE) FROM f
    UNION ALL SELECT 'conversions', 'conversions', 'number', coalesce(sum(conversions) FILTER (WHERE cur), 0), coalesce(sum(conversions) FILTER (WHERE NOT cur), 0) FROM f)
    SELECT name, label, format, round(c, 4) AS current, round(p, 4) AS previous,
    round(CASE WHEN p = 0 THEN CASE WHEN c > 0 THEN 100.0 ELSE 0.0 END ELSE (c - p) / p * 100 END, 6) AS change_percent FROM u""",
)
def dsh_1(spark, sf):
    model = layer(spark, sf).model("ad_performance").for_tenant("t0")
    return rounded(dashboard.period_over_period(model, AS_OF), current=4, previous=4, change_percent=6)


@case(
    "dsh_1_period_over_period_epoch",
    f"""{GA_DAY}, f AS (SELECT *, session_start_ts >= epoch_us(TIMESTAMP '2024-01-15') AS cur FROM sessions WHERE tenant_slug = 't1' AND session_start_ts >= epoch_us(TIMESTAMP '2024-01-01')),
    u AS (SELECT 'session_duration_seconds' AS name, coalesce(avg(session_duration_seconds) FILTER (WHERE cur), 0) AS c, coalesce(avg(session_duration_seconds) FILTER (WHERE NOT cur), 0) AS p FROM f
    UNION ALL SELECT 'events_in_session', CAST(coalesce(sum(events_in_session) FILTER (WHERE cur), 0) AS DOUBLE), CAST(coalesce(sum(events_in_session) FILTER (WHERE NOT cur), 0) AS DOUBLE) FROM f)
    SELECT name, round(c, 4) AS current, round(p, 4) AS previous, round(CASE WHEN p = 0 THEN CASE WHEN c > 0 THEN 100.0 ELSE 0.0 END ELSE (c - p) / p * 100 END, 6) AS change_percent FROM u""",
)
def dsh_1_epoch(spark, sf):
    model = layer(spark, sf).model("sessions").for_tenant("t1")
    result = dashboard.period_over_period(model, dt.date(2024, 1, 29), days=14, top=2)
    return rounded(result, current=4, previous=4, change_percent=6).select("name", "current", "previous", "change_percent")


_TWO_WEEKS = """f AS (SELECT *, moment >= TIMESTAMP '2024-01-15' AS cur FROM timed WHERE tenant_slug = 't1' AND moment >= TIMESTAMP '2024-01-01'),
    u AS (SELECT 'session_duration_seconds' AS name, coalesce(avg(session_duration_seconds) FILTER (WHERE cur), 0) AS c, coalesce(avg(session_duration_seconds) FILTER (WHERE NOT cur), 0) AS p FROM f
    UNION ALL SELECT 'events_in_session', CAST(coalesce(sum(events_in_session) FILTER (WHERE cur), 0) AS DOUBLE), CAST(coalesce(sum(events_in_session) FILTER (WHERE NOT cur), 0) AS DOUBLE) FROM f)
    SELECT name, round(c, 4) AS current, round(p, 4) AS previous, round(CASE WHEN p = 0 THEN CASE WHEN c > 0 THEN 100.0 ELSE 0.0 END ELSE (c - p) / p * 100 END, 6) AS change_percent FROM u"""
_TIMED = "SELECT tenant_slug, session_duration_seconds, events_in_session, {} AS moment FROM {}"
_MILLIS = "make_timestamp(session_start_ts * 1000)"
_AMPLITUDE = f"{sql.AMPLITUDE}, {_amp_sessions(PURCHASE)}"


def _two_weeks(spark, sessions: DataFrame) -> DataFrame:
    model = SemanticLayer.from_frames(spark, {"sessions": sessions}).model("sessions").for_tenant("t1")
    result = dashboard.period_over_period(model, dt.date(2024, 1, 29), days=14, top=2)
    return rounded(result, current=4, previous=4, change_percent=6).select("name", "current", "previous", "change_percent")


@case("dsh_1_period_over_period_mixpanel", f"WITH {_mix_sql(DAY)}, timed AS ({_TIMED.format(_MILLIS, 'sessions')}), {_TWO_WEEKS}")
def dsh_1_mixpanel(spark, sf):
    return _two_weeks(spark, analytics.mixpanel_sessions(src.mixpanel_events(spark, sf), ["purchase"], gap_seconds=DAY))


@case("dsh_1_period_over_period_amplitude", f"WITH {_AMPLITUDE}, timed AS ({_TIMED.format(_MILLIS, 'amp_sessions')}), {_TWO_WEEKS}")
def dsh_1_amplitude(spark, sf):
    return _two_weeks(spark, analytics.amplitude_sessions(src.amplitude_events(spark, sf), ["purchase"]))


@case(
    "dsh_1_period_over_period_mixed",
    f"""{GA_DAY}, {_AMPLITUDE.replace(sql.EVENTS_BASE + ',', '')}, timed AS ({_TIMED.format('make_timestamp(session_start_ts)', 'sessions')}
    UNION ALL {_TIMED.format(_MILLIS, 'amp_sessions')}), {_TWO_WEEKS}""",
)
def dsh_1_mixed(spark, sf):
    """One table with microsecond and millisecond rows."""
    amplitude = analytics.amplitude_sessions(src.amplitude_events(spark, sf), ["purchase"])
    return _two_weeks(spark, ga_sessions(spark, sf, DAY).unionByName(amplitude))


@case(
    "sem_20_many_join",
    f"""{GA_DAY}, {sql.GA_EVENTS}, e AS (SELECT DISTINCT tenant_slug, user_pseudo_id, device_category FROM ga_events)
    SELECT e.device_category AS "events.device_category", CAST(sum(events_in_session) AS BIGINT) AS events_in_session, count(DISTINCT session_id) AS total_sessions
    FROM sessions s LEFT JOIN e ON s.tenant_slug = e.tenant_slug AND s.user_pseudo_id = e.user_pseudo_id WHERE s.tenant_slug = 't1' GROUP BY 1""",
)
def sem_20_many(spark, sf):
    """A fact joined to a fact by an overlay: every session counts once for each device of its user."""
    overlay = [("all", "fct_all__sessions", "fct_all__events", "left", "user_pseudo_id", "user_pseudo_id")]
    joins = local_frame(
        spark, overlay, "tenant_slug string, table_name string, to_table string, type string, left_on string, right_on string"
    )
    frames = {"sessions": ga_sessions(spark, sf, DAY), "events": ga_star_events(spark, sf)}
    models = SemanticLayer.from_frames(spark, frames, overlay_joins=joins)
    return semantic_query(models, "t1", Request(
        "sessions", dimensions=("events.device_category",), measures=("events_in_session", "total_sessions"), joins=("events",)
    ))


@case(
    "sem_19_overlays_per_tenant",
    f"""{ADS} SELECT tenant_slug, source_platform, CAST(sum(clicks) AS BIGINT) AS clicks,
    CASE tenant_slug WHEN 't0' THEN CAST(2 * sum(clicks) AS DOUBLE) WHEN 't1' THEN CAST(10 * sum(impressions) AS DOUBLE) END AS own FROM ads WHERE tenant_slug IN ('t0', 't1') GROUP BY 1, 2""",
)
def sem_19_per_tenant(spark, sf):
    """Two tenants whose calculated measure of one name means different things, from one catalogue job."""
    calcs = [
        ("t0", "fct_t0__ad_performance", "own", "Own", "2D * sum(clicks)", "number"),
        ("t1", "fct_t1__ad_performance", "own", "Own", "10D * sum(impressions)", "number"),
    ]
    layers = SemanticLayer.for_tenants(
        spark, {"ad_performance": src.ad_performance(spark, sf)}, ["t0", "t1"],
        overlay_calcs=local_frame(spark, calcs, catalog.OVERLAY_CALCS),
    )
    request = Request("ad_performance", dimensions=("source_platform",), measures=("clicks",), calculated_measures=("own",))
    parts = [semantic_query(each, tenant, request).withColumn("tenant_slug", F.lit(tenant)) for tenant, each in layers.items()]
    return parts[0].unionByName(parts[1])


@case(
    "qry_filtered_derived_date",
    f"""{GA_DAY} SELECT traffic_source, count(DISTINCT session_id) AS total_sessions FROM sessions
    WHERE tenant_slug = 't1' AND CAST(make_timestamp(session_start_ts) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1""",
)
def qry_filtered_derived_date(spark, sf):
    return ask(
        spark, sf, "t1", model="sessions", dimensions=("traffic_source",), measures=("total_sessions",),
        filters=(("session_start_date", "BETWEEN", (dt.date(2024, 1, 5), dt.date(2024, 1, 12))),),
    )


@case(
    "dsh_2_value_formats",
    f"""WITH {CLASSIFIED} SELECT column_name, CASE WHEN regexp_matches(lower(column_name), 'revenue|spend|price|cost') THEN 'currency'
    WHEN regexp_matches(lower(column_name), 'rate|percent') THEN 'percentage' ELSE 'number' END AS format, count(*) AS tenants
    FROM classified WHERE semantic_role = 'measure' GROUP BY 1, 2""",
)
def dsh_2(spark, sf):
    measures = classified_columns(spark, sf).filter("semantic_role = 'measure'")
    return measures.groupBy("column_name", dashboard.value_format(F.col("column_name")).alias("format")).agg(
        F.count(F.lit(1)).alias("tenants")
    )


@case(
    "dsh_3_pivot",
    f"""{ADS} SELECT campaign_id, CAST(sum(clicks) FILTER (WHERE source_platform = 'facebook_ads') AS BIGINT) AS facebook_ads,
    CAST(sum(clicks) FILTER (WHERE source_platform = 'google_ads') AS BIGINT) AS google_ads,
    CAST(sum(clicks) FILTER (WHERE source_platform = 'instagram_ads') AS BIGINT) AS instagram_ads FROM ads WHERE tenant_slug = 't0' GROUP BY 1""",
)
def dsh_3(spark, sf):
    rows = ask(spark, sf, "t0", model="ad_performance", dimensions=("campaign_id", "source_platform"), measures=("clicks",))
    return dashboard.pivot(rows, "campaign_id", "source_platform", "clicks")


@case("dsh_5_date_safe_rows", f"{ADS} SELECT strftime(report_date, '%Y-%m-%d') AS report_date, CAST(sum(clicks) AS BIGINT) AS clicks FROM ads WHERE tenant_slug = 't0' GROUP BY 1")
def dsh_5(spark, sf):
    return date_safe(ask(spark, sf, "t0", model="ad_performance", dimensions=("report_date",), measures=("clicks",)))


# --- profiling ------------------------------------------------------------------------------------


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items(), 1):
        shown = f"strftime({{}}({c}), '%Y-%m-%d %H:%M:%S')" if kind == "TIMESTAMP" else f"CAST({{}}({c}) AS VARCHAR)"
        numeric = kind in ("BIGINT", "INTEGER", "DOUBLE")
        parts.append(
            f"""SELECT {i} AS ordinal_position, '{c}' AS column_name, '{kind}' AS column_type, {shown.format('min')} AS min,
            {shown.format('max')} AS max, {f'round(avg(CAST({c} AS DOUBLE)), 4)' if numeric else 'CAST(NULL AS DOUBLE)'} AS avg,
            count(DISTINCT {c}) AS approx_unique, count(*) AS row_count,
            round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS null_percentage FROM {table}"""
        )
    return " UNION ALL ".join(parts)


@case(
    "prf_1_summarize",
    _profile_sql("orders", {
        "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE",
        "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR",
    }),
)
def prf_1(spark, sf):
    stats = profile.summarize(src.table(spark, sf, "orders"), exact_distinct=True)
    kept = stats.drop("is_time_text", "is_numeric_text", "is_date_text")
    return rounded(kept, avg=4, null_percentage=6)


@case("prf_1_summarize_sketches", _profile_sql("orders", {"o_orderstatus": "VARCHAR", "o_orderpriority": "VARCHAR"}))
def prf_1_sketches(spark, sf):
    """The default path, on columns with so few values that the sketches are exact."""
    stats = profile.summarize(src.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    kept = stats.drop("is_time_text", "is_numeric_text", "is_date_text")
    return rounded(kept, avg=4, null_percentage=6)


_TOP = """SELECT column_name, value, count FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rn FROM ({}))
    WHERE rn <= 10"""


def _counted(table: str, ceiling: int, *columns: str) -> str:
    """Value counts of the columns that have at most ``ceiling`` distinct values."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table}"
        f" WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM {table}) <= {ceiling} GROUP BY {c}"
        for c in columns
    )


_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
)
_FEW = "CASE WHEN (SELECT count(DISTINCT {0}) FROM lineitem) > 14 THEN 'numerical' ELSE 'categorical' END"


@case("prf_2_top_values", _TOP.format(_counted("lineitem", 20, *_LINE_COLUMNS)))
def prf_2(spark, sf):
    return profile.top_values(src.table(spark, sf, "lineitem"))


def text_table(spark, sf) -> DataFrame:
    """Text columns that hold numbers, dates in one layout, mixed layouts, times and words."""
    day = F.col("o_orderdate")
    return src.table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.date_format(day, "yyyy-MM-dd").alias("iso_text"),
        F.date_format(day, "MM/dd/yyyy").alias("us_text"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy/MM/dd")).alias("mixed_text"),
        F.format_string("%d:%02d", (F.col("o_orderkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int")).alias("time_text"),
        F.col("o_orderpriority").alias("word_text"),
    )


def _check_case(number: int, label: str, flag: str, column: str) -> None:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, {'true' if c in flag.split() else 'false'} AS {column} FROM orders"
        for c in ("price_text", "iso_text", "us_text", "mixed_text", "time_text", "word_text")
    )

    @case(f"prf_{number}_{label}", rows)
    def run(spark, sf):
        return profile.summarize(text_table(spark, sf)).select("column_name", "row_count", column)


_check_case(3, "numeric_text", "price_text", "is_numeric_text")
_check_case(4, "date_text", "iso_text us_text", "is_date_text")
_check_case(5, "time_text", "time_text", "is_time_text")


@case(
    "prf_6_categories",
    f"""SELECT * FROM (VALUES ('l_orderkey', {_FEW.format('l_orderkey')}, 'number'), ('l_partkey', {_FEW.format('l_partkey')}, 'number'),
    ('l_suppkey', {_FEW.format('l_suppkey')}, 'number'), ('l_linenumber', {_FEW.format('l_linenumber')}, 'number'), ('l_quantity', 'continuous', 'number'), ('l_extendedprice', 'continuous', 'number'),
    ('l_discount', 'continuous', 'number'), ('l_tax', 'continuous', 'number'), ('l_returnflag', 'categorical', 'string'),
    ('l_linestatus', 'categorical', 'string'), ('l_shipdate', 'temporal', 'timestamp')) v(column_name, category, ingest_type),
    (SELECT count(*) AS row_count FROM lineitem)""",
)
def prf_6(spark, sf):
    stats = profile.categorize(profile.summarize(src.table(spark, sf, "lineitem")))
    return stats.select("column_name", "category", "ingest_type", "row_count")


@case(
    "prf_7_members",
    """SELECT column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn FROM ("""
    + _counted("lineitem", 14, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    + " UNION ALL "
    + _counted("lineitem", 49, "l_returnflag", "l_linestatus")
    + ")) WHERE rn <= 10",
)
def prf_7(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    return profile.members(lines, profile.summarize(lines))


_EVENT_CATALOG = """SELECT v.*, n.row_count FROM (SELECT count(*) AS row_count FROM events) n, (VALUES
    ('dimension', 'Event Id', 'event_id', NULL, NULL), ('dimension', 'Ts', 'ts', NULL, NULL), ('dimension', 'User Id', 'user_id', NULL, NULL),
    ('dimension', 'Event Type', 'event_type', NULL, NULL), ('dimension', 'Props', 'props', NULL, NULL),
    ('measure', 'unique_event_id', 'event_id', 'formula', NULL), ('measure', 'unique_user_id', 'user_id', 'formula', NULL),
    ('measure', 'total_value', 'value', 'aggregation', 'sum'), ('measure', 'avg_value', 'value', 'aggregation', 'avg'),
    ('measure', 'min_value', 'value', 'aggregation', 'min'), ('measure', 'max_value', 'value', 'aggregation', 'max'),
    ('measure', 'count_value', 'value', 'aggregation', 'count'), ('measure', 'unique_value_vals', 'value', 'formula', NULL))
    v(kind, alias, source_column, type, aggregation)"""


def profiled_catalog(spark, sf) -> DataFrame:
    stats = profile.categorize(profile.summarize(src.table(spark, sf, "events")))
    rows = profile.data_catalog(stats)
    return rows.join(stats.select(F.col("column_name").alias("source_column"), "row_count"), "source_column")


@case("prf_8_default_fields", _EVENT_CATALOG)
def prf_8(spark, sf):
    return profiled_catalog(spark, sf).select("kind", "alias", "source_column", "type", "aggregation", "row_count")


@case(
    "sem_26_data_catalog",
    f"""SELECT alias, source_column, kind, has_transformation, row_count FROM (SELECT *, false AS has_transformation FROM ({_EVENT_CATALOG}))""",
)
def sem_26(spark, sf):
    return profiled_catalog(spark, sf).select("alias", "source_column", "kind", "has_transformation", "row_count")
