"""Column contracts: the hub, the six star tables and the run artifacts."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def struct(columns: str) -> T.StructType:
    """A schema from its DDL text, without a session to parse it."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


HUB = struct(
    "tenant_slug string, tenant_skey string, source_platform string, source_schema_hash string, "
    "source_schema string, raw_data_payload string, loaded_at timestamp"
)
#: Stored next to the seven contract columns so that a push never re-reads payloads.
HUB_DIGEST = "payload_md5"

STAR = {
    "fct_ad_performance": struct(
        "tenant_slug string, source_platform string, report_date date, campaign_id string, "
        "ad_group_id string, ad_id string, spend double, impressions bigint, clicks bigint, "
        "conversions double"
    ),
    "fct_orders": struct(
        "tenant_slug string, source_platform string, order_id string, order_date timestamp, "
        "total_price double, currency string, financial_status string, customer_email string, "
        "customer_id string, line_items_json string"
    ),
    "fct_sessions": struct(
        "tenant_slug string, source_platform string, session_id string, user_pseudo_id string, "
        "user_id string, session_start_ts bigint, session_end_ts bigint, "
        "session_duration_seconds double, events_in_session bigint, traffic_source string, "
        "traffic_medium string, traffic_campaign string, geo_country string, device_category string, "
        "funnel_max_step bigint, funnel_step_1_session_start bigint, funnel_step_2_view_item bigint, "
        "funnel_step_3_add_to_cart bigint, funnel_step_4_begin_checkout bigint, "
        "funnel_step_5_add_payment_info bigint, funnel_step_6_purchase bigint, "
        "funnel_conversion_count bigint, is_conversion_session boolean, session_revenue double, "
        "transaction_id string"
    ),
    "fct_events": struct(
        "tenant_slug string, source_platform string, event_name string, event_timestamp bigint, "
        "user_pseudo_id string, user_id string, session_id string, order_id string, order_total double, "
        "traffic_source string, traffic_medium string, traffic_campaign string, geo_country string, "
        "device_category string"
    ),
    "dim_campaigns": struct(
        "tenant_slug string, source_platform string, campaign_id string, campaign_name string, "
        "campaign_status string"
    ),
    "dim_users": struct(
        "tenant_slug string, source_platform string, user_pseudo_id string, user_id string, "
        "customer_email string, customer_id string, is_customer boolean, first_seen_at bigint, "
        "last_seen_at bigint, total_events bigint, total_sessions bigint, first_geo_country string, "
        "first_device_category string"
    ),
}

SCHEMA_HISTORY = struct(
    "tenant_slug string, platform_name string, source_table_name string, source_schema_hash string, "
    "source_schema string, source_schema_skey string, boring_semantic_manifest string, "
    "first_seen_at timestamp, updated_at timestamp"
)
BLUEPRINTS = struct(
    "source_name string, source_table_name string, source_schema_hash string, "
    "master_model_id string, version string, registered_at timestamp"
)
RUN_RESULTS = struct(
    "invocation_id string, node_id string, node_name string, resource_type string, status string, "
    "message string, rows_affected bigint, execution_time_seconds double, run_started_at timestamp, "
    "run_completed_at timestamp, extracted_at timestamp"
)
MODEL_ARTIFACTS = struct(
    "invocation_id string, node_id string, model_name string, description string, "
    "materialization string, schema_name string, tags string, meta string, config string, "
    "depends_on_nodes string, extracted_at timestamp"
)
TEST_ARTIFACTS = struct(
    "invocation_id string, node_id string, test_name string, test_type string, description string, "
    "tags string, test_metadata string, target_model_ids string, extracted_at timestamp"
)
COLUMNS = struct(
    "tenant_slug string, table_type string, subject string, table_name string, column_name string, "
    "data_type string, ordinal_position int"
)

#: Catalogue type names (fixed values) for Spark types.
CATALOGUE_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}

#: Landing type names (fixed values) used in schema fingerprints.
LANDING_TYPES = {
    "string": "text",
    "bigint": "bigint",
    "int": "bigint",
    "smallint": "bigint",
    "tinyint": "bigint",
    "double": "double",
    "float": "double",
    "boolean": "bool",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
    "binary": "binary",
}


def catalogue_type(column: str, spark_type: str) -> str:
    if column.endswith("_json"):
        return "JSON"
    if spark_type.startswith("decimal"):
        return "DECIMAL"
    return CATALOGUE_TYPES.get(spark_type, "JSON")


def landing_type(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return "decimal"
    return LANDING_TYPES.get(spark_type, "json")
