"""The supplied tables, mapped to connector-shaped and canonical inputs (Spark side).

``sqltext`` holds the same mappings as SQL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.operators.hub import pack_payload
from tributary.operators.unpack import SPECS, unpack

EPOCH = "timestamp'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@lru_cache(maxsize=64)
def _scan_tasks(spark: SparkSession, sf: str, name: str) -> int:
    return table(spark, sf, name).rdd.getNumPartitions()


def spread(spark: SparkSession, sf: str, name: str, columns: str, key: str) -> DataFrame:
    """Columns of a table; a file with fewer splits than cores is spread over all cores.

    The supplied files are a few megabytes in one row group.  Tables with enough splits
    are read as they are, without a shuffle.
    """
    rows = table(spark, sf, name).select(*columns.split())
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if _scan_tasks(spark, sf, name) < cores else rows


def _pick(index: Column, *values: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _tenant(key: str) -> Column:
    return F.concat(F.lit("t"), (F.col(key) % 3).cast("string"))


EVENT_NAMES = {
    "signup": "session_start",
    "view": "view_item",
    "click": "add_to_cart",
    "purchase": "purchase",
    "error": "exception",
}
_TOUCH = "traffic_source traffic_medium traffic_campaign geo_country device_category".split()


def _pick_sql(index: str, *values: str) -> str:
    return f"get(array({', '.join(repr(v) for v in values)}), CAST({index} AS INT))"


def events_base(spark: SparkSession, sf: str) -> DataFrame:
    """Events with decoded properties, before any connector's shape."""
    names = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in EVENT_NAMES.items())
    events = spread(spark, sf, "events", "event_id ts user_id event_type value props", "event_id")
    decoded = events.selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS INT) AS k", "CAST(ts AS TIMESTAMP) AS moment"
    )
    return decoded.selectExpr(
        "concat('t', user_id % 3) AS tenant_slug",
        f"CASE event_type {names} END AS event_name",
        "moment",
        "user_id",
        "event_id",
        "k",
        f"CASE WHEN k % 10 <> 0 THEN {_pick_sql('k % 4', 'google', 'direct', 'email', 'referral')} END AS traffic_source",
        "CASE WHEN k % 2 = 0 THEN 'cpc' ELSE 'organic' END AS traffic_medium",
        "concat('Supplier#', lpad(CAST(k % 100 AS STRING), 9, '0')) AS traffic_campaign",
        f"{_pick_sql('k % 3', 'US', 'GB', 'DE')} AS geo_country",
        f"{_pick_sql('k % 2', 'mobile', 'desktop')} AS device_category",
        "CASE WHEN event_type = 'purchase' AND event_id % 7 = 0"
        " THEN CAST(event_id * 3 + user_id % 3 AS STRING) END AS order_id",
        "CASE WHEN event_type = 'purchase' THEN value END AS revenue",
    )


def ga_events(spark: SparkSession, sf: str) -> DataFrame:
    """Unpacked google_analytics rows (microsecond timestamps)."""
    return events_base(spark, sf).selectExpr(
        "tenant_slug",
        "'google_analytics' AS source_platform",
        "event_name",
        "date_format(moment, 'yyyyMMdd') AS event_date",
        "unix_micros(moment) AS event_timestamp",
        "concat('u_', user_id) AS user_pseudo_id",
        "CAST(user_id AS STRING) AS user_id",
        "geo_country",
        "'Springfield' AS geo_city",
        "traffic_source",
        "traffic_medium",
        "traffic_campaign",
        "device_category",
        "concat(user_id, '_', date_format(moment, 'yyyy-MM-dd')) AS ga_session_id",
        "coalesce(order_id, 'N/A') AS transaction_id",
        "coalesce(revenue, 0D) AS purchase_revenue",
        "'USD' AS ecommerce_currency",
    )


def mixpanel_events(spark: SparkSession, sf: str) -> DataFrame:
    """Unpacked mixpanel rows (seconds in the source, milliseconds here)."""
    return events_base(spark, sf).selectExpr(
        "tenant_slug",
        "'mixpanel' AS source_platform",
        "event_name",
        "unix_seconds(moment) * 1000 AS event_timestamp",
        "concat('u_', user_id) AS user_pseudo_id",
        "concat('u_', user_id) AS user_id",
        *_TOUCH,
        "order_id AS prop_order_id",
        "revenue AS prop_revenue",
    )


def amplitude_events(spark: SparkSession, sf: str) -> DataFrame:
    """Unpacked amplitude rows: native session ids, missing for every tenth property."""
    return events_base(spark, sf).selectExpr(
        "tenant_slug",
        "'amplitude' AS source_platform",
        "event_name",
        "unix_seconds(moment) * 1000 AS event_timestamp",
        "concat('u_', user_id) AS user_pseudo_id",
        "concat('u_', user_id) AS user_id",
        "CASE WHEN k % 10 <> 0 THEN concat(user_id, '_', date_format(moment, 'yyyy-MM-dd')) END AS session_id",
        *_TOUCH,
        "order_id",
        "revenue AS order_total",
    )


def raw_ga(spark, sf) -> DataFrame:
    return ga_events(spark, sf).withColumnsRenamed(
        {
            "traffic_source": "traffic_source_source",
            "traffic_medium": "traffic_source_medium",
            "traffic_campaign": "traffic_source_campaign",
            "transaction_id": "ecommerce_transaction_id",
            "purchase_revenue": "ecommerce_value",
        }
    )


def raw_mixpanel(spark, sf) -> DataFrame:
    rows = mixpanel_events(spark, sf)
    return rows.select(
        "tenant_slug",
        F.col("event_name").alias("event"),
        F.col("user_pseudo_id").alias("prop_distinct_id"),
        F.expr("event_timestamp div 1000").alias("prop_time"),
        F.lit("Springfield").alias("prop_city"),
        F.col("geo_country").alias("prop_country_code"),
        F.col("device_category").alias("prop_device_type"),
        F.col("traffic_source").alias("prop_utm_source"),
        F.col("traffic_medium").alias("prop_utm_medium"),
        F.col("traffic_campaign").alias("prop_utm_campaign"),
        "prop_order_id",
        "prop_revenue",
    )


def raw_amplitude(spark, sf) -> DataFrame:
    rows = amplitude_events(spark, sf)
    return rows.select(
        "tenant_slug",
        F.col("event_name").alias("event_type"),
        F.col("user_id"),
        F.date_format(F.timestamp_millis("event_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        "session_id",
        F.lit("Springfield").alias("city"),
        F.col("geo_country").alias("country"),
        F.col("device_category").alias("device_type"),
        F.col("traffic_source").alias("utm_source"),
        F.col("traffic_medium").alias("utm_medium"),
        F.col("traffic_campaign").alias("utm_campaign"),
        "order_id",
        F.col("order_total").alias("revenue"),
    )


_ADS_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_returnflag l_shipdate"
)


def ads_base(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """``heavy`` is for cases that pack and parse every row."""
    lines = spread(spark, sf, "lineitem", _ADS_COLUMNS, "l_orderkey") if heavy else table(spark, sf, "lineitem")
    return lines.selectExpr(
        "concat('t', l_orderkey % 3) AS tenant_slug",
        "l_returnflag",
        "date_format(l_shipdate, 'yyyy-MM-dd') AS day",
        "CAST(l_suppkey AS STRING) AS campaign_id",
        "CAST(l_partkey % 50 AS STRING) AS ad_group_id",
        "CAST(l_partkey AS STRING) AS ad_id",
        "l_extendedprice * (1 - l_discount) AS spend",
        "CAST(round(l_quantity) AS BIGINT) AS clicks",
        "CAST(round(l_quantity) * 100 AS BIGINT) AS impressions",
        "CAST(l_linenumber AS DOUBLE) AS conversions",
        "CAST(round(l_extendedprice * (1 - l_discount) * 1000000) AS BIGINT) AS cost_micros",
    )


PLATFORM_OF_FLAG = {"A": "facebook_ads", "N": "google_ads", "R": "instagram_ads"}

# Raw column names of each ad platform's performance object.
RAW_AD_COLUMNS = {
    "facebook_ads": "ad_id campaign_id ad_group_id:adset_id day:date_start spend impressions clicks conversions",
    "instagram_ads": "ad_id campaign_id ad_group_id:adset_id day:date_start spend impressions clicks conversions",
    "google_ads": "ad_id ad_group_id campaign_id day:date_start cost_micros impressions clicks conversions",
    "bing_ads": "day:time_period spend impressions clicks",
    "linkedin_ads": "campaign_id day:date_range_start impressions clicks spend:cost_in_local_currency conversions",
    "amazon_ads": "ad_id ad_group_id campaign_id day:date spend impressions clicks conversions",
    "tiktok_ads": "ad_id ad_group_id:adgroup_id campaign_id day:stat_time_day spend impressions clicks conversions",
}


def raw_ads(spark, sf, platform: str, rows: DataFrame | None = None) -> DataFrame:
    rows = ads_base(spark, sf, heavy=True) if rows is None else rows
    pairs = [c.split(":") for c in RAW_AD_COLUMNS[platform].split()]
    return rows.select("tenant_slug", *[F.col(p[0]).alias(p[-1]) for p in pairs])


def unpacked_ads(spark, sf, platform: str, rows: DataFrame | None = None) -> DataFrame:
    """Performance rows of one platform, through the hub's JSON and back."""
    from tributary.operators.ads import PERFORMANCE_OBJECT

    return through_hub(raw_ads(spark, sf, platform, rows), platform, PERFORMANCE_OBJECT[platform])


def flagged_ads(spark, sf, platform: str) -> DataFrame:
    """Unpacked rows of the platform a return flag stands for."""
    flag = {v: k for k, v in PLATFORM_OF_FLAG.items()}[platform]
    return unpacked_ads(spark, sf, platform, ads_base(spark, sf, heavy=True).filter(F.col("l_returnflag") == flag))


def ad_performance(spark, sf) -> DataFrame:
    """Canonical fct_ad_performance of the three flagged platforms, straight from lineitem."""
    names = " ".join(f"WHEN '{flag}' THEN '{name}'" for flag, name in PLATFORM_OF_FLAG.items())
    return ads_base(spark, sf).selectExpr(
        "tenant_slug",
        f"CASE l_returnflag {names} END AS source_platform",
        "to_date(day) AS report_date",
        "campaign_id",
        "ad_group_id",
        "ad_id",
        "spend",
        "impressions",
        "clicks",
        "conversions",
    )


def raw_campaigns(spark, sf, platform: str) -> DataFrame:
    """Every supplier as a campaign of each of the three tenants."""
    names = {
        "tiktok_ads": ("campaign_id", "campaign_name", "status"),
        "amazon_ads": ("id", "name", "state"),
    }.get(platform, ("id", "name", "status"))
    return table(spark, sf, "supplier").select(
        F.explode(F.array(*[F.lit(t) for t in ("t0", "t1", "t2")])).alias("tenant_slug"),
        F.col("s_suppkey").cast("string").alias(names[0]),
        F.col("s_name").alias(names[1]),
        F.when(F.col("s_acctbal") > 0, "ACTIVE").otherwise("PAUSED").alias(names[2]),
    )


def unpacked_campaigns(spark, sf, platform: str) -> DataFrame:
    from tributary.operators.ads import CAMPAIGN_OBJECT

    return through_hub(raw_campaigns(spark, sf, platform), platform, CAMPAIGN_OBJECT[platform])


def campaigns(spark, sf) -> DataFrame:
    """Canonical dim_campaigns: supplier x tenant x flagged platform."""
    return table(spark, sf, "supplier").select(
        F.explode(F.array(*[F.lit(t) for t in ("t0", "t1", "t2")])).alias("tenant_slug"),
        F.col("s_suppkey").cast("string").alias("campaign_id"),
        F.col("s_name").alias("campaign_name"),
        F.when(F.col("s_acctbal") > 0, "ACTIVE").otherwise("PAUSED").alias("campaign_status"),
    ).select(
        "tenant_slug",
        F.explode(F.array(*[F.lit(p) for p in PLATFORM_OF_FLAG.values()])).alias("source_platform"),
        "campaign_id",
        "campaign_name",
        "campaign_status",
    )


def orders_base(spark, sf) -> DataFrame:
    """Orders with their customer and a line item list built from the order row."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    item = F.struct(
        F.concat(F.lit("p"), (F.col("o_orderkey") % 50).cast("string")).alias("product_id"),
        F.col("o_orderpriority").alias("name"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("quantity"),
        F.col("o_totalprice").alias("price"),
    )
    return joined.select(
        _tenant("o_orderkey").alias("tenant_slug"),
        F.col("o_orderkey").alias("order_key"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.col("o_totalprice").alias("total_price"),
        F.lit("USD").alias("currency"),
        F.col("o_orderstatus").alias("order_status"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("customer_email"),
        F.col("o_custkey").alias("customer_key"),
        F.array_repeat(item, (F.col("o_orderkey") % 3).cast("int")).alias("line_items"),
    )


def raw_orders(spark, sf, platform: str) -> DataFrame:
    base = orders_base(spark, sf)
    if platform == "shopify":
        return base.select(
            "tenant_slug",
            F.col("order_key").alias("id"),
            F.concat(F.lit("#"), F.col("order_key").cast("string")).alias("name"),
            F.col("customer_email").alias("email"),
            "total_price",
            "currency",
            F.col("order_status").alias("financial_status"),
            F.lit("other@example.com").alias("customer_email"),
            F.col("customer_key").cast("string").alias("customer_id"),
            "created_at",
            "line_items",
        )
    shared = base.select(
        "tenant_slug",
        F.col("order_key").alias("id"),
        F.concat(F.lit("W-"), F.col("order_key").cast("string")).alias("number"),
        F.col("order_status").alias("status"),
        "total_price",
        "currency",
        F.col("customer_key").alias("customer_id"),
        F.col("customer_email").alias("billing_email"),
        "created_at",
        "line_items",
    )
    return shared if platform == "woocommerce" else shared.drop("number", "line_items")


def unpacked_orders(spark, sf, platform: str) -> DataFrame:
    return through_hub(raw_orders(spark, sf, platform), platform, "orders")


def orders(spark, sf) -> DataFrame:
    """Canonical fct_orders (shopify) straight from the tables."""
    from tributary.sources.sinks import conform

    return conform(
        orders_base(spark, sf).select(
            "tenant_slug",
            F.lit("shopify").alias("source_platform"),
            F.col("order_key").cast("string").alias("order_id"),
            F.col("created_at").cast("timestamp").alias("order_date"),
            "total_price",
            "currency",
            F.col("order_status").alias("financial_status"),
            "customer_email",
            F.col("customer_key").cast("string").alias("customer_id"),
            F.to_json("line_items").alias("line_items_json"),
        ),
        "fct_orders",
    )


def packed(raw: DataFrame, platform: str, schema_hash: str = "h") -> DataFrame:
    body = [c for c in raw.columns if c != "tenant_slug"]
    return pack_payload(
        raw, F.col("tenant_slug"), platform, schema_hash, loaded_at=F.expr(EPOCH), payload=body
    )


def through_hub(raw: DataFrame, platform: str, object_name: str) -> DataFrame:
    return unpack(packed(raw, platform), SPECS[(platform, object_name)])


RUN_STATUS = {"P": "success", "F": "fail", "O": "error"}


def run_results(spark, sf) -> DataFrame:
    """Run artifacts from orders: one node per (tenant, priority), one invocation per day."""
    status = F.coalesce(*[F.when(F.col("o_orderstatus") == s, name) for s, name in RUN_STATUS.items()])
    tenant = _tenant("o_orderkey")
    obj = _pick(F.col("o_orderkey") % 5, "orders", "campaigns", "events", "facebook_insights", "ads_reports_daily")
    kind = _pick(F.col("o_orderkey") % 4, "model", "test", "seed", "FRESHNESS")
    node = F.when(
        F.expr("o_orderkey div 4") % 2 == 0, F.concat(F.lit("fct_"), tenant, F.lit("__orders"))
    ).otherwise(F.concat(F.lit("stg_"), tenant, F.lit("__shopify_"), obj))
    started = F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    return table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("invocation_id"),
        F.concat_ws(".", F.lower(kind), F.lit("proj"), tenant, F.concat(obj, (F.col("o_custkey") % 10).cast("string"))).alias("node_id"),
        node.alias("node_name"),
        kind.alias("resource_type"),
        status.alias("status"),
        F.when(status != "success", F.col("o_orderpriority")).alias("message"),
        F.col("o_custkey").alias("rows_affected"),
        (F.col("o_totalprice") / 100000.0).alias("execution_time_seconds"),
        started.alias("run_started_at"),
        (started + F.expr("interval 5 seconds")).alias("run_completed_at"),
        (started + F.expr("interval 9 seconds")).alias("extracted_at"),
    )
