"""The same mappings as ``inputs``, as SQL common table expressions."""

EVENTS_BASE = """
events_base AS (
  SELECT 't' || (user_id % 3) AS tenant_slug,
    CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'view_item'
      WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'exception' END AS event_name,
    ts AS moment, user_id, event_id, k,
    CASE WHEN k % 10 <> 0 THEN CASE k % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'direct' WHEN 2 THEN 'email' ELSE 'referral' END END AS traffic_source,
    CASE WHEN k % 2 = 0 THEN 'cpc' ELSE 'organic' END AS traffic_medium,
    'Supplier#' || lpad(CAST(k % 100 AS VARCHAR), 9, '0') AS traffic_campaign,
    CASE k % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'DE' END AS geo_country,
    CASE k % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_category,
    CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN CAST(event_id * 3 + user_id % 3 AS VARCHAR) END AS order_id,
    CASE WHEN event_type = 'purchase' THEN value END AS revenue
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

GA = EVENTS_BASE + """,
ga AS (
  SELECT tenant_slug, 'google_analytics' AS source_platform, event_name, strftime(moment, '%Y%m%d') AS event_date,
    epoch_us(moment) AS event_timestamp, 'u_' || user_id AS user_pseudo_id, CAST(user_id AS VARCHAR) AS user_id,
    geo_country, 'Springfield' AS geo_city, traffic_source, traffic_medium, traffic_campaign, device_category,
    user_id || '_' || strftime(moment, '%Y-%m-%d') AS ga_session_id, coalesce(order_id, 'N/A') AS transaction_id,
    coalesce(revenue, 0.0::DOUBLE) AS purchase_revenue, 'USD' AS ecommerce_currency
  FROM events_base)"""

MIXPANEL = EVENTS_BASE + """,
mixpanel AS (
  SELECT tenant_slug, 'mixpanel' AS source_platform, event_name,
    CAST(floor(epoch_us(moment) / 1000000) AS BIGINT) * 1000 AS event_timestamp,
    'u_' || user_id AS user_pseudo_id, 'u_' || user_id AS user_id,
    traffic_source, traffic_medium, traffic_campaign, geo_country, device_category,
    order_id AS prop_order_id, revenue AS prop_revenue
  FROM events_base)"""

AMPLITUDE = EVENTS_BASE + """,
amplitude AS (
  SELECT tenant_slug, 'amplitude' AS source_platform, event_name,
    CAST(floor(epoch_us(moment) / 1000000) AS BIGINT) * 1000 AS event_timestamp,
    'u_' || user_id AS user_pseudo_id, 'u_' || user_id AS user_id,
    CASE WHEN k % 10 <> 0 THEN user_id || '_' || strftime(moment, '%Y-%m-%d') END AS session_id,
    traffic_source, traffic_medium, traffic_campaign, geo_country, device_category,
    order_id, revenue AS order_total
  FROM events_base)"""

GA_EVENTS = """
ga_events AS (
  SELECT tenant_slug, source_platform, event_name, event_timestamp, user_pseudo_id, user_id, ga_session_id AS session_id,
    CASE WHEN transaction_id <> 'N/A' THEN transaction_id END AS order_id,
    CASE WHEN transaction_id <> 'N/A' THEN purchase_revenue END AS order_total,
    traffic_source, traffic_medium, traffic_campaign, geo_country, device_category
  FROM ga)"""

ADS_BASE = """
ads_base AS (
  SELECT 't' || (l_orderkey % 3) AS tenant_slug, l_returnflag, CAST(l_shipdate AS DATE) AS report_date,
    CAST(l_suppkey AS VARCHAR) AS campaign_id, CAST(l_partkey % 50 AS VARCHAR) AS ad_group_id,
    CAST(l_partkey AS VARCHAR) AS ad_id, l_extendedprice * (1 - l_discount) AS spend,
    CAST(round(l_quantity) AS BIGINT) AS clicks, CAST(round(l_quantity) * 100 AS BIGINT) AS impressions,
    CAST(l_linenumber AS DOUBLE) AS conversions
  FROM lineitem),
ads AS (
  SELECT tenant_slug, CASE l_returnflag WHEN 'A' THEN 'facebook_ads' WHEN 'N' THEN 'google_ads' WHEN 'R' THEN 'instagram_ads' END AS source_platform,
    report_date, campaign_id, ad_group_id, ad_id, spend, impressions, clicks, conversions FROM ads_base)"""

CAMPAIGNS = """
campaigns AS (
  SELECT t.tenant_slug, p.source_platform, CAST(s_suppkey AS VARCHAR) AS campaign_id, s_name AS campaign_name,
    CASE WHEN s_acctbal > 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS campaign_status
  FROM supplier, (VALUES ('t0'), ('t1'), ('t2')) t(tenant_slug),
    (VALUES ('facebook_ads'), ('google_ads'), ('instagram_ads')) p(source_platform))"""

ORDERS = """
orders_base AS (
  SELECT 't' || (o_orderkey % 3) AS tenant_slug, o_orderkey, o_orderdate, o_totalprice AS total_price, 'USD' AS currency,
    o_orderstatus AS order_status, lower(c_name) || '@example.com' AS customer_email, o_custkey, o_orderpriority
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
star_orders AS (
  SELECT tenant_slug, 'shopify' AS source_platform, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date,
    total_price, currency, order_status AS financial_status, customer_email, CAST(o_custkey AS VARCHAR) AS customer_id
  FROM orders_base)"""

RUNS = """
runs AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS invocation_id,
    lower(kind) || '.proj.' || tenant || '.' || obj || (o_custkey % 10) AS node_id,
    CASE WHEN (o_orderkey // 4) % 2 = 0 THEN 'fct_' || tenant || '__orders' ELSE 'stg_' || tenant || '__shopify_' || obj END AS node_name,
    kind AS resource_type, status,
    CASE WHEN status <> 'success' THEN o_orderpriority END AS message, o_custkey AS rows_affected,
    o_totalprice / 100000.0::DOUBLE AS execution_time_seconds,
    o_orderdate + to_seconds(o_orderkey % 86400) AS run_started_at,
    o_orderdate + to_seconds(o_orderkey % 86400 + 5) AS run_completed_at,
    o_orderdate + to_seconds(o_orderkey % 86400 + 9) AS extracted_at
  FROM (SELECT *, 't' || (o_orderkey % 3) AS tenant,
      CASE o_orderkey % 5 WHEN 0 THEN 'orders' WHEN 1 THEN 'campaigns' WHEN 2 THEN 'events' WHEN 3 THEN 'facebook_insights' ELSE 'ads_reports_daily' END AS obj,
      CASE o_orderkey % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'test' WHEN 2 THEN 'seed' ELSE 'FRESHNESS' END AS kind,
      CASE o_orderstatus WHEN 'P' THEN 'success' WHEN 'F' THEN 'fail' WHEN 'O' THEN 'error' END AS status FROM orders))"""


def session_columns(unit: int, revenue: str, transaction: str, conversion: str, tie_safe: bool = False) -> str:
    """Select list of the sessions fact over rows named as in the unpacked events."""

    def first(c: str) -> str:
        if not tie_safe:
            return f"arg_min({c}, event_timestamp) AS {c}"
        return (
            f"struct_extract(min(struct_pack(at := event_timestamp, v := {c}))"
            f" FILTER (WHERE {c} IS NOT NULL), 'v') AS {c}"
        )

    steps = ("session_start", "view_item", "add_to_cart", "begin_checkout", "add_payment_info", "purchase")
    position = "CASE event_name " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(steps, 1)) + " ELSE 0 END"
    counts = ", ".join(
        f"CAST(sum(CASE WHEN event_name = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS funnel_step_{i}_{s}"
        for i, s in enumerate(steps, 1)
    )
    touches = ", ".join(
        first(c) for c in ("traffic_source", "traffic_medium", "traffic_campaign", "geo_country", "device_category")
    )
    return f"""min(event_timestamp) AS session_start_ts, max(event_timestamp) AS session_end_ts,
    CAST((max(event_timestamp) - min(event_timestamp)) / {unit}.0 AS DOUBLE) AS session_duration_seconds,
    count(*) AS events_in_session, {touches}, CAST(max({position}) AS BIGINT) AS funnel_max_step, {counts},
    CAST(sum(CASE WHEN {conversion} THEN 1 ELSE 0 END) AS BIGINT) AS funnel_conversion_count,
    sum(CASE WHEN {conversion} THEN 1 ELSE 0 END) > 0 AS is_conversion_session,
    round(sum(coalesce({revenue}, 0.0::DOUBLE)), 4) AS session_revenue, max({transaction}) AS transaction_id"""


def gap_sessions(source: str, unit: int, revenue: str, transaction: str, conversion: str, gap_seconds: int = 1800,
                 tie_safe: bool = False, name: str = "sessions") -> str:
    """CTEs ending in ``sessions``: lag, running sum, group."""
    gap = gap_seconds * unit
    return f"""
marked AS (
  SELECT *, CASE WHEN lag(event_timestamp) OVER w IS NULL OR event_timestamp - lag(event_timestamp) OVER w > {gap} THEN 1 ELSE 0 END AS is_new
  FROM {source} WINDOW w AS (PARTITION BY tenant_slug, user_pseudo_id ORDER BY event_timestamp)),
numbered AS (
  SELECT *, sum(is_new) OVER (PARTITION BY tenant_slug, user_pseudo_id ORDER BY event_timestamp) AS n FROM marked),
{name} AS (
  SELECT tenant_slug, source_platform, user_pseudo_id || '-' || CAST(CAST(n AS BIGINT) AS VARCHAR) AS session_id, user_pseudo_id,
    max(user_id) AS user_id, {session_columns(unit, revenue, transaction, conversion, tie_safe)}
  FROM numbered GROUP BY tenant_slug, source_platform, user_pseudo_id, n)"""
