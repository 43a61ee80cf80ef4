"""Cases for unpacking, engines, sessions, users and factories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.functions.attribution import earliest_value
from tributary.functions.funnel import funnel_position, step_counts
from tributary.operators import ads, analytics, factories, orders as store, sessions as ses, users as usr
from tributary.operators.unpack import SPECS, explode_line_items, unpack
from tributary.sources.local import local_frame
from tributary.sources.tenants import tenant_sources
from validation import inputs as src, sqltext as sql
from validation.case import case

DAY = 86_400


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


def text_time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- unpackers ---------------------------------------------------------------

AD_COLUMNS = {
    "facebook_ads": "report_date spend impressions clicks conversions campaign_id adset_id ad_id",
    "instagram_ads": "report_date spend impressions clicks conversions campaign_id adset_id ad_id",
    "google_ads": "report_date spend impressions clicks conversions campaign_id ad_group_id ad_id",
    "bing_ads": "report_date spend impressions clicks",
    "linkedin_ads": "report_date spend impressions clicks conversions campaign_id",
    "amazon_ads": "report_date campaign_id ad_group_id ad_id spend impressions clicks conversions",
    "tiktok_ads": "report_date campaign_id ad_group_id ad_id spend impressions clicks conversions",
}


def _ad_unpack_case(number: int, platform: str) -> None:
    columns = AD_COLUMNS[platform].split()
    listed = ", ".join(
        {"spend": "round(spend, 4) AS spend", "adset_id": "ad_group_id AS adset_id"}.get(c, c) for c in columns
    )
    text = f"WITH {sql.ADS_BASE} SELECT tenant_slug, '{platform}' AS source_platform, {listed} FROM ads_base"

    @case(f"unp_{number}_{platform}_performance", text)
    def run(spark, sf):
        rows = src.unpacked_ads(spark, sf, platform).select("tenant_slug", "source_platform", *columns)
        return rounded(rows, spend=4)


for _n, _p in enumerate(AD_COLUMNS, start=1):
    _ad_unpack_case(_n, _p)


@case(
    "unp_0_unpack_one_tenant",
    f"""WITH {sql.ADS_BASE} SELECT tenant_slug, md5('t1') AS tenant_skey, campaign_id, count(*) AS row_count,
    CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(spend), 4) AS spend
    FROM ads_base WHERE tenant_slug = 't1' GROUP BY 1, 2, 3""",
)
def unp_0(spark, sf):
    hub = src.packed(src.raw_ads(spark, sf, "facebook_ads"), "facebook_ads").unionByName(
        src.packed(src.raw_ads(spark, sf, "bing_ads"), "bing_ads")
    )
    rows = unpack(hub, SPECS[("facebook_ads", "facebook_insights")], tenant="t1")
    return rows.groupBy("tenant_slug", "tenant_skey", "campaign_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("clicks").alias("clicks"), F.round(F.sum("spend"), 4).alias("spend")
    )


_ALL_CAMPAIGNS = """
SELECT t.tenant_slug, '{p}' AS source_platform, CAST(s_suppkey AS VARCHAR) AS campaign_id, s_name AS campaign_name,
  CASE WHEN s_acctbal > 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS {status}
FROM supplier, (VALUES ('t0'), ('t1'), ('t2')) t(tenant_slug)"""


@case(
    "unp_8_campaigns_all_platforms",
    " UNION ALL ".join(_ALL_CAMPAIGNS.format(p=p, status="status") for p in ads.AD_SOURCES),
)
def unp_8(spark, sf):
    frames = [
        src.unpacked_campaigns(spark, sf, p).select(
            "tenant_slug", "source_platform", "campaign_id", "campaign_name", "status"
        )
        for p in ads.AD_SOURCES
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


@case(
    "unp_9_shopify_orders",
    f"""WITH {sql.ORDERS} SELECT tenant_slug, o_orderkey AS order_id, '#' || o_orderkey AS order_name, customer_email AS email,
    total_price, currency, order_status AS financial_status, 'other@example.com' AS customer_email,
    CAST(o_custkey AS VARCHAR) AS customer_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_created_at,
    CAST(o_orderkey % 3 AS BIGINT) AS items FROM orders_base""",
)
def unp_9(spark, sf):
    return src.unpacked_orders(spark, sf, "shopify").select(
        "tenant_slug", "order_id", "order_name", "email", "total_price", "currency", "financial_status",
        "customer_email", "customer_id", text_time("order_created_at"),
        F.json_array_length("line_items_json").cast("bigint").alias("items"),
    )


@case(
    "unp_10_woocommerce_orders",
    f"""WITH {sql.ORDERS} SELECT tenant_slug, 'W-' || o_orderkey AS order_id, o_orderkey AS woocommerce_id, order_status,
    total_price, currency, o_custkey AS customer_id, customer_email,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_created_at, CAST(o_orderkey % 3 AS BIGINT) AS items FROM orders_base""",
)
def unp_10(spark, sf):
    return src.unpacked_orders(spark, sf, "woocommerce").select(
        "tenant_slug", "order_id", "woocommerce_id", "order_status", "total_price", "currency", "customer_id",
        "customer_email", text_time("order_created_at"),
        F.json_array_length("line_items_json").cast("bigint").alias("items"),
    )


@case(
    "unp_11_bigcommerce_orders",
    f"""WITH {sql.ORDERS} SELECT tenant_slug, o_orderkey AS order_id, order_status, total_price, currency,
    o_custkey AS customer_id, customer_email AS billing_email,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_created_at FROM orders_base""",
)
def unp_11(spark, sf):
    return src.unpacked_orders(spark, sf, "bigcommerce").select(
        "tenant_slug", "order_id", "order_status", "total_price", "currency", "customer_id", "billing_email",
        text_time("order_created_at"),
    )


_GA_COLUMNS = (
    "tenant_slug source_platform event_name event_date event_timestamp user_pseudo_id user_id geo_country geo_city "
    "traffic_source traffic_medium traffic_campaign device_category ga_session_id transaction_id purchase_revenue "
    "ecommerce_currency"
).split()


def unpacked_events(spark, sf, platform: str) -> DataFrame:
    raw = {"google_analytics": src.raw_ga, "mixpanel": src.raw_mixpanel, "amplitude": src.raw_amplitude}[platform]
    frame = raw(spark, sf)
    return src.through_hub(frame, platform, "events")


@case("unp_12_google_analytics_events", f"WITH {sql.GA} SELECT {', '.join(_GA_COLUMNS)} FROM ga")
def unp_12(spark, sf):
    return unpacked_events(spark, sf, "google_analytics").select(_GA_COLUMNS)


_MIX = (
    "tenant_slug source_platform event_name event_timestamp user_pseudo_id user_id traffic_source traffic_medium "
    "traffic_campaign geo_country device_category prop_order_id prop_revenue"
).split()


@case("unp_13_mixpanel_events", f"WITH {sql.MIXPANEL} SELECT {', '.join(_MIX)}, 'Springfield' AS geo_city FROM mixpanel")
def unp_13(spark, sf):
    return unpacked_events(spark, sf, "mixpanel").select(*_MIX, "geo_city")


_AMP = (
    "tenant_slug source_platform event_name event_timestamp user_pseudo_id user_id session_id traffic_source "
    "traffic_medium traffic_campaign geo_country device_category order_id order_total"
).split()


@case("unp_14_amplitude_events", f"WITH {sql.AMPLITUDE} SELECT {', '.join(_AMP)}, 'Springfield' AS geo_city FROM amplitude")
def unp_14(spark, sf):
    return unpacked_events(spark, sf, "amplitude").select(*_AMP, "geo_city")


@case(
    "unp_15_line_items",
    f"""WITH {sql.ORDERS} SELECT tenant_slug, 'shopify' AS source_platform, CAST(o_orderkey AS VARCHAR) AS order_id,
    'p' || (o_orderkey % 50) AS product_id, o_orderpriority AS name, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS quantity,
    total_price AS price FROM (SELECT *, unnest(range(o_orderkey % 3)) AS i FROM orders_base)""",
)
def unp_15(spark, sf):
    return explode_line_items(store.orders(src.unpacked_orders(spark, sf, "shopify"), "shopify"))


# --- engines -------------------------------------------------------------------

_AD_NULLS = {
    "bing_ads": {c: "CAST(NULL AS VARCHAR)" for c in ("campaign_id", "ad_group_id", "ad_id")}
    | {"conversions": "CAST(NULL AS DOUBLE)"},
    "linkedin_ads": {c: "CAST(NULL AS VARCHAR)" for c in ("ad_group_id", "ad_id")},
}


def _ads_case(number: int, platform: str) -> None:
    nulls = _AD_NULLS.get(platform, {})
    keys = ", ".join(f"{nulls.get(c, c)} AS {c}" for c in ("campaign_id", "ad_group_id", "ad_id"))
    conversions = nulls.get("conversions", "conversions")
    text = f"""WITH {sql.ADS_BASE} SELECT tenant_slug, '{platform}' AS source_platform, report_date, {keys},
    round(spend, 4) AS spend, impressions, clicks, {conversions} AS conversions FROM ads_base"""

    @case(f"ads_{number}_{platform}_performance", text)
    def run(spark, sf):
        return rounded(ads.ad_performance(src.unpacked_ads(spark, sf, platform), platform), spend=4)

    @case(f"cmp_{number}_{platform}_campaigns", _ALL_CAMPAIGNS.format(p=platform, status="campaign_status"))
    def run_campaigns(spark, sf):
        return ads.campaigns(src.unpacked_campaigns(spark, sf, platform))


for _n, _p in enumerate(ads.AD_SOURCES, start=1):
    _ads_case(_n, _p)


_ORDER_SQL = """SELECT tenant_slug, '{p}' AS source_platform, {oid} AS order_id,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date, total_price, currency, order_status AS financial_status,
    customer_email, CAST(o_custkey AS VARCHAR) AS customer_id, {items} AS items FROM orders_base"""
_ORDER_PARTS = {
    "shopify": ("CAST(o_orderkey AS VARCHAR)", "CAST(o_orderkey % 3 AS BIGINT)"),
    "woocommerce": ("'W-' || o_orderkey", "CAST(o_orderkey % 3 AS BIGINT)"),
    "bigcommerce": ("CAST(o_orderkey AS VARCHAR)", "CAST(NULL AS BIGINT)"),
}


def order_output(df: DataFrame) -> DataFrame:
    return df.select(
        "tenant_slug", "source_platform", "order_id", text_time("order_date"), "total_price", "currency",
        "financial_status", "customer_email", "customer_id",
        F.json_array_length("line_items_json").cast("bigint").alias("items"),
    )


def _order_case(number: int, platform: str) -> None:
    oid, items = _ORDER_PARTS[platform]

    @case(f"ord_{number}_{platform}_orders", f"WITH {sql.ORDERS} " + _ORDER_SQL.format(p=platform, oid=oid, items=items))
    def run(spark, sf):
        return order_output(store.orders(src.unpacked_orders(spark, sf, platform), platform))


for _n, _p in enumerate(_ORDER_PARTS, start=1):
    _order_case(_n, _p)

_EVENT_COLUMNS = (
    "tenant_slug, source_platform, event_name, event_timestamp, user_pseudo_id, user_id, session_id, order_id, order_total, "
    "traffic_source, traffic_medium, traffic_campaign, geo_country, device_category"
)
_MIX_EVENTS = """mix_events AS (SELECT * EXCLUDE (prop_order_id, prop_revenue), CAST(NULL AS VARCHAR) AS session_id,
    prop_order_id AS order_id, prop_revenue AS order_total FROM mixpanel)"""


@case("evt_1_google_analytics_events", f"WITH {sql.GA}, {sql.GA_EVENTS} SELECT {_EVENT_COLUMNS} FROM ga_events")
def evt_1(spark, sf):
    return analytics.google_analytics_events(unpacked_events(spark, sf, "google_analytics"))


@case("evt_2_amplitude_events", f"WITH {sql.AMPLITUDE} SELECT {_EVENT_COLUMNS} FROM amplitude")
def evt_2(spark, sf):
    return analytics.amplitude_events(unpacked_events(spark, sf, "amplitude"))


@case("evt_3_mixpanel_events", f"WITH {sql.MIXPANEL}, {_MIX_EVENTS} SELECT {_EVENT_COLUMNS} FROM mix_events")
def evt_3(spark, sf):
    return analytics.mixpanel_events(unpacked_events(spark, sf, "mixpanel"))


# --- sessions ------------------------------------------------------------------

PURCHASE = "event_name = 'purchase'"
REAL = "nullif(transaction_id, 'N/A')"


def ga_sessions_sql(gap: int, conversion: str = PURCHASE) -> str:
    return sql.GA + "," + sql.gap_sessions("ga", 1_000_000, "purchase_revenue", REAL, conversion, gap)


def ga_sessions(spark, sf, gap_seconds: int, conversions=("purchase",)) -> DataFrame:
    return analytics.google_analytics_sessions(
        src.ga_events(spark, sf), list(conversions), gap_seconds=gap_seconds
    )


@case("ses_1_ga_sessions_30m", f"WITH {ga_sessions_sql(1800)} SELECT * FROM sessions")
def ses_1(spark, sf):
    return rounded(ga_sessions(spark, sf, 1800), session_revenue=4)


@case("ses_1_ga_sessions_24h", f"WITH {ga_sessions_sql(DAY)} SELECT * FROM sessions")
def ses_1_day(spark, sf):
    return rounded(ga_sessions(spark, sf, DAY), session_revenue=4)


def _mix_sql(gap: int) -> str:
    return sql.MIXPANEL + "," + sql.gap_sessions(
        "mixpanel", 1000, "prop_revenue", "prop_order_id", PURCHASE, gap, tie_safe=True
    )


@case("ses_2_mixpanel_sessions_30m", f"WITH {_mix_sql(1800)} SELECT * FROM sessions")
def ses_2(spark, sf):
    rows = analytics.mixpanel_sessions(src.mixpanel_events(spark, sf), ["purchase"])
    return rounded(rows, session_revenue=4)


@case("ses_2_mixpanel_sessions_24h", f"WITH {_mix_sql(DAY)} SELECT * FROM sessions")
def ses_2_day(spark, sf):
    rows = analytics.mixpanel_sessions(src.mixpanel_events(spark, sf), ["purchase"], gap_seconds=DAY)
    return rounded(rows, session_revenue=4)


def _amp_sessions(conversion: str) -> str:
    columns = sql.session_columns(1000, "0.0::DOUBLE", "CAST(NULL AS VARCHAR)", conversion, tie_safe=True)
    return f"""amp_sessions AS (SELECT tenant_slug, source_platform, session_id, user_pseudo_id, user_id, {columns}
    FROM amplitude WHERE session_id IS NOT NULL GROUP BY tenant_slug, source_platform, session_id, user_pseudo_id, user_id)"""


@case("ses_3_amplitude_sessions", f"WITH {sql.AMPLITUDE}, {_amp_sessions(PURCHASE)} SELECT * FROM amp_sessions")
def ses_3(spark, sf):
    return analytics.amplitude_sessions(src.amplitude_events(spark, sf), ["purchase"])


@case(
    "ses_4_bounds_and_duration",
    f"""WITH {ga_sessions_sql(DAY)} SELECT tenant_slug, traffic_source, count(*) AS sessions, min(session_start_ts) AS first_start,
    max(session_end_ts) AS last_end, round(avg(session_duration_seconds), 3) AS mean_seconds,
    CAST(sum(events_in_session) AS BIGINT) AS event_count FROM sessions GROUP BY 1, 2""",
)
def ses_4(spark, sf):
    return ga_sessions(spark, sf, DAY).groupBy("tenant_slug", "traffic_source").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("session_start_ts").alias("first_start"),
        F.max("session_end_ts").alias("last_end"),
        F.round(F.avg("session_duration_seconds"), 3).alias("mean_seconds"),
        F.sum("events_in_session").alias("event_count"),
    )


@case(
    "ses_5_first_touch_per_user",
    f"""WITH {sql.GA} SELECT tenant_slug, user_pseudo_id, arg_min(traffic_source, event_timestamp) AS traffic_source,
    arg_min(traffic_medium, event_timestamp) AS traffic_medium, arg_min(traffic_campaign, event_timestamp) AS traffic_campaign,
    arg_min(geo_country, event_timestamp) AS geo_country, arg_min(device_category, event_timestamp) AS device_category
    FROM ga GROUP BY 1, 2""",
)
def ses_5(spark, sf):
    return src.ga_events(spark, sf).groupBy("tenant_slug", "user_pseudo_id").agg(
        *[F.expr(f"{earliest_value(c, 'event_timestamp')} AS {c}") for c in ses.FIRST_TOUCH]
    )


@case(
    "ses_6_funnel_position",
    f"""WITH {sql.GA} SELECT tenant_slug, event_name, CASE event_name WHEN 'session_start' THEN 1::BIGINT WHEN 'view_item' THEN 2
    WHEN 'add_to_cart' THEN 3 WHEN 'begin_checkout' THEN 4 WHEN 'add_payment_info' THEN 5 WHEN 'purchase' THEN 6 ELSE 0 END
    AS funnel_position, count(*) AS event_count FROM ga GROUP BY 1, 2, 3""",
)
def ses_6(spark, sf):
    positioned = src.ga_events(spark, sf).withColumn("funnel_position", F.expr(funnel_position("event_name")))
    return positioned.groupBy("tenant_slug", "event_name", "funnel_position").agg(
        F.count(F.lit(1)).alias("event_count")
    )


@case(
    "ses_7_funnel_max_step",
    f"WITH {ga_sessions_sql(DAY)} SELECT tenant_slug, funnel_max_step, count(*) AS sessions FROM sessions GROUP BY 1, 2",
)
def ses_7(spark, sf):
    return ga_sessions(spark, sf, DAY).groupBy("tenant_slug", "funnel_max_step").agg(
        F.count(F.lit(1)).alias("sessions")
    )


@case(
    "ses_8_funnel_pivot",
    f"""WITH {sql.GA} SELECT tenant_slug, user_pseudo_id, """
    + ", ".join(
        f"count(*) FILTER (WHERE event_name = '{s}') AS funnel_step_{i}_{s}"
        for i, s in enumerate(
            ("session_start", "view_item", "add_to_cart", "begin_checkout", "add_payment_info", "purchase"), 1
        )
    )
    + " FROM ga GROUP BY 1, 2",
)
def ses_8(spark, sf):
    return src.ga_events(spark, sf).groupBy("tenant_slug", "user_pseudo_id").agg(*step_counts("event_name"))


# Tenant configuration of the cases: t0 and t1 list conversion events, t2 lists none.
MANIFEST = [
    (
        "t0",
        "active",
        '{"shopify": {"enabled": true}, "facebook_ads": {"enabled": true}, "google_ads": {"enabled": true},'
        ' "google_analytics": {"enabled": true, "logic": {"conversion_events": ["purchase"]}},'
        ' "mixpanel": {"enabled": true}}',
    ),
    (
        "t1",
        "active",
        '{"google_analytics": {"enabled": false}, "woocommerce": {"enabled": true, "tables": [{"name": "orders"}]},'
        ' "shopify": {"enabled": true}, "instagram_ads": {"enabled": true}, "facebook_ads": {"enabled": false},'
        ' "mixpanel": {"enabled": true, "tables": [{"name": "events",'
        ' "logic": {"conversion_events": ["purchase", "add_to_cart"]}}]}}',
    ),
    (
        "t2",
        "onboarding",
        '{"bigcommerce": {"enabled": true}, "amplitude": {"enabled": true}, "facebook_ads": {"enabled": true},'
        ' "google_ads": {"enabled": true}, "instagram_ads": {"enabled": true}}',
    ),
]


def config(spark) -> DataFrame:
    rows = local_frame(spark, MANIFEST, "tenant_slug string, status string, sources_config string")
    return tenant_sources(rows)


CONVERSION_BY_TENANT = "((tenant_slug = 't0' AND event_name = 'purchase') OR (tenant_slug = 't1' AND event_name IN ('purchase', 'add_to_cart')))"


@case(
    "ses_9_conversions_per_tenant",
    f"""WITH {ga_sessions_sql(DAY, CONVERSION_BY_TENANT)} SELECT tenant_slug, is_conversion_session, count(*) AS sessions,
    CAST(sum(funnel_conversion_count) AS BIGINT) AS conversions FROM sessions GROUP BY 1, 2""",
)
def ses_9(spark, sf):
    lists = local_frame(
        spark,
        [("t0", "google_analytics", ["purchase"]), ("t1", "google_analytics", ["purchase", "add_to_cart"]), ("t2", "google_analytics", [])],
        "tenant_slug string, source string, conversion_events array<string>",
    )
    rows = analytics.google_analytics_sessions(src.ga_events(spark, sf), lists, gap_seconds=DAY)
    return rows.groupBy("tenant_slug", "is_conversion_session").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("funnel_conversion_count").alias("conversions")
    )


@case(
    "ses_10_revenue_and_transaction",
    f"""WITH {ga_sessions_sql(DAY)} SELECT session_id, session_revenue, transaction_id FROM sessions
    WHERE session_revenue > 0 OR transaction_id IS NOT NULL""",
)
def ses_10(spark, sf):
    rows = ga_sessions(spark, sf, DAY).filter("session_revenue > 0 or transaction_id is not null")
    return rounded(rows.select("session_id", "session_revenue", "transaction_id"), session_revenue=4)


# --- users ---------------------------------------------------------------------


def users_sql(events: str, tie_safe: bool) -> str:
    def first(c: str, name: str) -> str:
        if not tie_safe:
            return f"arg_min({c}, event_timestamp) AS {name}"
        return (
            f"struct_extract(min(struct_pack(at := event_timestamp, v := {c}))"
            f" FILTER (WHERE {c} IS NOT NULL), 'v') AS {name}"
        )

    return f"""
user_agg AS (SELECT tenant_slug, source_platform, user_pseudo_id, max(user_id) AS user_id,
    min(event_timestamp) AS first_seen_at, max(event_timestamp) AS last_seen_at, count(*) AS total_events,
    count(DISTINCT session_id) AS total_sessions, {first('geo_country', 'first_geo_country')},
    {first('device_category', 'first_device_category')} FROM {events} GROUP BY 1, 2, 3),
links AS (SELECT DISTINCT tenant_slug, user_pseudo_id, order_id FROM {events} WHERE order_id IS NOT NULL),
resolved AS (SELECT l.tenant_slug, l.user_pseudo_id, max(o.customer_email) AS customer_email, max(o.customer_id) AS customer_id
    FROM links l JOIN star_orders o ON l.order_id = o.order_id AND l.tenant_slug = o.tenant_slug GROUP BY 1, 2),
users AS (SELECT u.*, r.customer_email, r.customer_id, r.customer_email IS NOT NULL AS is_customer
    FROM user_agg u LEFT JOIN resolved r ON u.tenant_slug = r.tenant_slug AND u.user_pseudo_id = r.user_pseudo_id)"""


def ga_star_events(spark, sf) -> DataFrame:
    return analytics.google_analytics_events(src.ga_events(spark, sf))


_GA_USERS = f"WITH {sql.GA}, {sql.GA_EVENTS}, {sql.ORDERS}, {users_sql('ga_events', False)}"


@case("usr_1_user_aggregate", f"{_GA_USERS} SELECT * FROM user_agg")
def usr_1(spark, sf):
    return usr.user_aggregate(ga_star_events(spark, sf))


@case("usr_2_purchase_links", f"{_GA_USERS} SELECT * FROM links")
def usr_2(spark, sf):
    return usr.purchase_links(ga_star_events(spark, sf))


@case("usr_3_identity_resolution", f"{_GA_USERS} SELECT * FROM resolved")
def usr_3(spark, sf):
    return usr.resolve_identities(usr.purchase_links(ga_star_events(spark, sf)), src.orders(spark, sf))


@case("usr_4_google_analytics_users", f"{_GA_USERS} SELECT * FROM users")
def usr_4(spark, sf):
    return usr.users(ga_star_events(spark, sf), src.orders(spark, sf))


@case(
    "usr_4_amplitude_users",
    f"WITH {sql.AMPLITUDE}, {sql.ORDERS}, {users_sql('amplitude', True)} SELECT * FROM users",
)
def usr_4_amplitude(spark, sf):
    return usr.users(analytics.amplitude_events(src.amplitude_events(spark, sf)), src.orders(spark, sf))


@case(
    "usr_4_mixpanel_users",
    f"WITH {sql.MIXPANEL}, {_MIX_EVENTS}, {sql.ORDERS}, {users_sql('mix_events', True)} SELECT * FROM users",
)
def usr_4_mixpanel(spark, sf):
    return usr.users(analytics.mixpanel_events(src.mixpanel_events(spark, sf)), src.orders(spark, sf))


# --- factories -------------------------------------------------------------------

_ENABLED_ADS = """((tenant_slug = 't0' AND source_platform IN ('facebook_ads', 'google_ads'))
    OR (tenant_slug = 't1' AND source_platform = 'instagram_ads')
    OR (tenant_slug = 't2' AND source_platform IN ('facebook_ads', 'google_ads', 'instagram_ads')))"""


@case(
    "fct_1_ad_performance",
    f"WITH {sql.ADS_BASE} SELECT * REPLACE (round(spend, 4) AS spend) FROM ads WHERE {_ENABLED_ADS}",
)
def fct_1(spark, sf):
    frames = {p: src.flagged_ads(spark, sf, p) for p in src.PLATFORM_OF_FLAG.values()}
    return rounded(factories.build_ad_performance(spark, frames, config(spark)), spend=4)


_FIRST_STORE = " UNION ALL ".join(
    _ORDER_SQL.format(p=p, oid=_ORDER_PARTS[p][0], items=_ORDER_PARTS[p][1]) + f" WHERE tenant_slug = '{t}'"
    for t, p in (("t0", "shopify"), ("t1", "woocommerce"), ("t2", "bigcommerce"))
)


@case("fct_2_orders", f"WITH {sql.ORDERS} {_FIRST_STORE}")
def fct_2(spark, sf):
    frames = {p: src.unpacked_orders(spark, sf, p) for p in store.STORE_SOURCES}
    return order_output(factories.build_orders(spark, frames, config(spark)))


def event_frames(spark, sf) -> dict[str, DataFrame]:
    return {
        "google_analytics": src.ga_events(spark, sf),
        "mixpanel": src.mixpanel_events(spark, sf),
        "amplitude": src.amplitude_events(spark, sf),
    }


_AMP_ONLY = sql.AMPLITUDE.replace(sql.EVENTS_BASE + ",", "")
_MIX_ONLY = sql.MIXPANEL.replace(sql.EVENTS_BASE + ",", "")
_FIRST_EVENTS = f"""{sql.GA}, {_MIX_ONLY}, {_AMP_ONLY}, {sql.GA_EVENTS}, {_MIX_EVENTS},
first_events AS (SELECT {_EVENT_COLUMNS} FROM ga_events WHERE tenant_slug = 't0'
  UNION ALL SELECT {_EVENT_COLUMNS} FROM mix_events WHERE tenant_slug = 't1'
  UNION ALL SELECT {_EVENT_COLUMNS} FROM amplitude WHERE tenant_slug = 't2')"""

_MIX_SESSIONS = (
    sql.gap_sessions(
        "mixpanel", 1000, "prop_revenue", "prop_order_id", CONVERSION_BY_TENANT, tie_safe=True, name="mix_sessions"
    )
    .replace("marked", "mix_marked")
    .replace("numbered", "mix_numbered")
)


@case(
    "fct_3_sessions",
    f"""WITH {ga_sessions_sql(1800)}, {_MIX_ONLY}, {_AMP_ONLY}, {_MIX_SESSIONS},
    {_amp_sessions('event_name IS NULL')}
    SELECT * FROM sessions WHERE tenant_slug = 't0' UNION ALL BY NAME SELECT * FROM mix_sessions WHERE tenant_slug = 't1'
    UNION ALL BY NAME SELECT * FROM amp_sessions WHERE tenant_slug = 't2'""",
)
def fct_3(spark, sf):
    return rounded(factories.build_sessions(spark, event_frames(spark, sf), config(spark)), session_revenue=4)


@case("fct_4_events", f"WITH {_FIRST_EVENTS} SELECT * FROM first_events")
def fct_4(spark, sf):
    return factories.build_events(spark, event_frames(spark, sf), config(spark))


@case("fct_5_campaigns", f"WITH {sql.CAMPAIGNS} SELECT * FROM campaigns WHERE {_ENABLED_ADS}")
def fct_5(spark, sf):
    frames = {p: src.unpacked_campaigns(spark, sf, p) for p in src.PLATFORM_OF_FLAG.values()}
    return factories.build_campaigns(spark, frames, config(spark))


@case(
    "fct_6_users",
    f"WITH {_FIRST_EVENTS}, {sql.ORDERS}, {users_sql('first_events', True)} SELECT * FROM users",
)
def fct_6(spark, sf):
    events = factories.build_events(spark, event_frames(spark, sf), config(spark))
    return factories.build_users(spark, events, src.orders(spark, sf), config(spark))


@case(
    "fct_7_tenant_config",
    """SELECT 'c' || c_custkey AS tenant_slug, source, rank, CASE source WHEN 'shopify' THEN true ELSE c_nationkey % 2 = 0 END AS enabled,
    CASE source WHEN 'shopify' THEN 0 ELSE 1 + CAST(c_nationkey % 3 = 0 AS INTEGER) END AS conversion_count
    FROM customer, (VALUES ('shopify', 1), ('google_analytics', 2)) v(source, rank)""",
)
def fct_7(spark, sf):
    """A manifest per customer: one store and one analytics source with its own conversion events."""
    customers = src.table(spark, sf, "customer")
    even, third = F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") % 3 == 0
    text = F.concat(
        F.lit('{"shopify": {"enabled": true}, "google_analytics": {"enabled": '), even.cast("string"),
        F.lit(', "logic": {"conversion_events": ["purchase"'), F.when(third, ', "add_to_cart"').otherwise(""), F.lit("]}}}"),
    )
    manifest = customers.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tenant_slug"), F.lit("active").alias("status"),
        text.alias("sources_config"),
    )
    return tenant_sources(manifest).select(
        "tenant_slug", "source", "rank", "enabled", F.size("conversion_events").alias("conversion_count")
    )
