from tests.conftest import plan_of, rows
from tributary.operators.users import resolve_identities, users
from tributary.registry import engine, register_engine, sources_for
from tributary.operators import factories
from tributary.schemas import STAR
from tributary.sources.local import local_frame
from tributary.sources.tenants import tenant_sources
import pytest


def event(tenant, user, ts, order=None, session=None, country="US"):
    return (tenant, "mixpanel", "view_item", ts, user, user and f"id_{user}", session, order, None, None, None, None, country, None)


def order(tenant, key, email, customer):
    return (tenant, "shopify", key, None, 1.0, "USD", "paid", email, customer, None)


def test_identity_stays_inside_the_tenant(spark):
    events = local_frame(
        spark,
        [event("t0", "u", 2, "o1", country="DE"), event("t0", "u", 1, country=None), event("t0", "u", 3, "o2"), event("t1", "u", 1, "o1"), event("t0", None, 1)],
        STAR["fct_events"],
    )
    orders = local_frame(spark, [order("t0", "o1", "a@x", "1"), order("t0", "o2", "b@x", "2"), order("t0", "o1", "a@x", "1")], STAR["fct_orders"])
    got = rows(users(events, orders), "tenant_slug", "user_pseudo_id", "customer_email", "is_customer", "total_events", "total_sessions", "first_geo_country", "first_seen_at")
    assert got == [("t0", "u", "b@x", True, 3, 0, "DE", 1), ("t0", None, None, False, 1, 0, "US", 1), ("t1", "u", None, False, 1, 0, "US", 1)]


def test_orders_are_reduced_before_the_join(spark):
    links = local_frame(spark, [("t0", "u", "o1")], "tenant_slug string, user_pseudo_id string, order_id string")
    orders = local_frame(spark, [order("t0", "o1", "a@x", "1")] * 50, STAR["fct_orders"])
    df = resolve_identities(links, orders)
    assert rows(df) == [("t0", "u", "a@x", "1")]


def config(spark, text):
    return tenant_sources(local_frame(spark, [("t0", text)], "tenant_slug string, sources_config string"))


def frames(spark):
    orders = local_frame(spark, [order("t0", "o1", "a@x", "1"), order("t9", "o1", "a@x", "1")], STAR["fct_orders"])
    named = orders.withColumnsRenamed({"order_date": "order_created_at", "customer_email": "email"})
    return {"shopify": named, "custom": orders}


def test_no_enabled_source_gives_an_empty_relation(spark):
    df = factories.build_orders(spark, frames(spark), config(spark, '{"shopify": {"enabled": false}}'))
    assert df.count() == 0 and df.columns == STAR["fct_orders"].fieldNames()


def test_custom_engine_and_first_source(spark):
    register_engine("custom", "orders", lambda rows: rows)
    assert "custom" in sources_for("orders")
    text = '{"custom": {"enabled": true}, "shopify": {"enabled": true}}'
    df = factories.build_orders(spark, frames(spark), config(spark, text))
    assert rows(df, "tenant_slug", "order_id") == [("t0", "o1")]
    with pytest.raises(ValueError):
        engine("nothing", "orders")


def test_tenants_are_literals_on_the_scan(spark):
    df = factories.build_orders(spark, frames(spark), config(spark, '{"shopify": {"enabled": true}}'))
    assert rows(df, "tenant_slug") == [("t0",)]
    assert "Join" not in plan_of(df)
