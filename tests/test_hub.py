import json

from pyspark.sql import functions as F

from tests.conftest import plan_of, rows
from tributary.functions.keys import schema_fingerprint
from tributary.operators import hub
from tributary.operators.unpack import SPECS, unpack
from tributary.schemas import HUB, SCHEMA_HISTORY
from tributary.session import scratch_path
from tributary.sources import sinks
from tributary.sources.local import local_frame
from tributary.sources.tenants import tenant_manifest, tenant_sources


def packed(spark, payloads, tenant="t0", platform="shopify"):
    raw = local_frame(spark, [(p,) for p in payloads], "body string")
    return raw.select(
        F.lit(tenant).alias("tenant_slug"), F.lit("k").alias("tenant_skey"), F.lit(platform).alias("source_platform"),
        F.lit("h").alias("source_schema_hash"), F.lit(None).cast("string").alias("source_schema"),
        F.col("body").alias("raw_data_payload"), F.current_timestamp().alias("loaded_at"),
    )


def test_push_keeps_copies_inside_a_batch_and_skips_known_rows(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, ['{"a":1}', '{"a":1}', '{"a":2}']))
    hub.push_into(spark, path, packed(spark, ['{"a":1}', '{"a":3}']))
    hub.push_into(spark, path, packed(spark, ['{"a":1}'], tenant="t1"))
    got = rows(sinks.read_hub(spark, path), "tenant_slug", "raw_data_payload")
    assert got == [("t0", '{"a":1}')] * 2 + [("t0", '{"a":2}'), ("t0", '{"a":3}'), ("t1", '{"a":1}')]
    assert sinks.read_hub(spark, path).columns == HUB.fieldNames()


def test_push_reads_only_keys_of_the_touched_partitions(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, ['{"a":1}']).unionByName(packed(spark, ['{"a":2}'], tenant="t1")))
    stored = sinks.read_hub(spark, path, digest=True).filter(F.col("tenant_slug").isin(["t0"]))
    plan = plan_of(hub.push(stored, packed(spark, ['{"a":1}'])))
    assert "ReadSchema: struct<payload_md5:string>" in plan
    assert "PartitionFilters: [isnotnull(tenant_slug" in plan or "tenant_slug#" in plan.split("PartitionFilters")[1]


def test_pack_keeps_nulls(spark):
    raw = local_frame(spark, [(1, None)], "id bigint, note string")
    row = hub.pack_payload(raw, "t0", "shopify", "h").first()
    assert json.loads(row.raw_data_payload) == {"id": 1, "note": None}


def test_unpack_edge_values(spark):
    payloads = [
        '{"id": 5, "total_price": "12.50", "line_items": [{"product_id": "p", "quantity": 2}]}',
        '{"id": "6.0", "total_price": "free", "created_at": "not a time"}',
        '{"id": null}',
        "not json",
    ]
    df = unpack(packed(spark, payloads), SPECS[("shopify", "orders")])
    got = rows(df, "order_id", "total_price", "order_created_at", "line_items_json")
    assert (5, 12.5, None, '[{"product_id":"p","quantity":2}]') in got
    assert (6, None, None, None) in got
    assert got.count((None, None, None, None)) == 2


def test_amplitude_time_as_text_or_number(spark):
    payloads = ['{"event_time": "2024-01-01 00:00:01"}', '{"event_time": 17}', '{"event_time": "soon"}']
    df = unpack(packed(spark, payloads, platform="amplitude"), SPECS[("amplitude", "events")])
    assert rows(df, "event_timestamp") == sorted([(1704067201000,), (17,), (None,)], key=repr)


def test_spelling_variants(spark):
    payloads = ['{"campaign_id": "c", "campaign_name": "n"}', '{"id": "d", "name": "m", "state": "on"}']
    df = unpack(packed(spark, payloads, platform="tiktok_ads"), SPECS[("tiktok_ads", "campaigns")])
    assert rows(df, "campaign_id", "campaign_name", "status") == [("c", "n", None), ("d", "m", "on")]


def test_fingerprint_ignores_order_and_loader_columns(spark):
    a = schema_fingerprint([("b", "text"), ("a", "bigint"), ("_dlt_id", "text")])
    assert a == schema_fingerprint([("a", "bigint"), ("b", "text"), ("_airbyte_x", "text")])
    assert a != schema_fingerprint([("a", "text"), ("b", "text")])
    columns = local_frame(
        spark, [("t", "b", "text"), ("t", "a", "bigint"), ("t", "_dlt_id", "text")],
        "table_name string, column_name string, data_type string",
    )
    assert rows(hub.fingerprint_tables(columns, ["table_name"]), "source_schema_hash") == [(a,)]


def test_raw_names_with_a_known_tenant(spark):
    names = local_frame(
        spark, [("raw_a_b_shopify_orders", "a_b"), ("raw_x_shopify_orders", "a_b"), ("raw_a_b_stripe_x", "a_b")],
        "table_name string, tenant_slug string",
    )
    got = rows(hub.parse_raw_name(names), "tenant_slug", "source_platform", "source_object")
    assert got == [("a_b", "shopify", "orders")]


def test_schema_history_updates_and_inserts(spark):
    def seen(digest):
        row = ("t0", "shopify", "shopify_orders", digest, "{}")
        schema = "tenant_slug string, source_platform string, _src_table string, source_schema_hash string, source_schema string"
        return local_frame(spark, [row, row], schema)

    first, second = F.expr("timestamp'2024-01-01 00:00:00'"), F.expr("timestamp'2024-02-01 00:00:00'")
    history = hub.push_schema_history(local_frame(spark, [], SCHEMA_HISTORY), seen("a"), first)
    history = hub.push_schema_history(history, seen("a").unionByName(seen("b")), second)
    got = rows(history.selectExpr("source_table_name", "source_schema_hash", "month(first_seen_at)", "month(updated_at)"))
    assert got == [("orders", "a", 1, 2), ("orders", "b", 2, 2)]
    assert rows(hub.schema_drift(history), "previous_hash", "current_hash") == [("a", "b")]


def test_configuration_order_and_levels(spark):
    text = (
        '{"shopify": {"enabled": true, "tables": [{"name": "orders", "logic": {"x": 1}}]}, "mixpanel": {"enabled": true,'
        ' "logic": {"conversion_events": ["a"]}, "tables": [{"name": "events", "logic": {"conversion_events": ["b"]}}]},'
        ' "amplitude": {"tables": [{"name": "events", "logic": {"conversion_events": ["c"]}}]}}'
    )
    raw = local_frame(spark, [("t0", "active", text)], "slug string, status string, sources string")
    manifest = tenant_manifest(raw)
    got = rows(tenant_sources(manifest), "rank", "source", "enabled", "conversion_events")
    assert got == [(1, "shopify", True, []), (2, "mixpanel", True, ["a"]), (3, "amplitude", False, ["c"])]
    history = hub.config_history(manifest)
    assert ("shopify", "orders", '{"x":1}') in rows(history, "source_name", "table_name", "table_logic")


def test_injected_configuration_replaces_the_manifest(spark):
    base = local_frame(spark, [("t0", '{"shopify": {"enabled": true}}'), ("t1", "{}")], "tenant_slug string, sources_config string")
    injected = local_frame(spark, [("t0", '{"mixpanel": {"enabled": true}}')], "tenant_slug string, sources_config string")
    assert rows(tenant_sources(base, injected), "tenant_slug", "source") == [("t0", "mixpanel")]


def test_snapshots_keep_the_previous_version_readable(spark):
    path = scratch_path(spark, "snap")
    schema = "a bigint"
    assert sinks.read_current(spark, path, HUB).count() == 0
    sinks.overwrite_current(local_frame(spark, [(1,), (2,)], schema), path)
    sinks.overwrite_current(sinks.read_current(spark, path).filter("a > 1"), path)
    assert rows(sinks.read_current(spark, path), "a") == [(2,)]
