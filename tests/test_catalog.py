import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, rows
from tributary.operators import catalog
from tributary.schemas import COLUMNS
from tributary.sources.local import local_frame

ROLES = [
    ("source_platform", "VARCHAR", "dimension"),
    ("order_date", "DATE", "dimension"),
    ("is_conversion_session", "BOOLEAN", "dimension"),
    ("spend", "DOUBLE", "measure"),
    ("total_price", "FLOAT", "measure"),
    ("campaign_id", "BIGINT", "dimension"),
    ("campaign_key", "BIGINT", "dimension"),
    ("session_start_ts", "BIGINT", "dimension"),
    ("total_clicks", "BIGINT", "measure"),
    ("count_sessions", "BIGINT", "measure"),
    ("funnel_step_1_session_start", "BIGINT", "measure"),
    ("mystery", "INTEGER", "measure"),
    ("blobby", "UUID", "dimension"),
    ("line_items_json", "JSON", "skip"),
    ("tenant_slug", "VARCHAR", "skip"),
]


def columns(spark, entries):
    """(table_type, subject, column, type) rows for one tenant."""
    made, seen = [], {}
    for kind, subject, name, data_type in entries:
        seen[subject] = seen.get(subject, 0) + 1
        prefix = "fct" if kind == "fact" else "dim"
        made.append(("t0", kind, subject, f"{prefix}_t0__{subject}", name, data_type, seen[subject]))
    return local_frame(spark, made, COLUMNS)


def test_roles(spark):
    df = local_frame(spark, [r[:2] for r in ROLES], "n string, t string")
    role = catalog.semantic_role(F.col("n"), F.col("t"))
    got = {r["n"]: r["role"] for r in df.select("n", role.alias("role")).collect()}
    assert got == {name: role for name, _, role in ROLES}


@pytest.mark.parametrize(
    ("name", "agg"),
    [("session_duration_seconds", "avg"), ("avg_order", "avg"), ("order_id", "count_distinct"), ("spend", "sum"),
     ("count_sessions", "sum"), ("events_in_session", "sum"), ("count_id", "sum")],
)
def test_aggregations(spark, name, agg):
    df = local_frame(spark, [(name,)], "n string")
    assert df.select(catalog.inferred_agg(F.col("n"), F.lit("measure"))).first()[0] == agg
    assert df.select(catalog.inferred_agg(F.col("n"), F.lit("dimension"))).first()[0] is None


def test_funnel_columns_are_not_times(spark):
    df = local_frame(spark, [("funnel_step_1_session_start",), ("session_start",)], "n string")
    picked = df.filter(catalog.is_time_dimension(F.col("n"), F.lit("BIGINT")))
    assert rows(picked) == [("session_start",)]
    assert rows(df.select("n", catalog.bsl_type(F.col("n"), F.lit("BIGINT"))))[0][1] == "number"


def test_calculated_measures_need_all_columns(spark):
    df = columns(spark, [("fact", "ads", "clicks", "BIGINT"), ("fact", "ads", "spend", "DOUBLE")])
    assert rows(catalog.infer_calc_measures(df), "name") == [("cpc",)]


def test_joins_prefer_ids_by_dimension_order(spark):
    df = columns(
        spark,
        [("fact", "sessions", "device_category", "VARCHAR"), ("fact", "sessions", "user_id", "VARCHAR"),
         ("fact", "sessions", "user_pseudo_id", "VARCHAR"), ("fact", "ads", "campaign_name", "VARCHAR"),
         ("fact", "ads", "a_name", "VARCHAR"), ("fact", "lonely", "x", "BIGINT"),
         ("dimension", "users", "source_platform", "VARCHAR"), ("dimension", "users", "user_pseudo_id", "VARCHAR"),
         ("dimension", "users", "user_id", "VARCHAR"), ("dimension", "users", "device_category", "VARCHAR"),
         ("dimension", "campaigns", "campaign_name", "VARCHAR"), ("dimension", "campaigns", "a_name", "VARCHAR")],
    )
    got = rows(catalog.infer_joins(df), "subject", "to", "left_on")
    assert got == [("ads", "campaigns", "a_name"), ("sessions", "users", "user_pseudo_id")]


@pytest.mark.parametrize(
    ("name", "derived"),
    [("session_start_ts", "session_start_date"), ("event_timestamp", "event_date"), ("first_seen_at", "first_seen_at_date")],
)
def test_derived_date_names(spark, name, derived):
    df = local_frame(spark, [(name,)], "n string")
    assert df.select(catalog.derived_date_name(F.col("n"))).first()[0] == derived


def test_count_measures_do_not_replace_columns(spark):
    df = columns(spark, [("fact", "s", "session_id", "VARCHAR"), ("fact", "s", "total_sessions", "BIGINT"), ("fact", "s", "bus_id", "VARCHAR"), ("dimension", "d", "x_id", "VARCHAR")])
    assert rows(catalog.auto_count_measures(df), "measure_name") == [("total_bus",)]


def test_overlay_dimension_beats_measure_and_joins_replace(spark):
    df = catalog.classify(columns(spark, [("fact", "s", "spend", "DOUBLE"), ("fact", "s", "day", "VARCHAR")]))
    overlay = local_frame(
        spark,
        [("t0", "fct_t0__s", "day", "dimension", "date", None), ("t0", "fct_t0__s", "spend", "measure", None, "max")],
        catalog.OVERLAY_COLUMNS,
    )
    got = rows(catalog.column_metadata(df, overlay), "column_name", "bsl_type", "is_time_dimension", "agg")
    assert got == [("day", "date", True, None), ("spend", "number", False, "max")]


def test_readiness_of_an_unknown_tenant(spark):
    empty = local_frame(spark, [], "tenant_slug string, table_name string")
    manifest = local_frame(spark, [("a", "active"), ("b", "onboarding"), ("c", "new")], "tenant_slug string, status string")
    states = catalog.readiness(manifest, empty, empty)
    assert rows(states, "tenant_slug", "status") == [("a", "cataloging"), ("b", "modeling"), ("c", "starting")]
    assert rows(catalog.tenant_readiness(states, "zzz"), "is_ready", "status") == [(False, "error")]


def test_star_catalog_drops_names_without_tenant(spark):
    names = ["fct_t0__orders", "fctXt1__orders", "dim_a_b__users", "fct_orders", "stg_x__y"]
    df = local_frame(spark, [(n,) for n in names], "table_name string")
    got = rows(catalog.star_catalog(df), "table_name", "tenant_slug", "table_type", "subject")
    assert got == [("dim_a_b__users", "a_b", "dimension", "users"), ("fct_t0__orders", "t0", "fact", "orders")]


def test_sides_that_follow_the_tables_are_never_broadcast(spark, tmp_path):
    """Columns exploded from a small file are planned by the size of that file."""
    tenants = tmp_path / "tenants"
    spark.range(1000).write.parquet(str(tenants))
    name = F.concat(F.lit("fct_c"), F.col("id").cast("string"), F.lit("__sessions")).alias("table_name")
    stored = spark.read.parquet(str(tenants))
    tables = stored.select(name)
    made = stored.select(name, F.posexplode(F.array(F.lit("a_id"), F.lit("b"))).alias("ordinal_position", "column_name"))
    made = made.select("*", F.lit("VARCHAR").alias("data_type"))
    semantic = catalog.semantic_tables(tables, made)
    tenant = F.concat(F.lit("c"), F.col("id").cast("string")).alias("tenant_slug")
    overlay = stored.select(
        tenant, name, F.lit("b").alias("column_name"), F.lit("measure").alias("kind"),
        F.lit(None).cast("string").alias("type"), F.lit("max").alias("agg"),
    )
    labels = stored.select(tenant, name, F.lit("L").alias("label"), F.lit("").alias("description"))
    fields = catalog.column_metadata(catalog.column_catalog(semantic), overlay, labels)
    joins = stored.select(
        tenant, name, name.alias("to_table"), F.lit("left").alias("type"), F.lit("b").alias("left_on"), F.lit("b").alias("right_on")
    )
    merged = catalog.merge_joins(catalog.infer_joins(catalog.flatten_manifest(semantic)), joins)
    for frame in (semantic, fields, merged):
        assert "BroadcastHashJoin" not in plan_of(frame)
    assert fields.filter("column_name = 'b' AND agg = 'max' AND label = 'L'").count() == 1000


def stored_catalogue(spark, path):
    """1,000 tenants with a sessions and a users table, exploded from a small stored file."""
    spark.range(1000).write.parquet(str(path))
    ids = spark.read.parquet(str(path)).select("id", F.explode(F.array(F.lit("fct_sessions"), F.lit("dim_users"))).alias("k"))
    kind = F.split("k", "_")
    name = F.concat(kind[0], F.lit("_c"), F.col("id").cast("string"), F.lit("__"), kind[1]).alias("table_name")
    wide = F.array(*map(F.lit, ("user_id", "clicks", "impressions", "start_ts")))
    made = ids.select(name, F.posexplode(wide).alias("ordinal_position", "column_name"))
    kinds = F.when(F.col("column_name") == "user_id", "VARCHAR").otherwise("BIGINT").alias("data_type")
    return catalog.semantic_tables(ids.select(name), made.select("*", kinds))


def hashed(df):
    plan = plan_of(df)
    return plan.count("BroadcastHashJoin") + plan.count("ShuffledHashJoin")


def test_model_details_hash_no_side_in_memory(spark, tmp_path):
    semantic = stored_catalogue(spark, tmp_path / "t")
    flat = catalog.flatten_manifest(semantic)
    details = catalog.model_details(
        catalog.column_metadata(catalog.column_catalog(semantic)), catalog.infer_calc_measures(flat), catalog.infer_joins(flat)
    )
    assert hashed(details) == 0
    got = {r["subject"]: r for r in details.filter("tenant_slug = 'c7'").collect()}
    assert [d["name"] for d in got["sessions"]["dimensions"]] == ["user_id", "start_ts", "start_date"]
    assert [m["name"] for m in got["sessions"]["measures"]] == ["clicks", "impressions", "total_users"]
    assert [c["name"] for c in got["sessions"]["calculated_measures"]] == ["ctr"]
    assert [j["to"] for j in got["sessions"]["joins"]] == ["users"]
    assert got["users"]["joins"] is None
    assert details.count() == 2000


def test_count_measures_and_dates_hash_no_side_in_memory(spark, tmp_path):
    fields = catalog.column_metadata(catalog.column_catalog(stored_catalogue(spark, tmp_path / "t")))
    assert hashed(fields) == 0
    got = rows(fields.filter("tenant_slug = 'c7' AND subject = 'sessions'"), "column_name", "role", "source_column", "position")
    assert got == [
        ("clicks", "measure", None, 2), ("impressions", "measure", None, 4), ("start_date", "dimension", "start_ts", 7),
        ("start_ts", "dimension", None, 6), ("total_users", "measure", "user_id", 10_000), ("user_id", "dimension", None, 0),
    ]


def test_only_overlays_are_hashed(spark, tmp_path):
    """Of the sides of overlaid metadata only the overlay's columns and its labels."""
    semantic = stored_catalogue(spark, tmp_path / "t")
    chosen = [("c7", "fct_c7__sessions")]
    overlay = local_frame(spark, [(*c, "start_ts", "dimension", "timestamp", None) for c in chosen], catalog.OVERLAY_COLUMNS)
    labels = local_frame(spark, [(*c, "Visits", "") for c in chosen], catalog.OVERLAY_TABLES)
    fields = catalog.column_metadata(catalog.column_catalog(semantic), overlay, labels)
    assert hashed(fields) == 2
    picked = fields.filter("tenant_slug IN ('c7', 'c8') AND source_column IS NOT NULL OR column_name = 'start_ts'")
    got = rows(picked.filter("tenant_slug IN ('c7', 'c8') AND subject = 'sessions'"), "tenant_slug", "column_name", "bsl_type", "label")
    assert got == [
        ("c7", "start_date", "date", "Visits"), ("c7", "start_ts", "timestamp", "Visits"), ("c7", "total_users", "number", "Visits"),
        ("c8", "start_date", "date", "Sessions"), ("c8", "start_ts", "timestamp_epoch", "Sessions"), ("c8", "total_users", "number", "Sessions"),
    ]


def test_listed_models_hash_no_side_and_need_no_sort_of_fields(spark, tmp_path):
    semantic = stored_catalogue(spark, tmp_path / "t")
    flat = catalog.flatten_manifest(semantic)
    listed = catalog.list_models(catalog.column_metadata(catalog.column_catalog(semantic)), catalog.infer_joins(flat))
    assert hashed(listed) == 0
    assert rows(listed.filter("tenant_slug = 'c7'")) == [
        ("c7", "sessions", "Sessions", "Fact: sessions", 3, 3, True), ("c7", "users", "Users", "Dimension: users", 3, 2, False),
    ]
    assert listed.count() == 2000


def test_a_model_without_subject_has_no_joins(spark):
    fields = local_frame(
        spark, [("a", None, "l", "d", "measure"), ("a", "s", None, "d", "dimension")],
        "tenant_slug string, subject string, label string, description string, role string",
    )
    joins = local_frame(spark, [("a", None), ("a", "s"), ("b", "s")], "tenant_slug string, subject string")
    got = rows(catalog.list_models(fields, joins))
    assert got == [("a", "s", None, "d", 1, 0, True), ("a", None, "l", "d", 0, 1, False)]


def test_listings_hash_no_side_in_memory(spark, tmp_path):
    fields = catalog.column_metadata(catalog.column_catalog(stored_catalogue(spark, tmp_path / "t")))
    dims, measures = catalog.dimension_listing(fields), catalog.measure_listing(fields)
    assert hashed(dims) + hashed(measures) == 0
    assert (dims.count(), measures.count()) == (6000, 5000)


def test_names_are_taken_by_columns_of_the_same_known_table_only(spark):
    ids = [("a", "fact", "s", "fct_a__s", "x_id", "VARCHAR", 1), (None, "fact", "s", "f", "x_id", "VARCHAR", 1)]
    takers = [("a", "fact", "s", "fct_a__t", "total_xs", "BIGINT", 2), (None, "fact", "s", "f", "total_xs", "BIGINT", 2)]
    made = local_frame(spark, [*ids, *ids, *takers], COLUMNS)
    got = rows(catalog.auto_count_measures(made), "tenant_slug", "measure_name", "source_column")
    assert got == [("a", "total_xs", "x_id")] * 2 + [(None, "total_xs", "x_id")] * 2


def test_merged_joins_and_measures_hash_no_side_in_memory(spark, tmp_path):
    flat = catalog.flatten_manifest(stored_catalogue(spark, tmp_path / "t"))
    table = ("c7", "fct_c7__sessions")
    calcs = local_frame(spark, [(*table, n, n, "SUM(clicks)", "number") for n in ("ctr", "extra")], catalog.OVERLAY_CALCS)
    joins = local_frame(spark, [(*table, "dim_c7__users", "left", "other_id", "other_id")], catalog.OVERLAY_JOINS)
    merged = catalog.merge_joins(catalog.infer_joins(flat), joins)
    measures = catalog.merge_calc_measures(catalog.infer_calc_measures(flat), calcs)
    assert hashed(merged) + hashed(measures) == 0
    assert rows(merged.filter("tenant_slug IN ('c7', 'c8')"), "tenant_slug", "to", "left_on") == [
        ("c7", "users", "other_id"), ("c8", "users", "user_id"),
    ]
    assert rows(measures.filter("tenant_slug = 'c7'"), "subject", "name") == [("sessions", "ctr"), ("sessions", "extra"), ("users", "ctr")]


def test_unknown_names_meet_no_manifest_and_no_join(spark):
    tables = local_frame(spark, [(None, "fct_a__s"), ("m", "fct_b__s"), ("m", "fct_b__s")], "table_schema string, table_name string")
    shape = "table_schema string, table_name string, column_name string, data_type string, ordinal_position int"
    made = [(None, "fct_a__s", "x", "VARCHAR", 1), ("m", "fct_b__s", "x", "VARCHAR", 1), ("m", None, "x", "VARCHAR", 1)]
    got = rows(catalog.semantic_tables(tables, local_frame(spark, made, shape)), "tenant_slug", "semantic_manifest")
    one = '[{"column_name":"x","data_type":"VARCHAR","ordinal_position":1}]'
    assert got == [("a", None), ("b", one), ("b", one)] or got == [("b", one), ("b", one), ("a", None)]
    flat = local_frame(spark, [(None, k, s, t, "x", "VARCHAR", 1) for k, s, t in (("fact", "s", "f"), ("dimension", "d", "d"))], COLUMNS)
    assert catalog.infer_joins(flat).count() == 0
