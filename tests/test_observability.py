import random
import re

from pyspark.sql import functions as F

from tests.conftest import plan_of, rows
from tributary.operators import observability as obs
from tributary.schemas import RUN_RESULTS
from tributary.session import scratch_path
from tributary.sources.local import local_frame
from tributary.streaming.run_stream import compact, current_runs, fold_runs
from tributary.sources.sinks import read_current


def like(pattern: str, text: str) -> bool:
    return re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text) is not None


def run(node, second, status="success", kind="model", invocation="i"):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 0, 0, second, tzinfo=dt.timezone.utc)
    return (invocation, node, node, kind, status, None, 1, 0.5, at, at, at)


def test_newest_row_per_key_and_upsert(spark):
    first = obs.stage_run_results(local_frame(spark, [run("a", 1, "fail"), run("a", 2), run("b", 1)], RUN_RESULTS))
    assert rows(first, "node_id", "run_result_status", "dlt_load_id") == [("a", "success", "manual_run"), ("b", "success", "manual_run")]
    both = obs.stage_run_results(local_frame(spark, [run("b", 5, "error")], RUN_RESULTS), first)
    assert rows(both, "node_id", "run_result_status") == [("a", "success"), ("b", "error")]
    assert "WindowGroupLimit" in plan_of(first)  # many rows of one key are cut before the shuffle


def test_high_water_mark_on_an_empty_target(spark):
    staged = obs.stage_run_results(local_frame(spark, [run("a", 1), run("b", 2), run("c", 2, kind="test")], RUN_RESULTS))
    empty = obs.run_results_incremental(staged.limit(0))
    assert rows(obs.run_results_incremental(staged, empty), "node_id") == [("a",), ("b",)]
    loaded = obs.run_results_incremental(staged.filter("node_id = 'a'"))
    assert rows(obs.run_results_incremental(staged, loaded), "node_id") == [("b",)]
    assert rows(obs.test_results_incremental(staged), "node_id") == [("c",)]


def test_run_log_is_independent_of_delivery_order(spark):
    old, new = local_frame(spark, [run("a", 1, "fail")], RUN_RESULTS), local_frame(spark, [run("a", 9)], RUN_RESULTS)
    for order in ((old, new), (new, old, old)):
        log, snap = scratch_path(spark, "log"), scratch_path(spark, "snap")
        for batch in order:
            fold_runs(log, batch)
        assert rows(current_runs(spark, log), "node_id", "run_result_status") == [("a", "success")]
        compact(spark, log, snap)
        assert read_current(spark, snap).count() == 1


def test_tenants_by_longest_slug(spark):
    nodes = local_frame(spark, [("fct_acme_corp__orders",), ("fct_acme__orders",), ("fct_zzz__orders",), (None,)], "node_name string")
    tenants = local_frame(spark, [("acme",), ("acme_corp",), ("",), (None,)], "tenant_slug string")
    got = rows(obs.tenant_of_nodes(nodes, tenants))
    assert got == [("fct_acme__orders", "acme"), ("fct_acme_corp__orders", "acme_corp")]
    assert "NestedLoop" not in plan_of(obs.tenant_of_nodes(nodes, tenants))


def test_lineage_pattern_against_like(spark):
    rng = random.Random(3)
    pieces = ["stg", "_", "__", "t0", "ads", "x", "ad_sets", "campaigns", "_a"]
    nodes = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"stg_t0__fb_ads", "stgX1zz1ads"})
    objects = ["ads", "ad_sets", "campaigns", "x_", "a"]
    frame = local_frame(spark, [(n,) for n in nodes], "node_name string")
    registry = local_frame(spark, [(o,) for o in objects + ["ads"]], "source_table_name string")
    df = obs.lineage_matches(frame, registry)
    want = sorted((n, o) for n in nodes for o in objects if like("stg_%__" + o, n))
    assert rows(df) == sorted(want, key=repr) and want
    assert "NestedLoop" not in plan_of(df) and "CartesianProduct" not in plan_of(df)


def test_discovered_assets_against_like(spark):
    rng = random.Random(5)
    slugs = ["a_b", "acb", "a", "zz", "a_b_c"]
    tables = sorted({("".join(rng.choice("abcz_") for _ in range(rng.randint(1, 7)))) for _ in range(200)})
    inventory = local_frame(spark, [("db", rng.choice([*slugs, "other"]), t) for t in tables], "project_id string, source_schema string, source_table string")
    tenants = local_frame(spark, [(s, "active") for s in slugs], "tenant_slug string, status string")
    df = obs.discovered_assets(inventory, tenants)
    placed = rows(inventory, "source_schema", "source_table")
    want = [(s, schema, t) for s in slugs for schema, t in placed if schema == s or like(s + "_%", t)]
    assert rows(df, "client_slug", "source_schema", "source_table") == sorted(want, key=repr)
    assert "NestedLoop" not in plan_of(df)


def test_invalid_json_becomes_null(spark):
    df = local_frame(spark, [("[1]",), ("[1",), ("",), (None,)], "t string")
    assert sorted(r[0] or "" for r in df.select(obs.valid_json(F.col("t"))).collect()) == ["", "", "", "[1]"]


def test_summary_of_tenants_without_times(spark):
    schema = "tenant_slug string, model_name string, status string, execution_time_seconds double, run_started_at timestamp"
    df = local_frame(spark, [("t0", "m", "skipped", None, None), ("t0", "m", "success", None, None)], schema)
    got = rows(obs.obs_summary(df, "t0"), "models_count", "pass_count", "skip_count", "avg_execution_time")
    assert got == [(1, 1, 1, 0.0)]


def test_a_batch_started_before_a_compaction_and_committed_after_is_read(spark):
    from tributary.streaming.run_stream import commit_runs, stage_runs

    log, snap = scratch_path(spark, "log"), scratch_path(spark, "snap")
    slow = local_frame(spark, [run("a", 1, "fail"), run("c", 3)], RUN_RESULTS)
    fast = local_frame(spark, [run("b", 2)], RUN_RESULTS)
    stage_runs(log, slow, "writer1-00000000000000000007")  # writer 1 starts first
    fold_runs(log, fast, query="writer2", batch_id=3)  # writer 2 commits
    compact(spark, log, snap)  # the snapshot lists writer 2's batch only
    assert rows(current_runs(spark, log, snap), "node_id") == [("b",)]
    assert commit_runs(spark, log, "writer1-00000000000000000007")  # writer 1 commits late
    assert rows(current_runs(spark, log, snap), "node_id") == [("a",), ("b",), ("c",)]
    compact(spark, log, snap)
    assert rows(current_runs(spark, log, snap), "node_id") == [("a",), ("b",), ("c",)]


def test_a_replayed_micro_batch_is_folded_once(spark):
    log = scratch_path(spark, "log")
    batch = local_frame(spark, [run("a", 1)], RUN_RESULTS)
    fold_runs(log, batch, query="q", batch_id=1)
    fold_runs(log, batch, query="q", batch_id=1)
    assert spark.read.parquet(log).count() == 1
