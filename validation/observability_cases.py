"""Cases for run, model and test artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tributary.operators import dashboard, observability as obs
from tributary.operators.users import users
from tributary.sources.connectors import connector_catalog
from validation import inputs as src, sqltext as sql
from validation.case import case
from validation.hub_cases import CATALOG, INVENTORY, early, hub, late, inventory_tables, manifest
from validation.star_cases import ga_star_events, rounded, users_sql
from tributary.sources.raw import tenant_inventory

_STAGED = f"""{sql.RUNS},
staged AS (SELECT *, 'manual_run' AS dlt_load_id FROM (SELECT *, row_number() OVER (PARTITION BY invocation_id, node_id
  ORDER BY run_started_at DESC, extracted_at DESC, status, node_name) AS rn FROM runs) WHERE rn = 1)"""


def staged(spark, sf) -> DataFrame:
    return obs.stage_run_results(src.run_results(spark, sf))


def seconds(column: str):
    return F.unix_seconds(column).alias(column)


_ES = "CAST(epoch({0}) AS BIGINT) AS {0}"


@case(
    "obs_1_stage_run_results",
    f"""WITH {_STAGED} SELECT invocation_id, dlt_load_id, node_id, node_name, resource_type, status AS run_result_status, message AS run_result_message,
    rows_affected, round(execution_time_seconds, 7) AS execution_time_seconds, {_ES.format('run_started_at')}, {_ES.format('run_completed_at')}, {_ES.format('extracted_at')} FROM staged""",
)
def obs_1(spark, sf):
    """Staged in two loads: the second one re-sends a year that is already there."""
    runs = src.run_results(spark, sf)
    first = obs.stage_run_results(runs.filter("year(run_started_at) <= 1997"))
    both = obs.stage_run_results(runs.filter("year(run_started_at) >= 1997"), first)
    kept = [c for c in both.columns if c not in ("run_started_at", "run_completed_at", "extracted_at")]
    result = both.select(*kept, seconds("run_started_at"), seconds("run_completed_at"), seconds("extracted_at"))
    return rounded(result, execution_time_seconds=7)


_MARK = "run_started_at > TIMESTAMP '1997-12-31 23:59:59'"


@case(
    "obs_2_run_results_incremental",
    f"WITH {_STAGED}, old AS (SELECT max(run_started_at) AS m FROM staged WHERE resource_type IN ('model', 'seed', 'snapshot') AND run_started_at < TIMESTAMP '1998-01-01') SELECT invocation_id, node_id, status AS run_result_status, {_ES.format('run_started_at')} FROM staged, old WHERE resource_type IN ('model', 'seed', 'snapshot') AND run_started_at > m",
)
def obs_2(spark, sf):
    rows = staged(spark, sf)
    loaded = obs.run_results_incremental(rows.filter("run_started_at < timestamp'1998-01-01'"))
    fresh = obs.run_results_incremental(rows, loaded)
    return fresh.select("invocation_id", "node_id", "run_result_status", seconds("run_started_at"))


@case(
    "obs_3_test_results_incremental",
    f"WITH {_STAGED} SELECT invocation_id, node_id, node_name, status AS test_status, message AS test_message, {_ES.format('run_started_at')} FROM staged WHERE resource_type = 'test'",
)
def obs_3(spark, sf):
    rows = obs.test_results_incremental(staged(spark, sf))
    return rows.select("invocation_id", "node_id", "node_name", "test_status", "test_message", seconds("run_started_at"))


@case(
    "obs_4_freshness_results",
    f"""WITH {_STAGED} SELECT md5(invocation_id || '-' || node_id) AS dbt_freshness_result_skey, md5(node_id) AS dbt_source_key, strftime(run_started_at, '%Y-%m-%d') AS freshness_date,
    split_part(node_id, '.', 3) AS source_name, split_part(node_id, '.', 4) AS source_table, status AS freshness_status, {_ES.format('extracted_at')} FROM staged WHERE resource_type = 'FRESHNESS'""",
)
def obs_4(spark, sf):
    rows = obs.freshness_results(staged(spark, sf))
    return rows.select(
        "dbt_freshness_result_skey", "dbt_source_key", F.date_format("freshness_date", "yyyy-MM-dd").alias("freshness_date"),
        "source_name", "source_table", "freshness_status", F.unix_seconds("generated_at").alias("extracted_at"),
    )


def model_artifacts(spark, sf) -> DataFrame:
    part = src.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    return part.select(
        F.lit("inv").alias("invocation_id"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "source.").otherwise("model."), F.lit("proj.s"), key).alias("node_id"),
        F.concat(F.lit("raw_s"), key, F.lit("_shopify_orders")).alias("model_name"),
        F.col("p_name").alias("description"), F.lit("table").alias("materialization"),
        F.concat(F.lit("s"), key).alias("schema_name"), F.lit("[]").alias("tags"),
        F.when(F.col("p_size") > 10, F.concat(F.lit('{"owner":"'), F.col("p_brand"), F.lit('"}'))).otherwise("{}").alias("meta"),
        F.concat(F.lit('{"materialization":"'), F.lower("p_type"), F.lit('"}')).alias("config"),
        F.lit("[]").alias("depends_on_nodes"), early().alias("extracted_at"),
    )


MODELS = """
models AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'source.' ELSE 'model.' END || 'proj.s' || p_partkey AS node_id, 'raw_s' || p_partkey || '_shopify_orders' AS model_name,
  's' || p_partkey AS schema_name, CASE WHEN p_size > 10 THEN p_brand END AS owner, lower(p_type) AS kind FROM part)"""


@case(
    "obs_5_model_definitions",
    f"WITH {MODELS} SELECT node_id AS model_node_id, model_name, schema_name AS configured_schema, owner AS model_owner, kind AS config_materialization FROM models",
)
def obs_5(spark, sf):
    rows = obs.stage_model_definitions(model_artifacts(spark, sf))
    return rows.select("model_node_id", "model_name", "configured_schema", "model_owner", "config_materialization")


@case(
    "obs_6_test_definitions",
    """SELECT 'inv' || (p_partkey % 4) AS invocation_id, 'test.' || p_partkey AS test_node_id, p_name AS test_name,
    CASE WHEN p_partkey % 3 <> 0 THEN '["' || p_brand || '"]' END AS tags_json, CASE WHEN p_partkey % 2 = 0 THEN '{"size":' || p_size || '}' END AS test_metadata_json FROM part""",
)
def obs_6(spark, sf):
    key = F.col("p_partkey").cast("string")
    tests = src.table(spark, sf, "part").select(
        F.concat(F.lit("inv"), (F.col("p_partkey") % 4).cast("string")).alias("invocation_id"),
        F.concat(F.lit("test."), key).alias("node_id"), F.col("p_name").alias("test_name"), F.lit("generic").alias("test_type"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit('["'), "p_brand", F.lit('"]'))).otherwise("[broken").alias("tags"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"size":'), F.col("p_size").cast("string"), F.lit("}"))).otherwise("").alias("test_metadata"),
        F.lit("[]").alias("target_model_ids"), early().alias("extracted_at"),
    )
    old = obs.stage_test_definitions(tests.withColumn("test_name", F.lit("old")))
    rows = obs.stage_test_definitions(tests, old)
    return rows.select("invocation_id", "test_node_id", "test_name", "tags_json", "test_metadata_json")


def tenant_list(spark, sf) -> DataFrame:
    """Three tenants named in the nodes plus one per supplier that is not."""
    named = src.events_base(spark, sf).select("tenant_slug").distinct()
    return named.unionByName(src.table(spark, sf, "supplier").select(F.lower("s_name").alias("tenant_slug")))


_TENANT = "regexp_extract(node_name, '(t[0-2])__', 1)"


@case(
    "obs_7_tenant_run_results",
    f"""WITH {_STAGED} SELECT {_TENANT} AS tenant_slug, node_name AS model_name, status, rows_affected, {_ES.format('run_started_at')}, dlt_load_id
    FROM staged WHERE resource_type IN ('model', 'seed', 'snapshot')""",
)
def obs_7(spark, sf):
    runs = obs.run_results_incremental(staged(spark, sf))
    rows = obs.tenant_run_results(runs, tenant_list(spark, sf))
    return rows.select("tenant_slug", "model_name", "status", "rows_affected", seconds("run_started_at"), "dlt_load_id")


@case(
    "obs_8_tenant_test_results",
    f"WITH {_STAGED} SELECT {_TENANT} AS tenant_slug, node_name AS test_name, status, message, {_ES.format('run_started_at')} FROM staged WHERE resource_type = 'test'",
)
def obs_8(spark, sf):
    tests = obs.test_results_incremental(staged(spark, sf))
    rows = obs.tenant_test_results(tests, tenant_list(spark, sf))
    return rows.select("tenant_slug", "test_name", "status", "message", seconds("run_started_at"))


@case(
    "obs_9_lineage_summary",
    f"""WITH {_STAGED}, {CATALOG} SELECT dlt_load_id, node_name AS dbt_model, status AS run_result_status, source_name AS connector_type, source_table_name, {_ES.format('run_started_at')}
    FROM staged JOIN catalog ON node_name LIKE 'stg_%__' || source_table_name WHERE resource_type IN ('model', 'seed', 'snapshot')""",
)
def obs_9(spark, sf):
    registry = connector_catalog(spark).select(
        F.col("source_name").alias("source_platform"), "source_table_name", early().alias("registered_at")
    )
    rows = obs.lineage_summary(obs.run_results_incremental(staged(spark, sf)), registry)
    return rows.select(
        "dlt_load_id", "dbt_model", "run_result_status", "connector_type", "source_table_name", seconds("run_started_at")
    )


_IDENTITY = f"""WITH {sql.GA}, {sql.GA_EVENTS}, {sql.ORDERS}, {users_sql('ga_events', False)},
stats AS (SELECT 'manual_run' AS dlt_load_id, tenant_slug, count(*) AS total_users, count(*) FILTER (WHERE is_customer) AS resolved_customers,
  count(*) FILTER (WHERE NOT is_customer) AS anonymous_users, round(CAST(count(*) FILTER (WHERE is_customer) AS DOUBLE) / count(*) * 100, 2) AS identity_resolution_rate,
  CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(total_sessions) AS BIGINT) AS total_sessions FROM users GROUP BY 2)"""


def identity(spark, sf) -> DataFrame:
    return obs.identity_stats(users(ga_star_events(spark, sf), src.orders(spark, sf)))


@case("obs_10_identity_stats", f"{_IDENTITY} SELECT * FROM stats")
def obs_10(spark, sf):
    return identity(spark, sf)


_HEALTH = """
health AS (SELECT 's' || s_suppkey AS source_name, 'raw_s' || s_suppkey || '_shopify_orders' AS source_table, CASE s_nationkey % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'pass' ELSE 'error' END AS freshness_status
  FROM supplier WHERE s_acctbal < 7000)"""


def health(spark, sf) -> DataFrame:
    """Two checks per table, the newer one counts."""
    nation = F.col("s_nationkey") % 3
    newer = F.when(nation == 0, "warn").when(nation == 1, "pass").otherwise("error")
    checks = F.array(
        F.struct(F.lit("runtime error").alias("s"), early().alias("at")), F.struct(newer.alias("s"), late().alias("at"))
    )
    slug = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    return src.table(spark, sf, "supplier").filter("s_acctbal < 7000").select(
        slug.alias("source_name"), F.concat(F.lit("raw_"), slug, F.lit("_shopify_orders")).alias("source_table"), F.explode(checks).alias("c")
    ).select("source_name", "source_table", F.col("c.s").alias("freshness_status"), F.col("c.at").alias("generated_at"))


_CANDIDATES = f"""{INVENTORY}, {MODELS}, {_HEALTH}, tenants AS (SELECT 's' || s_suppkey AS tenant_slug, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'onboarding' END AS status FROM supplier),
candidates AS (SELECT t.tenant_slug AS client_slug, t.status AS tenant_status, i.source_schema, i.source_table, i.source_schema = 'landing' AS dated,
    CASE WHEN m.node_id IS NOT NULL THEN 'true' ELSE 'false' END AS integrated_flag, h.freshness_status AS dbt_freshness_status,
    CASE WHEN m.node_id IS NOT NULL AND h.freshness_status IN ('warn', 'error') THEN 'Integrated - Stale/Failing'
      WHEN m.node_id IS NULL AND i.source_schema = 'landing' THEN 'Strong Candidate - Active' ELSE 'Neutral' END AS candidate_priority_score
  FROM tenants t JOIN inventory i ON i.source_schema = t.tenant_slug OR i.source_table LIKE t.tenant_slug || '_%'
  LEFT JOIN models m ON m.node_id LIKE 'source.%' AND i.source_schema = m.schema_name AND i.source_table = m.model_name
  LEFT JOIN health h ON i.source_schema = h.source_name AND i.source_table = h.source_table)"""


def candidates(spark, sf) -> DataFrame:
    """Only landing tables have a creation time."""
    tables = tenant_inventory(inventory_tables(spark, sf)).withColumn(
        "created_at", F.when(F.col("source_schema") == "landing", early())
    )
    definitions = obs.model_definitions(obs.stage_model_definitions(model_artifacts(spark, sf)))
    return obs.candidate_map(tables, manifest(spark, sf), definitions, health(spark, sf))


@case("obs_11_candidate_map", f"WITH {_CANDIDATES} SELECT * FROM candidates")
def obs_11(spark, sf):
    return candidates(spark, sf).withColumn("dated", F.col("created_at").isNotNull()).drop("created_at")


@case(
    "obs_12_candidate_registry",
    f"""WITH {_CANDIDATES}, cfg AS (SELECT 's' || s_suppkey AS slug, s FROM supplier, (VALUES ('shopify'), ('shopify'), ('facebook_ads')) v(s))
    SELECT client_slug, source_schema, source_table, integrated_flag, dbt_freshness_status, candidate_priority_score,
    CASE WHEN candidate_priority_score = 'Strong Candidate - Active' AND integrated_flag = 'false' THEN 'ONBOARD'
      WHEN candidate_priority_score = 'Integrated - Stale/Failing' THEN 'INVESTIGATE SWAP' ELSE 'MONITOR' END AS recommended_action
    FROM candidates LEFT JOIN cfg ON client_slug = slug AND source_schema = s WHERE tenant_status IN ('pending', 'enabled', 'onboarding')""",
)
def obs_12(spark, sf):
    history = hub.config_history(manifest(spark, sf))
    return obs.candidate_registry(candidates(spark, sf), history, ordered=True).drop("created_at")


@case(
    "obs_13_semantic_readiness",
    f"""WITH {_STAGED}, r AS (SELECT node_name, status, row_number() OVER (PARTITION BY node_name ORDER BY run_started_at DESC, status) AS rn FROM staged WHERE resource_type IN ('model', 'seed', 'snapshot')),
    c AS (SELECT DISTINCT 't' || (o_orderkey % 6) AS tenant_slug FROM orders)
    SELECT c.tenant_slug, 'orders' AS subject, CASE WHEN r.node_name IS NOT NULL THEN 'manual_run' END AS dlt_load_id, coalesce(r.status = 'success', false) AS is_semantic_layer_ready, r.status AS last_dbt_status
    FROM c LEFT JOIN r ON r.node_name = 'fct_' || c.tenant_slug || '__orders' AND rn = 1""",
)
def obs_13(spark, sf):
    slug = F.concat(F.lit("t"), (F.col("o_orderkey") % 6).cast("string"))
    models = src.table(spark, sf, "orders").select(
        slug.alias("tenant_slug"), F.lit("orders").alias("subject"), F.concat(F.lit("fct_"), slug, F.lit("__orders")).alias("table_name")
    )
    return obs.semantic_readiness(obs.run_results_incremental(staged(spark, sf)), models)


def tagged(spark, sf) -> DataFrame:
    return obs.tenant_run_results(obs.run_results_incremental(staged(spark, sf)), tenant_list(spark, sf))


_TAGGED = f"""{_STAGED}, tagged AS (SELECT {_TENANT} AS tenant_slug, node_name AS model_name, * FROM staged WHERE resource_type IN ('model', 'seed', 'snapshot'))"""


@case(
    "obs_14_summary",
    f"""WITH {_TAGGED} SELECT tenant_slug, count(DISTINCT model_name) AS models_count, CAST(epoch(max(run_started_at)) AS BIGINT) AS last_run_at,
    count(*) FILTER (WHERE status = 'success') AS pass_count, count(*) FILTER (WHERE status = 'fail') AS fail_count, count(*) FILTER (WHERE status = 'error') AS error_count,
    count(*) FILTER (WHERE status = 'skipped') AS skip_count, round(avg(execution_time_seconds), 4) AS avg_execution_time FROM tagged GROUP BY 1""",
)
def obs_14(spark, sf):
    return obs.obs_summary(tagged(spark, sf)).withColumn("last_run_at", F.unix_seconds("last_run_at"))


@case(
    "dsh_4_pass_rate",
    f"""WITH {_TAGGED} SELECT tenant_slug, round(count(*) FILTER (WHERE status = 'success') * 100.0::DOUBLE / greatest(count(*) FILTER (WHERE status IN ('success', 'fail', 'error')), 1), 6) AS pass_rate FROM tagged GROUP BY 1""",
)
def dsh_4(spark, sf):
    summary = obs.obs_summary(tagged(spark, sf))
    rate = dashboard.pass_rate(F.col("pass_count"), F.col("fail_count"), F.col("error_count")).cast("double")
    return summary.select("tenant_slug", F.round(rate, 6).alias("pass_rate"))


@case(
    "obs_15_recent_runs",
    f"WITH {_TAGGED} SELECT model_name, status, rows_affected, {_ES.format('run_started_at')} FROM tagged WHERE tenant_slug = 't1' ORDER BY tagged.run_started_at DESC, model_name, rows_affected, status LIMIT 50",
)
def obs_15(spark, sf):
    rows = obs.recent(tagged(spark, sf), "t1", tie_break=("model_name", "rows_affected", "status"))
    return rows.select("model_name", "status", "rows_affected", seconds("run_started_at"))


@case(
    "obs_15_recent_tests",
    f"WITH {_STAGED}, t AS (SELECT node_name AS test_name, status, message, run_started_at FROM staged WHERE resource_type = 'test' AND {_TENANT} = 't2') SELECT test_name, status, message, {_ES.format('run_started_at')} FROM t ORDER BY t.run_started_at DESC, test_name, status, message LIMIT 50",
)
def obs_15_tests(spark, sf):
    tests = obs.tenant_test_results(obs.test_results_incremental(staged(spark, sf)), tenant_list(spark, sf))
    rows = obs.recent(tests, "t2", tie_break=("test_name", "status", "message"))
    return rows.select("test_name", "status", "message", seconds("run_started_at"))


@case(
    "obs_16_latest_identity",
    f"{_IDENTITY} SELECT tenant_slug, total_users, resolved_customers, anonymous_users, identity_resolution_rate AS resolution_rate, total_events, total_sessions FROM stats WHERE tenant_slug = 't1'",
)
def obs_16(spark, sf):
    newest = identity(spark, sf)
    older = newest.withColumns({"dlt_load_id": F.lit("load_0"), "total_users": F.lit(0).cast("bigint")})
    return obs.latest_identity(older.unionByName(newest), "t1")
