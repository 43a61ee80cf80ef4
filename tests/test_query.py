import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of, rows
from tributary.operators import dashboard
from tributary.operators.questions import route_questions
from tributary.plans.alias import AliasDimension, AliasMeasure, AliasModel
from tributary.plans.model import SemanticLayer
from tributary.plans.pipeline import read_star, write_star
from tributary.plans.query import Filter, OrderBy, Request, preview, semantic_query
from tributary.schemas import STAR
from tributary.session import scratch_path
from tributary.sources.local import local_frame

DAY = dt.date(2024, 1, 1)


def ads(spark):
    data = [
        ("t0", "google_ads", DAY, "c1", "g", "a1", 10.0, 100, 10, 1.0),
        ("t0", "google_ads", DAY, "c1", "g", "a2", 5.0, 100, 0, 1.0),
        ("t0", "bing_ads", DAY, None, None, None, None, 0, 0, None),
        ("t1", "google_ads", DAY, "c1", "g", "a1", 99.0, 1, 1, 1.0),
    ]
    return local_frame(spark, data, STAR["fct_ad_performance"])


def campaigns(spark):
    data = [("t0", "google_ads", "c1", "Spring", "ACTIVE"), ("t0", "bing_ads", "c1", "Fall", "PAUSED"), ("t1", "google_ads", "c1", "Other", "ACTIVE")]
    return local_frame(spark, data, STAR["dim_campaigns"])


@pytest.fixture(scope="module")
def layer(spark):
    return SemanticLayer.from_frames(spark, {"ad_performance": ads(spark), "campaigns": campaigns(spark)})


def ask(layer, tenant="t0", **kw):
    return semantic_query(layer, tenant, Request("ad_performance", **kw))


@pytest.mark.parametrize(
    "bad",
    [
        {"dimensions": ("nope",)}, {"measures": ("nope",)}, {"calculated_measures": ("aov",)}, {"joins": ("orders",)},
        {"filters": (Filter("nope", "=", 1),)}, {"order_by": (OrderBy("nope"),)}, {"measures": ("clicks",), "order_by": (OrderBy("spend"),)},
    ],
)
def test_unknown_fields_are_refused(layer, bad):
    with pytest.raises(ValueError):
        ask(layer, **bad)


def test_request_validation():
    for make in (lambda: Filter("a", "~"), lambda: OrderBy("a", "up")):
        with pytest.raises(ValueError):
            make()
    assert Filter("a", "is not null").op == "IS NOT NULL"
    assert Request("m").limit is None


def test_only_previews_are_cut(spark):
    many = local_frame(spark, [("t0", "bing_ads", str(i), "n", "ACTIVE") for i in range(1200)], STAR["dim_campaigns"])
    layer = SemanticLayer.from_frames(spark, {"campaigns": many})
    request = Request("campaigns", dimensions=("campaign_id",))
    assert semantic_query(layer, "t0", request).count() == 1200
    assert preview(layer, "t0", request).count() == 1000
    with pytest.raises(ValueError):
        preview(layer, "t0", Request("campaigns", limit=10_001))


@pytest.mark.parametrize(
    ("op", "value", "days"),
    [("=", "2024-01-02", [2]), (">=", dt.date(2024, 1, 3), [3, 4]), (">", "2024-01-03", [4]), ("<", "2024-01-02", [1]),
     ("<=", "2024-01-02", [1, 2]), ("BETWEEN", ("2024-01-02", "2024-01-03"), [2, 3]), ("IN", ("2024-01-04", "2024-01-01"), [1, 4])],
)
def test_date_filters_reach_the_epoch_column(spark, tmp_path, op, value, days):
    schema = "tenant_slug string, source_platform string, session_id string, session_start_ts long"
    unit = {"google_analytics": 1_000_000, "mixpanel": 1_000}
    data = [
        ("t0", p, f"{p}{d}{s}", int(dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc).timestamp() + s) * u)
        for p, u in unit.items() for d in range(1, 5) for s in (0, 86_399)
    ]
    local_frame(spark, data, schema).write.parquet(f"{tmp_path}/s")
    layer = SemanticLayer.from_frames(spark, {"sessions": spark.read.parquet(f"{tmp_path}/s")})
    df = semantic_query(
        layer, "t0", Request("sessions", dimensions=("session_id",), filters=(Filter("session_start_date", op, value),))
    )
    want = {f"{p}{d}{s}" for p in unit for d in days for s in (0, 86_399)}
    assert {r[0] for r in df.collect()} == want
    assert "EqualTo(source_platform" in plan_of(df).split("PushedFilters")[1]


def test_projection_keeps_duplicates_and_grouping_does_not(layer):
    assert rows(ask(layer, dimensions=("source_platform",))) == [("bing_ads",), ("google_ads",), ("google_ads",)]
    got = rows(ask(layer, dimensions=("source_platform",), measures=("spend", "clicks", "total_ads")))
    assert got == [("bing_ads", None, 0, 0), ("google_ads", 15.0, 10, 2)]


def test_other_tenants_never_show(layer):
    assert rows(ask(layer, measures=("spend",))) == [(15.0,)]
    assert rows(ask(layer, tenant="zzz", measures=("clicks",))) == [(None,)]
    assert {r[0] for r in rows(ask(layer))} == {"t0"}


def test_calculated_measures_guard_zero(layer):
    got = rows(ask(layer, dimensions=("source_platform",), calculated_measures=("ctr", "cpc", "cpm")))
    assert got == [("bing_ads", 0.0, 0.0, 0.0), ("google_ads", 0.05, 1.5, 75.0)]


def test_join_multiplies_and_stays_inside_the_tenant(layer):
    got = rows(ask(layer, dimensions=("campaigns.campaign_name",), measures=("clicks",), joins=("campaigns",)))
    assert got == [("Fall", 10), ("Spring", 10), (None, 0)]


def test_order_puts_nulls_last_both_ways(layer):
    for direction, want in (("asc", ["c1", "c1", None]), ("desc", ["c1", "c1", None])):
        df = ask(layer, dimensions=("campaign_id",), order_by=(OrderBy("campaign_id", direction),))
        assert [r[0] for r in df.collect()] == want


def test_order_by_a_field_that_is_not_projected(layer):
    df = ask(layer, dimensions=("ad_id",), order_by=(OrderBy("spend", "desc"),), limit=1)
    assert [r[0] for r in df.collect()] == ["a1"]


def test_filters(layer):
    def count(*filters):
        return ask(layer, filters=tuple(Filter(*f) for f in filters)).count()

    assert count(("ad_id", "IN", ["a1", "a2"])) == 2
    assert count(("ad_id", "IN", "a1")) == 1
    assert count(("ad_id", "LIKE", "a%")) == 2
    assert count(("spend", "BETWEEN", [5, 10])) == 2
    assert count(("spend", "IS NULL")) == 1
    assert count(("report_date", ">=", "2024-01-01"), ("clicks", "!=", 0)) == 1
    assert count(("total_ads", "=", "a1")) == 1  # a count measure filters its source column


def test_stored_star_prunes_partitions_and_columns(spark):
    root = scratch_path(spark, "star")
    write_star({"ad_performance": ads(spark), "campaigns": campaigns(spark)}, root)
    star = read_star(spark, root)
    layer = SemanticLayer.from_frames(spark, {"ad_performance": star["ad_performance"]})
    request = Request("ad_performance", dimensions=("source_platform",), measures=("spend",), filters=(Filter("report_date", ">=", "2024-01-01"),))
    df = semantic_query(layer, "t0", request)
    plan = plan_of(df)
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "isnotnull(tenant_slug" in partition_filters and "gen#" in partition_filters  # tenant and manifest
    assert "GreaterThanOrEqual(report_date" in plan
    assert "ReadSchema: struct<source_platform:string,report_date:date,spend:double>" in plan
    assert rows(df) == [("bing_ads", None), ("google_ads", 15.0)]
    # rebuilding one tenant leaves the others; a full rebuild leaves nothing stale
    write_star({"ad_performance": ads(spark).filter("ad_id = 'a2'")}, root, tenants=["t0"])
    assert rows(read_star(spark, root)["ad_performance"], "tenant_slug", "ad_id") == [("t0", "a2"), ("t1", "a1")]
    write_star({"ad_performance": ads(spark).filter("tenant_slug = 't1'")}, root)
    assert rows(read_star(spark, root)["ad_performance"], "tenant_slug") == [("t1",)]


def test_fluent_model(layer):
    model = layer.model("ad_performance").for_tenant("t0")
    df = model.filter(F.col("spend").isNotNull()).group_by("campaign_id").aggregate("spend", n=F.count(F.lit(1)))
    assert rows(df) == [("c1", 15.0, 2)]
    with pytest.raises(ValueError):
        model.group_by("nope")
    with pytest.raises(ValueError):
        model.group_by("campaign_id").aggregate()


def test_alias_model(spark):
    df = local_frame(spark, [("1", "01/31/2024"), ("x", "31/01/2024"), ("2.5", "2024-01-31")], "v string, d string")
    model = AliasModel(
        df, {"Day": AliasDimension("d", temporal_text=True)},
        {"Total": AliasMeasure("v", "sum"), "Rows": AliasMeasure("_count", "count"), "Kinds": AliasMeasure(formula="COUNT(DISTINCT v)")},
    )
    got = rows(model.query(["Day"], ["Total", "Rows", "Kinds"]))
    assert got == [(dt.datetime(2024, 1, 31), 3.5, 3, 3)]
    assert model.query(["Day"]).count() == 1
    with pytest.raises(ValueError):
        model.query()
    with pytest.raises(ValueError):
        model.query(["Nope"])


def test_period_over_period_without_previous_rows(layer):
    model = layer.model("ad_performance").for_tenant("t0")
    got = {r["name"]: (r["current"], r["previous"], r["change_percent"], r["format"]) for r in dashboard.period_over_period(model, dt.date(2024, 1, 5)).collect()}
    assert got["spend"] == (15.0, 0.0, 100.0, "currency")
    assert got["clicks"] == (10.0, 0.0, 100.0, "number")


def test_pivot_columns_are_sorted(spark):
    df = local_frame(spark, [("x", "b", 1), ("x", "a", 2), ("y", None, 3)], "k string, g string, v bigint")
    result = dashboard.pivot(df, "k", "g", "v")
    assert result.columns == ["k", "a", "b", "null"]
    assert rows(result) == [("x", 2, 1, None), ("y", None, None, 3)]


def test_routing(spark):
    texts = ["Total SPEND by campaign", "order revenue", "hello", "visitor funnel", None]
    df = local_frame(spark, [(t,) for t in texts], "q string")
    got = {r["q"]: r["model"] for r in route_questions(df, "q").collect()}
    assert got == {texts[0]: "ad_performance", texts[1]: "orders", "hello": "ad_performance", texts[3]: "events", None: "ad_performance"}
    assert {r["model"] for r in route_questions(df, "q", ["users"]).collect()} == {"users"}


def test_star_files_hold_few_months(spark, tmp_path):
    import pyarrow.parquet as pq

    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    data = [("t0", "google_ads", d, "c", "g", str(n), 1.0, 1, 1, 1.0) for d in days for n in range(20)]
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "8k")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        write_star({"ad_performance": local_frame(spark, data, STAR["fct_ad_performance"])}, str(tmp_path))
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    spans = []
    for file in tmp_path.rglob("*.parquet"):
        stored = pq.ParquetFile(file).read(columns=["report_date"]).column(0).to_pylist()
        spans.append(len({(d.year, d.month) for d in stored}))
    assert len(spans) > 3 and sum(spans) / len(spans) <= 4
