from tests.conftest import rows
from tributary.operators import profile
from tributary.sources.local import local_frame


def test_distinct_estimates_are_close(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    estimated = {r["column_name"]: r["approx_unique"] for r in profile.summarize(orders).collect()}
    exact = {r["column_name"]: r["approx_unique"] for r in profile.summarize(orders, exact_distinct=True).collect()}
    assert all(abs(estimated[c] - n) <= max(1, 0.08 * n) for c, n in exact.items())


def test_text_checks_are_all_or_nothing(spark):
    data = [("1.5", "9:30 PM", "01/02/2024", "01/02/2024", "NaN"), ("-2", "23:59", "12/31/2023", "2024-01-01", "inf"), (None, None, None, None, None)]
    df = local_frame(spark, data, "num string, clock string, us string, mixed string, odd string")
    got = {r["column_name"]: (r["is_numeric_text"], r["is_time_text"], r["is_date_text"]) for r in profile.summarize(df).collect()}
    assert got == {
        "num": (True, False, False), "clock": (False, True, False), "us": (False, False, True),
        "mixed": (False, False, False), "odd": (True, False, False),
    }


def test_empty_and_all_null_columns(spark):
    df = local_frame(spark, [(None, 1), (None, 1)], "a string, b bigint")
    got = {r["column_name"]: r for r in profile.summarize(df).collect()}
    assert got["a"]["null_percentage"] == 100.0 and got["a"]["approx_unique"] == 0 and not got["a"]["is_numeric_text"]
    assert profile.summarize(df.limit(0)).count() == 2


def test_nested_columns_have_no_bounds(spark, sf):
    got = {r["column_name"]: r for r in profile.summarize(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    assert got["embedding"]["min"] is None and got["embedding"]["approx_unique"] > 0


def test_top_values_skip_wide_columns(spark):
    df = local_frame(spark, [(i, "x" if i % 3 else "y") for i in range(90)], "id bigint, kind string")
    assert rows(profile.top_values(df)) == [("kind", "x", 60), ("kind", "y", 30)]
    assert profile.top_values(df, ["id"]).count() == 0


def test_categories(spark):
    data = [(i, i % 3, float(i), "yes", f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    df = local_frame(spark, data, "order_id bigint, grade bigint, score double, flag string, day string")
    got = dict(rows(profile.categorize(profile.summarize(df)), "column_name", "category"))
    assert got == {"order_id": "identifier", "grade": "categorical", "score": "continuous", "flag": "categorical", "day": "temporal"}
    fields = {r["alias"] for r in profile.data_catalog(profile.categorize(profile.summarize(df))).collect()}
    assert {"unique_order_id", "total_score", "unique_score_vals", "Flag", "Grade", "Day", "Order Id"} <= fields
