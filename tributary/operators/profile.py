"""Table profiling: one aggregate over all columns instead of a query per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.functions.casts import DATE_LAYOUTS, iso_date, parse_layout, text_number
from tributary.schemas import catalogue_type
from tributary.sources.local import local_frame

TOP_VALUES_CEILING = 20  # fixed value: columns with more distinct values have no value list
MEMBERS_CEILING = 50  # fixed value
FEW_DISTINCT = 14  # fixed value: at most this many distinct numbers look like categories
TIME_TEXT = r"^(?:(?:[01]?\d|2[0-3]):[0-5]\d(?:\s?[AP]M)?)$"
# Name fragments that mark a measure.
MEASURE_WORDS = (
    "count", "sum", "total", "amount", "price", "revenue", "value", "score", "quantity", "rate", "ratio",
    "percent", "pct", "seconds", "days", "hours", "ms", "duration", "cost", "fee", "tax",
)
MONEY_WORDS = ("revenue", "amount", "price")

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def _ordered(kind: str) -> bool:
    """Types with a total order and a text form; nested values get no min and max."""
    return not kind.startswith(("array", "map", "struct", "binary", "variant"))


def approx_distinct(value: Column) -> Column:
    """Sketch-based count: one small binary per column and task, exact for few values."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value))))


def _countable(name: str, kind: str) -> Column:
    value = F.col(f"`{name}`")
    return value if _ordered(kind) else F.to_json(value) if kind != "binary" else F.hex(value)


def distinct_counts(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: position, name, number of distinct values.

    An aggregate of its own: with sketches beside them, all other aggregates of a scan
    would leave generated code.
    """
    count = F.count_distinct if exact else approx_distinct
    counts = df.agg(*[count(_countable(name, kind)).alias(f"c{i}") for i, (name, kind) in enumerate(df.dtypes)])
    rows = [
        F.struct(F.lit(i + 1).alias("ordinal_position"), F.lit(name).alias("column_name"), F.col(f"c{i}").alias("approx_unique"))
        for i, name in enumerate(df.columns)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def _stats(df: DataFrame) -> DataFrame:
    """One row of aggregates but for the distinct counts, every column in the same scan."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, (name, kind) in enumerate(df.dtypes):
        value = F.col(f"`{name}`")
        aggregates.append(F.count(value).alias(f"filled_{i}"))
        if _ordered(kind):
            aggregates += [F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}")]
        if _is_numeric(kind):
            aggregates.append(F.avg(value.cast("double")).alias(f"avg_{i}"))
        if kind == "string":
            aggregates += [c.alias(f"{key}_{i}") for key, c in _text_checks(value).items()]
    return df.agg(*aggregates)


def _text_checks(value: Column) -> dict[str, Column]:
    # a byte comparison rules out words before any pattern is tried
    digits = F.when(value < ":", value)
    checks = {
        "times": F.count_if(digits.rlike(TIME_TEXT)),
        "numbers": F.count(text_number(value)),
        "dates": F.count(iso_date(digits)),
    }
    for j, layout in enumerate(DATE_LAYOUTS):
        checks[f"layout{j}"] = F.count(parse_layout(digits, layout))
    return checks


def summarize(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: type, min, max, mean, distinct count, null share, text checks.

    The text checks say whether all values present parse as a time, a number or, for one
    single layout, as a date.
    """
    stats = _stats(df)
    present = set(stats.columns)
    rows = []
    for i, (name, kind) in enumerate(df.dtypes):

        def stat(key: str, cast: str, i: int = i) -> Column:
            return (F.col(f"{key}_{i}") if f"{key}_{i}" in present else F.lit(None)).cast(cast).alias(key)

        filled = F.col(f"filled_{i}")
        if kind == "string":
            some = filled > 0
            time_like = some & (F.col(f"times_{i}") == filled)
            number_like = some & (F.col(f"numbers_{i}") == filled)
            keys = ["dates", *[f"layout{j}" for j in range(len(DATE_LAYOUTS))]]
            date_like = some & reduce(Column.__or__, [F.col(f"{k}_{i}") == filled for k in keys])
        else:
            time_like = number_like = date_like = F.lit(False)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("ordinal_position"),
                F.lit(name).alias("column_name"),
                F.lit(catalogue_type(name, kind)).alias("column_type"),
                stat("min", "string"),
                stat("max", "string"),
                stat("avg", "double"),
                F.col("n").alias("row_count"),
                F.when(F.col("n") > 0, (F.col("n") - filled) * 100.0 / F.col("n")).alias("null_percentage"),
                time_like.alias("is_time_text"),
                number_like.alias("is_numeric_text"),
                date_like.alias("is_date_text"),
            )
        )
    described = stats.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    counts = distinct_counts(df, exact_distinct).drop("column_name")
    return described.join(counts, "ordinal_position").select(
        "ordinal_position", "column_name", "column_type", "min", "max", "avg", "approx_unique", "row_count",
        "null_percentage", "is_time_text", "is_numeric_text", "is_date_text",
    )


def few_valued(counts: DataFrame, ceiling: int) -> list[str]:
    """Columns with 1 to ``ceiling`` distinct values, of a profile or of :func:`distinct_counts`."""
    few = counts.filter(F.col("approx_unique").between(1, ceiling))
    return [r["column_name"] for r in few.select("column_name").coalesce(1).collect()]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, count) of the chosen columns, values as text.

    Counting happens per column value with map-side combining, so a dominant value is
    one row per task before the shuffle.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
        ]
    )
    exploded = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    return exploded.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(
    df: DataFrame,
    columns: list[str] | None = None,
    k: int = 10,
    ceiling: int = TOP_VALUES_CEILING,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Most frequent values of every low-cardinality column, ties by value.

    A profile that was taken before saves the scan that finds those columns.
    """
    allowed = few_valued(distinct_counts(df) if profile is None else profile, ceiling)
    chosen = [c for c in (columns or df.columns) if c in allowed]
    if not chosen:
        return local_frame(df.sparkSession, [], "column_name string, value string, count bigint")
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    ranked = value_counts(df, chosen).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).drop("rank")


def _name_has(words: tuple[str, ...]) -> Column:
    return F.lower("column_name").rlike("|".join(words))


def categorize(profile: DataFrame, few: int = FEW_DISTINCT) -> DataFrame:
    """Add the semantic category and the ingest type of every profiled column."""
    kind = F.col("column_type")
    name = F.lower("column_name")
    is_float = kind.isin("FLOAT", "DOUBLE", "DECIMAL", "REAL", "NUMERIC")
    is_integer = kind.isin("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT")
    is_date = kind.isin("DATE", "TIMESTAMP")
    is_id = name.endswith("id") | name.endswith("_key") | (name == "pk")
    numeric_text = F.col("is_numeric_text") & ~F.col("is_time_text")
    date_text = F.col("is_date_text") & ~F.col("is_time_text") & ~numeric_text
    number_like = is_float | is_integer | numeric_text
    measure_like = (F.col("approx_unique") > few) | is_id | _name_has(MEASURE_WORDS)
    category = (
        F.when(number_like & measure_like & is_id, "identifier")
        .when(number_like & measure_like & is_float, "continuous")
        .when(number_like & measure_like, "numerical")
        .when(number_like, "categorical")
        .when(is_date | date_text, "temporal")
        .otherwise("categorical")
    )
    ingest = (
        F.when(number_like, "number").when(is_date, "timestamp").when(kind == "BOOLEAN", "boolean").otherwise("string")
    )
    return profile.withColumns({"category": category, "ingest_type": ingest})


def members(df: DataFrame, profile: DataFrame, k: int = 10, ceiling: int = MEMBERS_CEILING) -> DataFrame:
    """First ``k`` distinct values, in order, of categorical columns with few values."""
    wanted = categorize(profile).filter(
        (F.col("category") == "categorical") & (F.col("approx_unique") < ceiling)
    )
    chosen = [r["column_name"] for r in wanted.select("column_name").coalesce(1).collect()]
    if not chosen:
        return local_frame(df.sparkSession, [], "column_name string, value string")
    order = Window.partitionBy("column_name").orderBy("value")
    ranked = value_counts(df, chosen).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("column_name", "value")


def _title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def default_dimensions(categorized: DataFrame) -> DataFrame:
    """Categorical, temporal and identifier columns become dimensions."""
    kept = categorized.filter(F.col("category").isin("categorical", "temporal", "identifier"))
    return kept.select(
        F.col("column_name").alias("source_column"),
        _title(F.col("column_name")).alias("alias"),
        F.lit(None).cast("string").alias("transformation"),
        F.concat(_title(F.col("column_name")), F.lit(" auto-detected")).alias("description"),
    )


def default_measures(categorized: DataFrame) -> DataFrame:
    """Identifiers are counted; numbers get five aggregates and a distinct count."""
    column = F.col("column_name")
    money = _name_has(MONEY_WORDS)
    unit = F.when(money, "currency").otherwise("number")

    def aggregate(agg: str, prefix: str, word: str, fmt: Column, decimals: Column) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), column).alias("alias"),
            F.lit("aggregation").alias("type"),
            F.lit(agg).alias("agg"),
            F.lit(None).cast("string").alias("formula"),
            fmt.alias("format"),
            decimals.alias("decimals"),
            F.concat(F.lit(word), _title(column)).alias("description"),
        )

    def distinct(suffix: str, word: str) -> Column:
        return F.struct(
            F.concat(F.lit("unique_"), column, F.lit(suffix)).alias("alias"),
            F.lit("formula").alias("type"),
            F.lit(None).cast("string").alias("agg"),
            F.concat(F.lit("COUNT(DISTINCT "), column, F.lit(")")).alias("formula"),
            F.lit("number").alias("format"),
            F.lit(0).alias("decimals"),
            F.concat(F.lit(word), _title(column)).alias("description"),
        )

    zero, one = F.lit(0), F.lit(1)
    numeric = F.array(
        aggregate("sum", "total_", "Total ", unit, F.when(money, 2).otherwise(0)),
        aggregate("avg", "avg_", "Average ", unit, one),
        aggregate("min", "min_", "Minimum ", unit, zero),
        aggregate("max", "max_", "Maximum ", unit, zero),
        aggregate("count", "count_", "Total count of ", F.lit("number"), zero),
        distinct("_vals", "Unique values of "),
    )
    identifier = F.array(distinct("", "Unique count of "))
    rules = F.when(F.col("category") == "identifier", identifier).when(
        F.col("category").isin("numerical", "continuous"), numeric
    )
    return categorized.select(column.alias("source_column"), F.explode(rules).alias("m")).select(
        "source_column", "m.*"
    )


def data_catalog(categorized: DataFrame) -> DataFrame:
    """Dimensions and measures of a profiled table by display alias."""
    dims = default_dimensions(categorized).select(
        F.lit("dimension").alias("kind"),
        "alias",
        "source_column",
        "description",
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("aggregation"),
        F.col("transformation").isNotNull().alias("has_transformation"),
    )
    measures = default_measures(categorized).select(
        F.lit("measure").alias("kind"),
        "alias",
        "source_column",
        "description",
        "type",
        F.col("agg").alias("aggregation"),
        F.lit(False).alias("has_transformation"),
    )
    return dims.unionByName(measures)
