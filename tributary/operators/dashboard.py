"""Dashboard data: period comparison, format inference, pivot, pass rate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tributary.functions.casts import epoch_bound
from tributary.plans.model import SemanticModel
from tributary.sources.local import local_frame

TIME_TYPES = ("date", "timestamp", "timestamp_epoch")
# Name fragments that decide a metric's format.
CURRENCY_WORDS = ("revenue", "spend", "price", "cost")
PERCENT_WORDS = ("rate", "percent")


def value_format(name: Column) -> Column:
    lowered = F.lower(name)
    return (
        F.when(lowered.rlike("|".join(CURRENCY_WORDS)), "currency")
        .when(lowered.rlike("|".join(PERCENT_WORDS)), "percentage")
        .otherwise("number")
    )


def percent_change(current: Column, previous: Column) -> Column:
    grown = F.when(current > 0, 100.0).otherwise(0.0)
    return F.when(previous == 0, grown).otherwise((current - previous) / previous * 100)


def _since(kind: str, moment: Column, day: dt.date) -> Column:
    """Rows from a day on; an epoch counts in the unit of its row's platform."""
    if kind == "timestamp_epoch":
        midnight = dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc)
        return epoch_bound(moment, F.col("source_platform"), midnight, since=True)
    return moment >= F.lit(day).cast("date" if kind == "date" else "timestamp")


def period_over_period(model: SemanticModel, as_of: dt.date, days: int = 30, top: int = 4) -> DataFrame:
    """First measures of a model, last period against the one before.

    Both periods come from one scan with conditional aggregates, and the older bound is
    a plain predicate on the time column, so it reaches the file scan.  Epochs of several
    platforms may be mixed: each row is compared in its own platform's unit.
    """
    time_dim = next((d for d in model.dimensions.values() if d.type in TIME_TYPES), None)
    measures = list(model.measures.values())[:top]
    if time_dim is None or not measures:
        return local_frame(model.df.sparkSession, [], _POP_SCHEMA)
    moment = F.col(time_dim.name)
    recent = _since(time_dim.type, moment, as_of - dt.timedelta(days=days))
    rows = model.df.filter(_since(time_dim.type, moment, as_of - dt.timedelta(days=2 * days)))
    columns = []
    for i, m in enumerate(measures):
        columns.append(m.over(F.when(recent, m.source())).alias(f"cur_{i}"))
        columns.append(m.over(F.when(~recent, m.source())).alias(f"prev_{i}"))
    totals = rows.agg(*columns)

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    metrics = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("name"), number(f"cur_{i}").alias("current"), number(f"prev_{i}").alias("previous")
            )
            for i, m in enumerate(measures)
        ]
    )
    flat = totals.select(F.explode(metrics).alias("m")).select("m.*")
    return flat.select(
        "name",
        F.replace("name", F.lit("_"), F.lit(" ")).alias("label"),
        "current",
        "previous",
        percent_change(F.col("current"), F.col("previous")).alias("change_percent"),
        value_format(F.col("name")).alias("format"),
    )


_POP_SCHEMA = (
    "name string, label string, current double, previous double, change_percent double, format string"
)

#: More distinct column values than this raise an error; nothing is dropped.
MAX_PIVOT_COLUMNS = 10_000


def pivot(df: DataFrame, x: str, group: str, measure: str, order: str | None = None) -> DataFrame:
    """One row per ``x``, one column per distinct ``group`` value.

    With several rows per cell the last one in ``order`` wins (without an order, the
    largest value, so the result is deterministic).
    """
    found = df.select(F.col(group).cast("string").alias("v")).distinct().limit(MAX_PIVOT_COLUMNS + 1).collect()
    if len(found) > MAX_PIVOT_COLUMNS:
        raise ValueError(f"'{group}' has more than {MAX_PIVOT_COLUMNS} distinct values")
    values = sorted("null" if r["v"] is None else r["v"] for r in found)
    cell = F.max(measure) if order is None else F.max_by(measure, order)
    keyed = df.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("null")))
    return keyed.groupBy(x).pivot("_group", values).agg(cell)


def pass_rate(passed: Column, failed: Column, errored: Column) -> Column:
    return passed * 100.0 / F.greatest(passed + failed + errored, F.lit(1))
