"""Sessions: gap-based for platforms without a session id, native otherwise.

Gap sessions are computed without ever sorting a user's full event list in one task.
Two events of a user inside the same slot of one gap length are less than a gap apart,
so a slot never spans two sessions.  Events are therefore first aggregated per
(tenant, platform, user, slot), with map-side combining, and only the slot summaries
go through the per-user window that decides where a session starts.  A user with a
third of all events contributes at most one summary per gap length of elapsed time to
that window, whatever the number of events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.functions.attribution import earliest
from tributary.functions.funnel import STEP_COLUMNS, funnel_position, step_counts
from tributary.sources.sinks import conform

FIRST_TOUCH = (
    "traffic_source",
    "traffic_medium",
    "traffic_campaign",
    "geo_country",
    "device_category",
)
USER = ("tenant_slug", "source_platform", "user_pseudo_id")
GAP_SECONDS = 1800  # fixed value


@dataclass(frozen=True)
class SessionInput:
    """How a platform's unpacked events map to session measures (SQL over event columns)."""

    units_per_second: int
    revenue: str
    transaction: str
    gap_seconds: int = GAP_SECONDS

    @property
    def gap(self) -> int:
        return self.gap_seconds * self.units_per_second


def with_conversions(events: DataFrame, conversions: DataFrame | list[str] | None) -> DataFrame:
    """Flag conversion events, from one list or from per-tenant lists.

    Per-tenant lists arrive as (tenant_slug, source, conversion_events), one row per
    tenant and source, and are joined on the event's own platform; NULL or no list
    means never.  The caller decides on a broadcast, as it knows how many lists there are.
    """
    if isinstance(conversions, DataFrame):
        lists = conversions.select(
            "tenant_slug", F.col("source").alias("source_platform"), "conversion_events"
        )
        joined = events.join(lists, ["tenant_slug", "source_platform"], "left")
        listed = F.array_contains("conversion_events", F.col("event_name"))
        return joined.withColumn("is_conversion", F.coalesce(listed, F.lit(False))).drop("conversion_events")
    listed = F.col("event_name").isin(list(conversions or []))
    return events.withColumn("is_conversion", F.coalesce(listed, F.lit(False)))


def _event_aggregates(source: SessionInput) -> list[Column]:
    aggregates = {
        "session_start_ts": "min(event_timestamp)",
        "session_end_ts": "max(event_timestamp)",
        "events_in_session": "count(1)",
        **{c: earliest(c, "event_timestamp") for c in FIRST_TOUCH},
        "funnel_max_step": f"max({funnel_position('event_name')})",
        "funnel_conversion_count": "count_if(is_conversion)",
        "session_revenue": f"sum(coalesce({source.revenue}, 0D))",
        "transaction_id": f"max({source.transaction})",
    }
    return [*_aliased(aggregates), *step_counts("event_name")]


def _aliased(expressions: dict[str, str]) -> list[Column]:
    return [F.expr(f"{sql} AS `{name}`") for name, sql in expressions.items()]


def _merged() -> list[Column]:
    """The same aggregates, combined over slot summaries."""
    smallest = ("session_start_ts", *FIRST_TOUCH)
    largest = ("user_id", "session_end_ts", "funnel_max_step", "transaction_id")
    added = ("events_in_session", *STEP_COLUMNS, "funnel_conversion_count", "session_revenue")
    return _aliased(
        {c: f"min({c})" for c in smallest} | {c: f"max({c})" for c in largest} | {c: f"sum({c})" for c in added}
    )


def _finish(sessions: DataFrame, source: SessionInput, session_id: str) -> DataFrame:
    return conform(
        sessions,
        "fct_sessions",
        session_id=session_id,
        session_duration_seconds=f"CAST(session_end_ts - session_start_ts AS DOUBLE) / {source.units_per_second}D",
        is_conversion_session="funnel_conversion_count > 0",
        **{c: f"{c}.value" for c in FIRST_TOUCH},
    )


def slot_summaries(events: DataFrame, source: SessionInput) -> DataFrame:
    """One row per (tenant, platform, user, slot)."""
    slot = F.expr(f"event_timestamp - pmod(event_timestamp, {source.gap}L)")
    return events.withColumn("slot", slot).groupBy(*USER, "slot").agg(
        F.max("user_id").alias("user_id"), *_event_aggregates(source)
    )


def number_sessions(slots: DataFrame, gap: int) -> DataFrame:
    """Running session number per user; a session starts after more than one gap of silence.

    Events without a timestamp sort last: the first joins the session before it, every
    further one counts as a start, and all of them carry the last number.
    """
    ordered = Window.partitionBy(*USER).orderBy(F.asc_nulls_last("slot"))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has_previous = F.lag("events_in_session").over(ordered).isNotNull()
    silence = F.col("session_start_ts") - F.lag("session_end_ts").over(ordered)
    starts = (
        F.when(F.col("slot").isNull(), F.col("events_in_session") - has_previous.cast("bigint"))
        .when(has_previous & (silence <= gap), 0)
        .otherwise(1)
    )
    return slots.withColumn("starts", starts).withColumn("session_number", F.sum("starts").over(running))


def sessionize(
    events: DataFrame,
    source: SessionInput,
    conversions: DataFrame | list[str] | None = None,
) -> DataFrame:
    slots = slot_summaries(with_conversions(events, conversions), source)
    numbered = number_sessions(slots, source.gap)
    merged = numbered.groupBy(*USER, "session_number").agg(*_merged())
    return _finish(merged, source, "concat(user_pseudo_id, '-', CAST(session_number AS STRING))")


def native_sessions(
    events: DataFrame,
    source: SessionInput,
    conversions: DataFrame | list[str] | None = None,
) -> DataFrame:
    """Sessions by the platform's own id; events without one are dropped."""
    kept = with_conversions(events.filter(F.col("session_id").isNotNull()), conversions)
    keys = ("tenant_slug", "source_platform", "session_id", "user_pseudo_id", "user_id")
    return _finish(kept.groupBy(*keys).agg(*_event_aggregates(source)), source, "session_id")
