"""Analytics platforms: events, sessions and users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary.functions.casts import UNITS_PER_SECOND
from tributary.operators.sessions import SessionInput, native_sessions, sessionize
from tributary.operators.users import users
from tributary.registry import register_engine
from tributary.sources.sinks import conform

# Fixed value: the platform's text for "no transaction" is 'N/A'.
REAL_TRANSACTION = "nullif(transaction_id, 'N/A')"


@register_engine("google_analytics", "events")
def google_analytics_events(rows: DataFrame) -> DataFrame:
    """Order id and total only for events that carry a real transaction."""
    return conform(
        rows,
        "fct_events",
        session_id="ga_session_id",
        order_id=REAL_TRANSACTION,
        order_total=f"CASE WHEN {REAL_TRANSACTION} IS NOT NULL THEN purchase_revenue END",
    )


@register_engine("amplitude", "events")
def amplitude_events(rows: DataFrame) -> DataFrame:
    return conform(rows, "fct_events")


@register_engine("mixpanel", "events")
def mixpanel_events(rows: DataFrame) -> DataFrame:
    """No session id; order fields come from the event properties."""
    return conform(rows, "fct_events", session_id="NULL", order_id="prop_order_id", order_total="prop_revenue")


def session_input(source: str, gap_seconds: int = 1800) -> SessionInput:
    revenue, transaction = {
        "google_analytics": ("purchase_revenue", REAL_TRANSACTION),
        "mixpanel": ("prop_revenue", "prop_order_id"),
        "amplitude": ("0D", "CAST(NULL AS STRING)"),
    }[source]
    return SessionInput(UNITS_PER_SECOND[source], revenue, transaction, gap_seconds)


@register_engine("google_analytics", "sessions")
def google_analytics_sessions(rows, conversions=None, gap_seconds: int = 1800) -> DataFrame:
    return sessionize(rows, session_input("google_analytics", gap_seconds), conversions)


@register_engine("mixpanel", "sessions")
def mixpanel_sessions(rows, conversions=None, gap_seconds: int = 1800) -> DataFrame:
    return sessionize(rows, session_input("mixpanel", gap_seconds), conversions)


@register_engine("amplitude", "sessions")
def amplitude_sessions(rows, conversions=None) -> DataFrame:
    return native_sessions(rows, session_input("amplitude"), conversions)


ANALYTICS_SOURCES = ("google_analytics", "mixpanel", "amplitude")

for _source in ANALYTICS_SOURCES:
    register_engine(_source, "users", users)
