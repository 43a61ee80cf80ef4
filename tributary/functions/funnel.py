"""Funnel steps as fixed columns, one pass, no pivot."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The funnel, in order.
FUNNEL_EVENTS = (
    "session_start",
    "view_item",
    "add_to_cart",
    "begin_checkout",
    "add_payment_info",
    "purchase",
)

STEP_COLUMNS = {
    f"funnel_step_{number}_{name}": name for number, name in enumerate(FUNNEL_EVENTS, start=1)
}


def funnel_position(event_name: str) -> str:
    """SQL: 1..6 for funnel events, 0 otherwise (NULL names included)."""
    steps = ", ".join(f"'{e}'" for e in FUNNEL_EVENTS)
    return f"coalesce(array_position(array({steps}), {event_name}), 0L)"


def step_counts(event_name: str) -> list[Column]:
    """One count column per step."""
    return [F.expr(f"count_if({event_name} = '{name}') AS {column}") for column, name in STEP_COLUMNS.items()]
