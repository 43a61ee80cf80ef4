"""Earliest non-null value, in a form that merges across partial aggregates."""

from __future__ import annotations


def earliest(value: str, ordering: str) -> str:
    """SQL of the partial state: smallest (time, value) pair over rows that carry both.

    Ties in time resolve to the smallest value, so the result depends on the rows
    only and not on how they are partitioned.
    """
    return (
        f"min(CASE WHEN `{value}` IS NOT NULL AND `{ordering}` IS NOT NULL"
        f" THEN struct(`{ordering}` AS at, `{value}` AS value) END)"
    )


def earliest_value(value: str, ordering: str) -> str:
    return f"{earliest(value, ordering)}.value"
