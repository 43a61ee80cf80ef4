"""Casts that turn bad text into NULL instead of failing the job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Text date layouts, in the order they are tried.
DATE_LAYOUTS = ("M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "yyyy/M/d", "M-d-yyyy")

# A failed parse costs an exception, so texts of another shape are ruled out first.
_SHAPES = {
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
}
_ISO_START = r"^\s*\d{4}-\d"
# Words that are numbers.
NUMBER_WORDS = ("inf", "infinity", "nan")


def typed(text: str, kind: str) -> str:
    """SQL of a safe cast; whole numbers may be written with decimals ("23.0" -> 23)."""
    if kind == "string":
        return text
    if kind == "bigint":
        rounded = f"round(try_cast({text} AS decimal(38,9)), 0)"
        return f"coalesce(try_cast({text} AS bigint), try_cast({rounded} AS bigint))"
    return f"try_cast({text} AS {kind})"


def parse_layout(text: Column, layout: str) -> Column:
    """NULL unless the text has exactly the layout's shape and names a real day."""
    return F.when(text.rlike(_SHAPES[layout]), F.try_to_timestamp(text, F.lit(layout)))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(_ISO_START), text.try_cast("date"))


def to_moment(value: Column) -> Column:
    """Timestamp from text in any accepted layout; native timestamps pass through."""
    text = value.cast("string")
    attempts = [F.when(text.rlike(_ISO_START), text.try_cast("timestamp"))]
    attempts += [parse_layout(text, layout) for layout in DATE_LAYOUTS]
    return F.coalesce(*attempts)


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def text_number(text: Column) -> Column:
    """Number in a text; only texts that start like one are parsed."""
    word = F.lower(F.trim(text)).isin(*NUMBER_WORDS)
    return F.when((text < ":") | word, text.try_cast("double"))


def epoch_to_timestamp(value: Column, platform: Column) -> Column:
    """Epoch column to timestamp with each platform's own unit."""
    return F.when(platform == "google_analytics", F.timestamp_micros(value)).otherwise(
        F.timestamp_millis(value)
    )


# Epoch units per second of each analytics platform.
UNITS_PER_SECOND = {"google_analytics": 1_000_000, "mixpanel": 1_000, "amplitude": 1_000}


def epoch_bound(value: Column, platform: Column, moment: dt.datetime, since: bool) -> Column:
    """Whether an epoch column is at or after (``since``) or before a moment, in each platform's unit.

    The bounds are literals next to plain columns, so that a scan can skip row groups.
    """

    def compared(units: int) -> Column:
        bound = F.lit(int(moment.timestamp() * units)).cast("bigint")
        return value >= bound if since else value < bound

    micros = [p for p, units in UNITS_PER_SECOND.items() if units == 1_000_000]
    is_micros = platform.isin(micros)
    return (is_micros & compared(1_000_000)) | ((~is_micros | platform.isNull()) & compared(1_000))
