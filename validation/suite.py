"""All cases and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import validation.hub_cases  # noqa: F401
import validation.observability_cases  # noqa: F401
import validation.semantic_cases as semantic_cases
import validation.star_cases  # noqa: F401
from tributary.session import apply_settings


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by traffic source with revenue and conversion rate, for one tenant."""
    spark = apply_settings(spark)
    result = semantic_cases.ask(
        spark,
        sf_dir,
        "t0",
        model="sessions",
        dimensions=("traffic_source",),
        measures=("total_sessions", "session_revenue"),
        calculated_measures=("conversion_rate",),
    )
    return result.withColumn("session_revenue", F.round("session_revenue", 4))
