"""Route text questions to models by keywords, as a batch job over a text column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Keywords per model, in tie-breaking order.
KEYWORDS = {
    "ad_performance": ("ad", "ads", "spend", "impression", "click", "ctr", "cpc", "cpm", "campaign spend"),
    "orders": ("order", "revenue", "aov", "purchase", "transaction", "total_price", "sales"),
    "sessions": ("session", "conversion", "bounce", "traffic", "attribution", "utm"),
    "events": ("event", "pageview", "funnel", "page_view", "add_to_cart", "checkout"),
    "users": ("user", "customer", "identity", "anonymous", "visitor", "resolved"),
    "campaigns": ("campaign", "campaign_name", "campaign_status"),
}


def keyword_score(lowered: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in the text."""
    hits = [F.contains(lowered, F.lit(word)).cast("int") for word in keywords]
    return reduce(Column.__add__, hits)


def route_questions(df: DataFrame, text: str, available: Sequence[str] | None = None) -> DataFrame:
    """Add ``model`` and ``score``: best score wins, first model on ties.

    Whole texts are searched; a text without any keyword goes to the first available model.
    """
    models = list(available) if available is not None else list(KEYWORDS)
    scored = [m for m in KEYWORDS if m in models]
    lowered = df.withColumn("_lowered", F.coalesce(F.lower(text), F.lit("")))
    scores = lowered.withColumns({f"_score_{m}": keyword_score(F.col("_lowered"), KEYWORDS[m]) for m in scored})
    best = F.greatest(*[F.col(f"_score_{m}") for m in scored], F.lit(0))
    choice = F.lit(models[0] if models else None)
    for m in reversed(scored):
        choice = F.when((F.col(f"_score_{m}") == best) & (best > 0), m).otherwise(choice)
    return scores.withColumns({"model": choice, "score": best}).drop("_lowered", *[f"_score_{m}" for m in scored])
