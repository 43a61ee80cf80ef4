"""Queries by display alias, with per-dimension transformations and formula measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tributary.functions.casts import to_moment, to_number

NUMERIC_AGGREGATES = ("sum", "avg", "min", "max")
COUNT_ALL = "_count"  # fixed value: source name meaning "count rows"


@dataclass(frozen=True)
class AliasDimension:
    source: str
    transformation: str | None = None
    temporal_text: bool = False

    def column(self) -> Column:
        if self.transformation:
            return F.expr(self.transformation)
        value = F.col(f"`{self.source}`")
        return to_moment(value) if self.temporal_text else value


@dataclass(frozen=True)
class AliasMeasure:
    """An aggregate of a source column, or a formula in SQL."""

    source: str | None = None
    agg: str | None = None
    formula: str | None = None

    def column(self) -> Column:
        if self.formula:
            return F.expr(self.formula)
        if self.source == COUNT_ALL:
            return F.count(F.lit(1))
        value = F.col(f"`{self.source}`")
        if self.agg in NUMERIC_AGGREGATES:
            return getattr(F, self.agg)(to_number(value))
        if self.agg == "count":
            return F.count(value)
        if self.agg == "count_distinct":
            return F.count_distinct(value)
        raise ValueError(f"unknown aggregation '{self.agg}'")


@dataclass(frozen=True)
class AliasModel:
    df: DataFrame
    dimensions: Mapping[str, AliasDimension]
    measures: Mapping[str, AliasMeasure] = field(default_factory=dict)

    def query(
        self,
        dimensions: Sequence[str] = (),
        measures: Sequence[str] = (),
        filters: Sequence[str | Column] = (),
        order_by: Sequence[str | Column] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """Group by every dimension, also without measures (distinct rows)."""
        if not dimensions and not measures:
            raise ValueError("Query must specify at least one dimension or measure")
        for kind, wanted, known in (("dimension", dimensions, self.dimensions), ("measure", measures, self.measures)):
            for alias in wanted:
                if alias not in known:
                    raise ValueError(f"Unknown {kind} alias: {alias}")
        rows = self.df
        for condition in filters:
            rows = rows.filter(condition)
        keys = [self.dimensions[a].column().alias(a) for a in dimensions]
        values = [self.measures[a].column().alias(a) for a in measures]
        result = rows.groupBy(*keys).agg(*values) if values else rows.select(*keys).distinct()
        if order_by:
            result = result.orderBy(*[F.expr(o) if isinstance(o, str) else o for o in order_by])
        return result if limit is None else result.limit(limit)


def date_safe(df: DataFrame) -> DataFrame:
    """Temporal columns as ISO date text, for result rows."""
    temporal = {"date", "timestamp", "timestamp_ntz"}
    return df.select(
        [
            F.date_format(f"`{name}`", "yyyy-MM-dd").alias(name) if kind in temporal else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
