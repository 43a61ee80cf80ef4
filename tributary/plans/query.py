"""Structured queries: validated requests that become DataFrame plans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tributary.functions.casts import epoch_bound
from tributary.plans.model import Join, SemanticLayer, SemanticModel, prefix_columns

# Row limits of a preview.
DEFAULT_LIMIT = 1000
MAX_LIMIT = 10_000


def _values(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _between(column: Column, value: Any) -> Column:
    bounds = _values(value)
    if len(bounds) < 2:
        raise ValueError("BETWEEN needs two values")
    return column.between(F.lit(bounds[0]), F.lit(bounds[1]))


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "IN": lambda c, v: c.isin(_values(v)),
    "LIKE": lambda c, v: c.like(v),
    "BETWEEN": _between,
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "op", self.op.upper())
        if self.op not in OPERATORS:
            raise ValueError(f"Invalid operator '{self.op}'. Must be one of: {', '.join(sorted(OPERATORS))}")


@dataclass(frozen=True)
class OrderBy:
    field: str
    dir: str = "asc"

    def __post_init__(self) -> None:
        if self.dir not in ("asc", "desc"):
            raise ValueError(f"Invalid order direction '{self.dir}'")

    def column(self) -> Column:
        name = f"`{self.field}`"
        return F.asc_nulls_last(name) if self.dir == "asc" else F.desc_nulls_last(name)


@dataclass(frozen=True)
class Request:
    model: str
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    calculated_measures: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    joins: tuple[str, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None


def _check(kind: str, wanted, valid, model: str) -> None:
    for name in wanted:
        if name not in valid:
            raise ValueError(f"Unknown {kind} '{name}' for model '{model}'. Valid: {', '.join(sorted(valid))}")


def validate(layer: SemanticLayer, request: Request) -> tuple[SemanticModel, list[SemanticModel]]:
    """Check every field before a plan is built; returns the model and its join targets."""
    model = layer.model(request.model)
    targets = [layer.model(name) for name in request.joins]
    for given, target in zip(request.joins, targets, strict=True):
        if target.name not in model.joins:
            raise ValueError(f"Unknown join target '{given}' for model '{request.model}'")
    dimensions = set(model.dimensions)
    for target in targets:
        dimensions |= {f"{target.name}.{d}" for d in target.dimensions}
    fields = dimensions | set(model.measures)
    _check("dimension", request.dimensions, dimensions, model.name)
    _check("measure", request.measures, model.measures, model.name)
    _check("calculated measure", request.calculated_measures, model.calculated, model.name)
    _check("filter field", [f.field for f in request.filters], fields | {"tenant_slug"}, model.name)
    _check("order_by field", [o.field for o in request.order_by], fields | set(model.calculated), model.name)
    return model, targets


def semantic_query(layer: SemanticLayer, tenant: str, request: Request) -> DataFrame:
    """Tenant filter, joins, filters, projection or grouping, order, limit."""
    model, targets = validate(layer, request)
    rows = model.df.filter(F.col("tenant_slug") == tenant)
    for target in targets:
        rows = _join(rows, target, model.joins[target.name], tenant, _fields_used(request))
    for f in request.filters:
        rows = rows.filter(OPERATORS[f.op](_field(model, f.field), f.value))
        for bound in _epoch_bounds(model, f):
            rows = rows.filter(bound)

    dims = [F.col(f"`{d}`").alias(d) for d in request.dimensions]
    aggregates = [model.measures[m].column() for m in request.measures]
    aggregates += [F.expr(model.calculated[c]).alias(c) for c in request.calculated_measures]
    order = [o.column() for o in request.order_by]

    if aggregates:
        selected = {*request.dimensions, *request.measures, *request.calculated_measures}
        missing = [o.field for o in request.order_by if o.field not in selected]
        if missing:
            raise ValueError(f"order_by fields {missing} must be selected in an aggregate query")
        result = rows.groupBy(*dims).agg(*aggregates)
        result = result.orderBy(*order) if order else result
    else:
        result = rows.orderBy(*order) if order else rows
        result = result.select(*dims) if dims else result
    return result if request.limit is None else result.limit(request.limit)


def preview(layer: SemanticLayer, tenant: str, request: Request) -> DataFrame:
    """The first rows of a request: its own limit up to ``MAX_LIMIT``, else ``DEFAULT_LIMIT``."""
    limit = DEFAULT_LIMIT if request.limit is None else request.limit
    if limit > MAX_LIMIT:
        raise ValueError(f"Limit cannot exceed {MAX_LIMIT}")
    return semantic_query(layer, tenant, replace(request, limit=limit))


def _epoch_bounds(model: SemanticModel, f: Filter) -> list[Column]:
    """Ranges of the epoch column that a filter on a date derived from it implies.

    They repeat the filter in a form that a scan can skip row groups by.
    """
    epoch = model.epochs.get(f.field)
    try:
        days = sorted(map(_midnight, _values(f.value))) if epoch else []
    except (TypeError, ValueError):  # not dates: the filter itself decides
        days = []
    if not days:
        return []
    day = dt.timedelta(days=1)
    least, most = {
        "=": (days[0], days[-1] + day),
        "IN": (days[0], days[-1] + day),
        "BETWEEN": (days[0], days[-1] + day),
        ">=": (days[0], None),
        ">": (days[0] + day, None),
        "<": (None, days[0]),
        "<=": (None, days[0] + day),
    }.get(f.op, (None, None))
    value, platform = F.col(f"`{epoch}`"), F.col("source_platform")
    bounds = [] if least is None else [epoch_bound(value, platform, least, since=True)]
    return bounds if most is None else [*bounds, epoch_bound(value, platform, most, since=False)]


def _midnight(value: Any) -> dt.datetime:
    day = dt.date.fromisoformat(value) if isinstance(value, str) else value
    if isinstance(day, dt.datetime) or not isinstance(day, dt.date):
        raise ValueError("not a date")
    return dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc)


def _field(model: SemanticModel, name: str) -> Column:
    measure = model.measures.get(name)
    return F.col(f"`{measure.source_column}`") if measure and measure.source_column else F.col(f"`{name}`")


def _fields_used(request: Request) -> set[str]:
    return {*request.dimensions, *(f.field for f in request.filters), *(o.field for o in request.order_by)}


def _join(rows: DataFrame, target: SemanticModel, join: Join, tenant: str, used: set[str]) -> DataFrame:
    """Join on all key pairs within the tenant; the target's columns get its name as prefix.

    No side is forced to be broadcast: a small dimension is by its measured size, a large
    one is sort-merge joined with skew handling.  A target with many rows per key is first
    reduced to its distinct keys and the fields the request uses, so a base row counts
    once for each of their values and sums of the base stay right.
    """
    side = prefix_columns(target.df.filter(F.col("tenant_slug") == tenant), target.name)
    if join.cardinality == "many":
        keys = [f"{target.name}.{right}" for _, right in join.on]
        side = side.select(*[f"`{c}`" for c in side.columns if c in keys or c in used]).distinct()
    condition = F.lit(True)
    for left, right in join.on:
        condition = condition & (F.col(f"`{left}`") == F.col(f"`{target.name}.{right}`"))
    return rows.join(side, condition, join.type)
