"""Semantic models bound to star DataFrames, and the fluent query form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tributary.functions.casts import epoch_to_timestamp
from tributary.operators import catalog
from tributary.operators.factories import TABLE_OF
from tributary.schemas import COLUMNS, catalogue_type
from tributary.sources.local import local_frame


@dataclass(frozen=True)
class Dimension:
    name: str
    type: str = "string"
    is_time: bool = False
    expr: Column | None = None

    def column(self) -> Column:
        return F.col(self.name) if self.expr is None else self.expr


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str = "sum"
    source_column: str | None = None
    type: str = "number"
    expr: Column | None = None

    def source(self) -> Column:
        return F.col(self.source_column or self.name)

    def over(self, value: Column) -> Column:
        """The aggregate applied to a value expression."""
        try:
            return AGGREGATES[self.agg](value)
        except KeyError:
            raise ValueError(f"unknown aggregation '{self.agg}' of measure '{self.name}'") from None

    def column(self) -> Column:
        return (self.over(self.source()) if self.expr is None else self.expr).alias(self.name)


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "count": F.count,
    "count_distinct": F.count_distinct,
    "min": F.min,
    "max": F.max,
}


@dataclass(frozen=True)
class Join:
    to: str
    on: tuple[tuple[str, str], ...]
    type: str = "left"
    cardinality: str = "one"


@dataclass(frozen=True)
class SemanticModel:
    """One subject: a DataFrame with named dimensions and measures.

    Nothing runs until an action on the DataFrame a query returns.
    """

    name: str
    table: str
    df: DataFrame
    dimensions: Mapping[str, Dimension]
    measures: Mapping[str, Measure]
    calculated: Mapping[str, str] = field(default_factory=dict)
    joins: Mapping[str, Join] = field(default_factory=dict)
    label: str = ""
    description: str = ""
    #: Derived date dimensions and the epoch column each comes from.
    epochs: Mapping[str, str] = field(default_factory=dict)

    # fluent form -------------------------------------------------------------
    def filter(self, condition: Column | str) -> SemanticModel:
        return replace(self, df=self.df.filter(condition))

    def for_tenant(self, tenant: str) -> SemanticModel:
        return self.filter(F.col("tenant_slug") == tenant)

    def with_dimensions(self, **exprs: Column) -> SemanticModel:
        added = {name: Dimension(name, expr=e) for name, e in exprs.items()}
        return replace(self, dimensions={**self.dimensions, **added})

    def with_measures(self, **exprs: Column) -> SemanticModel:
        added = {name: Measure(name, expr=e) for name, e in exprs.items()}
        return replace(self, measures={**self.measures, **added})

    def join_one(self, other: SemanticModel, join: Join) -> SemanticModel:
        """Left join another model; its fields become ``{other}.{field}``.

        The tenant is part of the key.  The joined side loses its shared columns, so no
        name is ambiguous.
        """
        prefixed = prefix_columns(other.df, other.name)
        condition = F.col("tenant_slug") == F.col(f"`{other.name}.tenant_slug`")
        for left, right in join.on:
            condition = condition & (F.col(left) == F.col(f"`{other.name}.{right}`"))
        joined = self.df.join(prefixed, condition, join.type).drop(f"{other.name}.tenant_slug")
        dims = {
            f"{other.name}.{d.name}": Dimension(f"{other.name}.{d.name}", d.type, d.is_time, F.col(f"`{other.name}.{d.name}`"))
            for d in other.dimensions.values()
            if d.name not in catalog.SHARED_COLUMNS
        }
        measures = {
            f"{other.name}.{m.name}": replace(
                m,
                name=f"{other.name}.{m.name}",
                expr=m.over(F.col(f"`{other.name}.{m.source_column or m.name}`")),
            )
            for m in other.measures.values()
            if m.expr is None
        }
        return replace(
            self, df=joined, dimensions={**self.dimensions, **dims}, measures={**self.measures, **measures}
        )

    def group_by(self, *names: str) -> Grouped:
        return Grouped(self, tuple(self.dimension(n) for n in names))

    def aggregate(self, *names: str, **exprs: Column) -> DataFrame:
        return self.group_by().aggregate(*names, **exprs)

    def dimension(self, name: str) -> Dimension:
        if name not in self.dimensions:
            raise ValueError(f"Unknown dimension '{name}' for model '{self.name}'")
        return self.dimensions[name]

    def measure_column(self, name: str) -> Column:
        if name in self.measures:
            return self.measures[name].column()
        if name in self.calculated:
            return F.expr(self.calculated[name]).alias(name)
        raise ValueError(f"Unknown measure '{name}' for model '{self.name}'")

    def default_breakdown(self, rows: int = 50) -> DataFrame:
        """First dimension by first measure, first rows only (a preview).

        Ordered, so the preview does not depend on partitioning.
        """
        first_dim, first_measure = next(iter(self.dimensions)), next(iter(self.measures))
        result = self.group_by(first_dim).aggregate(first_measure)
        return result.orderBy(F.asc_nulls_last(first_dim)).limit(rows)


@dataclass(frozen=True)
class Grouped:
    model: SemanticModel
    keys: tuple[Dimension, ...]

    def aggregate(self, *names: str, **exprs: Column) -> DataFrame:
        columns = [self.model.measure_column(n) for n in names]
        columns += [e.alias(n) for n, e in exprs.items()]
        if not columns:
            raise ValueError("aggregate needs at least one measure")
        keys = [k.column().alias(k.name) for k in self.keys]
        return self.model.df.groupBy(*keys).agg(*columns)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in df.columns])


class SemanticLayer:
    """Models of the star tables, built from their schemas and optional overlays.

    ``frames`` maps subject to a star DataFrame for all tenants.  Only schema metadata
    is looked at; the catalogue rows involved number tables times columns.
    """

    def __init__(self, spark: SparkSession, models: Mapping[str, SemanticModel]):
        self.spark = spark
        self.models = dict(models)

    def model(self, name: str) -> SemanticModel:
        """By subject or by table name."""
        if name in self.models:
            return self.models[name]
        for model in self.models.values():
            if name == model.table or name.endswith(f"__{model.name}"):
                return model
        raise ValueError(f"Model '{name}' not found in config")

    @classmethod
    def from_frames(
        cls,
        spark: SparkSession,
        frames: Mapping[str, DataFrame],
        tenant: str = "all",
        overlay_columns: DataFrame | None = None,
        overlay_tables: DataFrame | None = None,
        overlay_calcs: DataFrame | None = None,
        overlay_joins: DataFrame | None = None,
    ) -> SemanticLayer:
        """The layer of one tenant, or of all alike."""
        overlays = (overlay_columns, overlay_tables, overlay_calcs, overlay_joins)
        return cls.for_tenants(spark, frames, [tenant], *overlays)[tenant]

    @classmethod
    def for_tenants(
        cls,
        spark: SparkSession,
        frames: Mapping[str, DataFrame],
        tenants: Iterable[str],
        overlay_columns: DataFrame | None = None,
        overlay_tables: DataFrame | None = None,
        overlay_calcs: DataFrame | None = None,
        overlay_joins: DataFrame | None = None,
    ) -> dict[str, SemanticLayer]:
        """A layer per tenant, each with its own overlays, from one catalogue job for all of them."""
        tenants = list(tenants)
        columns = columns_of_frames(spark, frames, *tenants)
        classified = catalog.classify(columns)
        metadata = catalog.column_metadata(classified, overlay_columns, overlay_tables)
        calcs = catalog.infer_calc_measures(columns)
        if overlay_calcs is not None:
            calcs = catalog.merge_calc_measures(calcs, overlay_calcs)
        joins = catalog.infer_joins(columns)
        if overlay_joins is not None:
            joins = catalog.merge_joins(joins, overlay_joins)
        details = catalog.model_details(metadata, calcs, catalog.join_cardinality(joins))
        described = {(r["tenant_slug"], r["subject"]): r for r in details.coalesce(1).collect()}
        return {
            t: cls(spark, {s: _bind(described[t, s], df) for s, df in frames.items() if (t, s) in described})
            for t in tenants
        }


def columns_of_frames(spark: SparkSession, frames: Mapping[str, DataFrame], *tenants: str) -> DataFrame:
    """*columns* frame of a set of star frames for each tenant, from their schemas."""
    rows = []
    for subject, df in frames.items():
        prefix = TABLE_OF.get(subject, f"fct_{subject}").split("_", 1)[0]
        kind = "fact" if prefix == "fct" else "dimension"
        for position, f in enumerate(df.schema.fields, start=1):
            data_type = catalogue_type(f.name, f.dataType.simpleString())
            for tenant in tenants:
                rows.append((tenant, kind, subject, f"{prefix}_{tenant}__{subject}", f.name, data_type, position))
    return local_frame(spark, rows, COLUMNS)


def _bind(row, df: DataFrame) -> SemanticModel:
    dimensions = {d["name"]: Dimension(d["name"], d["type"], d["is_time_dimension"]) for d in row["dimensions"]}
    epochs = {}
    for d in row["dimensions"]:
        if d["type"] == "timestamp_epoch":
            dated = _date_name(d["name"])
            if dated in dimensions and dated not in df.columns:
                moment = epoch_to_timestamp(F.col(d["name"]), F.col("source_platform"))
                df = df.withColumn(dated, F.to_date(moment))
                epochs[dated] = d["name"]
    measures = {m["name"]: Measure(m["name"], m["agg"], m["source_column"], m["type"]) for m in row["measures"]}
    on: dict[str, list] = {}
    for j in row["joins"] or []:
        on.setdefault(j["to"], []).append(j)
    joins = {
        to: Join(to, tuple((p["left_on"], p["right_on"]) for p in pairs), pairs[0]["type"], pairs[0]["cardinality"])
        for to, pairs in on.items()
    }
    return SemanticModel(
        name=row["subject"],
        table=row["table_name"],
        df=df,
        dimensions=dimensions,
        measures=measures,
        calculated={c["name"]: c["sql"] for c in row["calculated_measures"] or []},
        joins=joins,
        label=row["label"],
        description=row["description"],
        epochs=epochs,
    )


def _date_name(name: str) -> str:
    dated = name.replace("_timestamp", "_date").replace("_ts", "_date")
    return dated if dated != name else f"{name}_date"


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types of a result."""
    return list(df.dtypes)


def names(items: Iterable) -> list[str]:
    return [i.name for i in items]
