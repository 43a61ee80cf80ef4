"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.session import scratch_path

#: Rows and bytes of one Arrow batch: long texts make batches short, not large.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers hold, and let workers import this package.

    The search path helps workers on machines that hold the package where the driver does;
    elsewhere it is installed or shipped with ``--py-files`` as usual.
    """
    environment = spark.sparkContext.environment
    paths = [str(Path(__file__).resolve().parents[2]), *environment.get("PYTHONPATH", "").split(os.pathsep)]
    environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(p for p in paths if p))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, and nothing
    that is used twice is computed twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shelter(df: DataFrame, taken: set[str] = frozenset()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rename the columns of ``df`` that an operator uses for itself, and a way back.

    Clashing are the names in ``taken`` and every name that begins with two underscores.
    The returned function gives the renamed columns of a result their names again.
    """
    clash = [c for c in df.columns if c in taken or c.startswith("__")]
    if not clash:
        return df, lambda out: out
    aside = {c: f"__aside{i}_{c}" for i, c in enumerate(clash)}
    while any(a in df.columns for a in aside.values()):
        aside = {c: f"_{a}" for c, a in aside.items()}
    back = {a: c for c, a in aside.items()}
    moved = df.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in df.columns])
    return moved, lambda out: out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])


def map_rows(df: DataFrame, fn: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each Arrow batch; ``schema`` names what it returns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(fn(batch.to_pylist()), schema=out)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list ``(a, b)``: rows ``(node, component)``.

    Alternates large-star and small-star steps: every node links to the smallest node it
    knows until the edges form stars around the smallest node of each component.  A step
    is a hash aggregate and an equi join, so a hub node is combined on the map side and
    its join partition is split by adaptive execution.  Loops and repeated edges are
    allowed; nodes without an edge to another node are not returned; an empty list gives
    an empty frame.  Raises when the steps do not settle within ``max_rounds``.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        both = current.union(current.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = current.join(least, current["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct()
        # small star: u (the larger end) and its smaller neighbours move to the smallest of them
        floor = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(floor, large["a"] == floor["u"])
        small = (
            joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        after = stored(small, "edges")
        if after.count() == current.count() and after.join(current, ["a", "b"], "left_anti").isEmpty():
            break
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
