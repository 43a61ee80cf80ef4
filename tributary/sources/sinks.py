"""Sinks: the hub, materialised results, persistence kinds, snapshots."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tributary.sources.local import local_frame
from tributary.schemas import HUB, HUB_DIGEST, STAR

HUB_PARTITIONS = ("tenant_slug", "source_platform")


def write_hub(df: DataFrame, path: str, one_folder: bool = False) -> None:
    """Append hub rows, partitioned by tenant and platform; history is never rewritten.

    Rows of several folders are rebalanced by folder first: adaptive execution splits a
    folder that holds much of the data over many tasks and merges small ones, so one
    large tenant is not one task and small tenants do not leave a file per task.  When
    all rows belong to one folder they are written where they are, without a shuffle.
    """
    if HUB_DIGEST not in df.columns:
        df = df.withColumn(HUB_DIGEST, F.md5("raw_data_payload"))
    if not one_folder:
        df = df.hint("rebalance", *map(F.col, HUB_PARTITIONS))
    df.write.mode("append").partitionBy(*HUB_PARTITIONS).parquet(path)


def stored_hub_schema() -> T.StructType:
    """Physical layout: the contract plus the digest."""
    return T.StructType([*HUB.fields, T.StructField(HUB_DIGEST, T.StringType())])


def read_hub(spark: SparkSession, path: str, digest: bool = False, evolve: bool = False) -> DataFrame:
    """The seven contract columns (plus the digest on request).

    ``evolve`` adds columns that later pushes introduced; the default reads the fixed
    contract without opening every file footer.
    """
    if evolve:
        return spark.read.option("mergeSchema", "true").parquet(path)
    stored = spark.read.schema(stored_hub_schema()).parquet(path)
    return stored.select(*HUB.fieldNames(), *([HUB_DIGEST] if digest else []))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialize(df: DataFrame, name: str) -> None:
    """Persist a result as a table, replacing an earlier one."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def persist(df: DataFrame, name: str, kind: str) -> DataFrame:
    """kinds: ``table`` (rebuilt), ``view``, ``incremental`` (appended), ``inline``."""
    spark = df.sparkSession
    if kind == "inline":
        return df
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        materialize(df, name)
    elif kind == "incremental":
        df.write.mode("append").format("parquet").saveAsTable(name)
    else:
        raise ValueError(f"unknown persistence kind '{kind}'")
    return spark.table(name)


def empty_star(spark: SparkSession, table: str) -> DataFrame:
    """Typed zero-row relation for a star table without any enabled source."""
    return local_frame(spark, [], STAR[table])


def conform(df: DataFrame, table: str, **expressions: str) -> DataFrame:
    """A star table's columns and types from a frame.

    ``expressions`` gives SQL for columns that are computed or named differently; other
    columns are taken by name and missing ones are NULL.
    """
    present = {c: f"`{c}`" for c in df.columns} | expressions
    return df.selectExpr(
        [
            f"CAST({present.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in STAR[table].fields
        ]
    )


#: Folder of a partitioned version that holds its manifests, and the generation column.
MANIFESTS, GENERATION = "_manifests", "gen"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, version: str) -> tuple[int, dict] | None:
    """The newest manifest of a partitioned version: its number and ``{value: generation}``."""
    hadoop, fs = _fs(spark, version)
    folder = hadoop.Path(f"{version}/{MANIFESTS}")
    if not fs.exists(folder):
        return None
    numbers = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
    if not numbers:
        return None
    newest = max(numbers)
    stream = fs.open(hadoop.Path(f"{version}/{MANIFESTS}/{newest:020d}.json"))
    try:
        body = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return newest, body


def _put_manifest(spark: SparkSession, version: str, number: int, body: dict) -> bool:
    """Create manifest ``number`` unless another writer has; the swap is this one file."""
    hadoop, fs = _fs(spark, version)
    target = hadoop.Path(f"{version}/{MANIFESTS}/{number:020d}.json")
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Exception as error:  # noqa: BLE001 - an existing file is reported this way
        if "exists" in str(error).lower():
            return False
        raise
    out.write(bytearray(json.dumps(body).encode("utf-8")))
    out.close()
    return True


def _generation_values(spark: SparkSession, folder: str, column: str) -> list:
    """Partition values written below one generation folder (one entry a tenant: few)."""
    hadoop, fs = _fs(spark, folder)
    if not fs.exists(hadoop.Path(folder)):
        return []
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    out = []
    for status in fs.listStatus(hadoop.Path(folder)):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            value = unescape(name[len(column) + 1 :])
            out.append(None if value == NULL_FOLDER else value)
    return out


NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def overwrite_current(df: DataFrame, path: str, *partition_by: str) -> str:
    """Replace a snapshot: write a new version folder, leave the old one readable.

    A job may therefore read the current snapshot while it computes the next one, and a
    lost executor or a failed job leaves the previous version as the current one.  A
    partitioned version is written as its first generation and described by manifest 1,
    so that single partitions can later be replaced by a manifest swap.
    """
    spark = df.sparkSession
    version = f"{path.rstrip('/')}/version={time.time_ns():020d}"
    if not partition_by:
        df.write.mode("errorifexists").parquet(version)
        return version
    (column,) = partition_by
    generation = time.time_ns()
    df.write.mode("errorifexists").partitionBy(column).parquet(f"{version}/{GENERATION}={generation}")
    values = _generation_values(spark, f"{version}/{GENERATION}={generation}", column)
    body = {"column": column, "parts": [[v, generation] for v in values]}
    _put_manifest(spark, version, 1, body)
    hadoop, fs = _fs(spark, version)
    fs.create(hadoop.Path(f"{version}/_SUCCESS"), True).close()  # the version is complete
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest committed version."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(hadoop.Path(f"{path.rstrip('/')}/version=*/_SUCCESS")) or []
    return max((m.getPath().getParent().toString() for m in marks), default=None)


def replace_partitions(df: DataFrame, version: str, column: str, values: list[str], attempts: int = 50) -> None:
    """Replace the partitions ``column`` = each of ``values``; one without rows in ``df`` ends up empty.

    The new rows go to a generation folder of their own; then one new manifest names it
    for the listed values and keeps every other value where it was.  Creating that file
    is the swap: a reader before it sees the old partitions, after it the new ones, and a
    job killed before it leaves the old state.  A second writer that took the manifest
    number first is read back and the listed values are laid over its manifest.
    """
    spark = df.sparkSession
    generation = time.time_ns()
    folder = f"{version}/{GENERATION}={generation}"
    df.write.mode("errorifexists").partitionBy(column).parquet(folder)
    written = set(_generation_values(spark, folder, column))
    listed = set(values)
    for _ in range(attempts):
        now = manifest(spark, version)
        if now is None:
            raise ValueError(f"{version} has no manifest: write it with overwrite_current first")
        number, body = now
        parts = [p for p in body["parts"] if p[0] not in listed]
        parts += [[v, generation] for v in sorted(written & listed, key=lambda v: (v is None, v or ""))]
        if _put_manifest(spark, version, number + 1, {"column": column, "parts": parts}):
            return
    raise RuntimeError(f"no manifest number for {version} after {attempts} attempts")


def read_version(spark: SparkSession, version: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of one version; a partitioned one through its newest manifest.

    The manifest becomes a filter on the generation and partition columns, which Spark
    applies to folder names, so only the named generation of each partition is opened.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    now = manifest(spark, version)
    if now is None:
        return reader.parquet(version)
    _, body = now
    column = body["column"]
    by_generation: dict[int, list] = {}
    for value, generation in body["parts"]:
        by_generation.setdefault(generation, []).append(value)
    named = F.lit(False)
    for generation, members in by_generation.items():
        plain = [m for m in members if m is not None]
        hit = F.col(column).isin(plain) if plain else F.lit(False)
        if len(plain) < len(members):
            hit = hit | F.col(column).isNull()
        named = named | ((F.col(GENERATION) == F.lit(generation)) & hit)
    stored = reader.option("basePath", version).parquet(version)
    columns = schema.fieldNames() if schema is not None else [c for c in stored.columns if c != GENERATION]
    return stored.where(named).select(*columns)


def read_current(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Newest committed version; an empty typed frame when there is none yet."""
    version = current_version(spark, path)
    if version is not None:
        return read_version(spark, version, schema)
    if schema is None:
        raise FileNotFoundError(path)
    return local_frame(spark, [], schema)
