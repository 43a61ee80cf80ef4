"""Surrogate keys and schema fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tributary.schemas import landing_type

# The null marker and separator every stored key was built with.
NULL_MARKER = "_dbt_utils_surrogate_key_null_"
KEY_SEPARATOR = "-"
# Loader bookkeeping columns that never enter a fingerprint.
LOADER_PREFIXES = ("_dlt", "_airbyte")


def surrogate_key(*parts: Column | str) -> Column:
    """md5 over the parts as text, nulls replaced by a marker."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit(NULL_MARKER)) for p in parts]
    return F.md5(F.concat_ws(KEY_SEPARATOR, *texts))


def schema_fingerprint(schema: T.StructType | Iterable[tuple[str, str]]) -> str:
    """md5 hex of the sorted ``name:type`` list of one schema (driver-side metadata)."""
    if isinstance(schema, T.StructType):
        pairs = [(f.name, landing_type(f.dataType.simpleString())) for f in schema.fields]
    else:
        pairs = list(schema)
    kept = sorted(p for p in pairs if not p[0].startswith(LOADER_PREFIXES))
    return hashlib.md5("|".join(f"{n}:{t}" for n, t in kept).encode()).hexdigest()


def fingerprint_tables(columns: DataFrame, by: list[str]) -> DataFrame:
    """Fingerprint of every table in a *columns* frame (column_name, data_type rows).

    A group holds one table's columns, so the collected list is bounded by table width.
    """
    loader_column = F.lit(False)
    for prefix in LOADER_PREFIXES:
        loader_column = loader_column | F.col("column_name").startswith(prefix)
    pair = F.when(~loader_column, F.struct("column_name", "data_type"))
    signature = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(pair)),
            lambda c: F.concat_ws(":", c["column_name"], c["data_type"]),
        ),
        "|",
    )
    return columns.groupBy(*by).agg(F.md5(signature).alias("source_schema_hash"))


def _col(part: Column | str) -> Column:
    return F.col(part) if isinstance(part, str) else part
