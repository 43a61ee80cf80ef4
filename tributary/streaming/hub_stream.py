"""Insert-only hub pushes from a stream of raw files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.hub import pack_payload, push_into


def raw_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def push_stream(
    raw: DataFrame,
    hub_path: str,
    checkpoint: str,
    tenant: str | Column,
    source: str | Column,
    schema_hash: str | Column,
    payload: list[str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
    trigger: str = "1 minute",
) -> StreamingQuery:
    """Pack and push every micro-batch.

    A batch replayed after a failure inserts nothing twice, because the push compares
    payload digests with the stored hub.  Re-delivered files are likewise skipped.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        packed = pack_payload(rows, tenant, source, schema_hash, payload=payload)
        push_into(batch.sparkSession, hub_path, packed)

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
