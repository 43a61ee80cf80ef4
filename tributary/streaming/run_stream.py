"""Run results folded in once per log row, instead of a high-water mark.

Each micro-batch is appended under its key, (query, batch id), and counts once its key is
in the ledger; the current state is the newest row per (invocation, node) over the batches
in the ledger.  "Newest" does not depend on the order of arrival, so late and repeated
deliveries give the same state, and no batch ever rewrites what is stored.  ``compact``
writes the current state as a snapshot that lists the batches it covers; afterwards only
the batches missing from that list are read, whenever they were started.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.observability import newest_runs, stage_run_results
from tributary.schemas import RUN_RESULTS, struct
from tributary.sources.raw import DEFAULT_LOAD_ID
from tributary.sources.sinks import current_version

STAGED_RUNS = struct(
    "invocation_id string, dlt_load_id string, node_id string, node_name string, "
    "resource_type string, run_result_status string, run_result_message string, "
    "rows_affected bigint, execution_time_seconds double, run_started_at timestamp, "
    "run_completed_at timestamp, extracted_at timestamp"
)
_BATCH = T.StructField("batch", T.StringType())


def runs_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = RUN_RESULTS) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


LEDGER, COVERED = "_ledger", "_covered.json"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def ledger(spark: SparkSession, log_path: str) -> list[str]:
    """Keys of the committed batches of a log."""
    hadoop, fs = _fs(spark, log_path)
    folder = hadoop.Path(f"{log_path}/{LEDGER}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def stage_runs(log_path: str, batch: DataFrame, key: str, load_id: str = DEFAULT_LOAD_ID) -> None:
    """Write a batch's rows under its key; they count only once ``commit_runs`` lists them."""
    rows = stage_run_results(batch, None, load_id).withColumn("batch", F.lit(key))
    rows.write.mode("append").partitionBy("batch").parquet(log_path)


def commit_runs(spark: SparkSession, log_path: str, key: str) -> bool:
    """Enter a staged batch in the ledger; False when it was there already (a replay)."""
    hadoop, fs = _fs(spark, log_path)
    target = hadoop.Path(f"{log_path}/{LEDGER}/{key}")
    if fs.exists(target):
        return False
    fs.create(target, False).close()
    return True


def fold_runs(
    log_path: str, batch: DataFrame, load_id: str = DEFAULT_LOAD_ID, query: str | None = None, batch_id: int | None = None
) -> None:
    """Append a batch under the key (query, batch id), or a fresh one, and enter it in the ledger.

    A micro-batch that is delivered again after a failure has the same key: it was either
    not in the ledger yet (its rows are written again, and the newest row per key makes the
    copies harmless) or it is, and nothing is written.
    """
    spark = batch.sparkSession
    key = f"{query}-{batch_id:020d}" if query is not None and batch_id is not None else uuid.uuid4().hex
    if key in set(ledger(spark, log_path)):
        return
    stage_runs(log_path, batch, key, load_id)
    commit_runs(spark, log_path, key)


def _log(spark: SparkSession, log_path: str, keys: list[str]) -> DataFrame:
    """Rows of the listed batches only; an empty typed frame when there are none."""
    schema = T.StructType([*STAGED_RUNS.fields, _BATCH])
    if not keys:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(log_path).where(F.col("batch").isin(keys))


def current_runs(spark: SparkSession, log_path: str, snapshot_path: str | None = None) -> DataFrame:
    """Newest row per key over the committed log, or over a snapshot and the batches it does not list.

    With a snapshot only the batches missing from its list are read, whenever they were
    started; batch folders that a snapshot lists may be removed.
    """
    return _current(spark, log_path, snapshot_path, ledger(spark, log_path)).drop("batch")


def _covered(spark: SparkSession, version: str) -> set[str]:
    hadoop, fs = _fs(spark, version)
    stream = fs.open(hadoop.Path(f"{version}/{COVERED}"))
    try:
        return set(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _current(spark: SparkSession, log_path: str, snapshot_path: str | None, keys: list[str]) -> DataFrame:
    version = None if snapshot_path is None else current_version(spark, snapshot_path)
    if version is None:
        return newest_runs(_log(spark, log_path, keys))
    snapshot = spark.read.schema(T.StructType([*STAGED_RUNS.fields, _BATCH])).parquet(version)
    tail = [k for k in keys if k not in _covered(spark, version)]
    return newest_runs(snapshot.unionByName(_log(spark, log_path, tail)))


def compact(spark: SparkSession, log_path: str, snapshot_path: str) -> str:
    """Replace the snapshot by the current state of the batches in the ledger now.

    The snapshot lists those batches; a batch that enters the ledger later, even one that
    was started before, is read as the tail.
    """
    keys = ledger(spark, log_path)
    state = _current(spark, log_path, snapshot_path, keys).withColumn("batch", F.lit("snapshot"))
    stamp = f"{time.time_ns():020d}"
    staged, version = (f"{snapshot_path.rstrip('/')}/{name}={stamp}" for name in ("_staged", "version"))
    state.write.mode("errorifexists").parquet(staged)
    hadoop, fs = _fs(spark, staged)
    out = fs.create(hadoop.Path(f"{staged}/{COVERED}"), False)
    out.write(bytearray(json.dumps(keys).encode("utf-8")))
    out.close()
    if not fs.rename(hadoop.Path(staged), hadoop.Path(version)):  # rows and list appear together
        raise OSError(f"{staged} could not become {version}")
    return version


def run_results_stream(
    runs: DataFrame,
    log_path: str,
    checkpoint: str,
    load_id: str = DEFAULT_LOAD_ID,
    available_now: bool = True,
    query: str = "runs",
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        fold_runs(log_path, batch, load_id, query=query, batch_id=batch_id)

    writer = runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
