"""Digest index and commit log of a stored hub.

Beside the hub's data folders live three hidden folders (Spark's readers skip names that
begin with ``_``):

* ``_digests/prefix=XX`` holds the (tenant, platform, digest) keys of all stored rows,
  bucketed by the first ``PREFIX`` hex characters of the digest; each file is sorted by
  digest and carries a Parquet Bloom filter on it.  A push opens only the buckets of its
  own batch, and a small batch also names its digests, so the files' Bloom filters and
  statistics skip row groups that cannot hold them.
* ``_staging/<token>`` holds what a push has written but not yet made visible: its batch
  while it is compared, the new hub rows and their keys.
* ``_commits/<number>.json`` is created by put-if-absent (create without overwrite, atomic
  on HDFS and on stores with conditional writes).  The writer that creates number ``n``
  owns it and then moves its staged files into place.  A writer that finds the number
  taken reads the commits it missed: if one of them touches its buckets and
  (tenant, platform) pairs, it computes its new rows again against them; otherwise it
  tries the next number.  Two overlapping pushes of one batch therefore store it once.

A commit whose staged files are still waiting (the writer stopped after committing) is
finished by the next push before it reads anything: moving files is repeatable.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tributary.schemas import HUB, HUB_DIGEST
from tributary.sources.sinks import HUB_PARTITIONS, read_hub

#: Hex characters of a digest that name its index bucket (16 ** PREFIX buckets); distinct
#: digests of a batch up to which they are also pushed to the index scan; commit attempts.
PREFIX, LITERAL_DIGESTS, ATTEMPTS = 2, 2000, 50
#: Codec of rows and keys: half a payload is names, half a hex digest its alphabet.
CODEC = "zstd"
INDEX, COMMITS, STAGING, PUBLISHED = "_digests", "_commits", "_staging", "_published"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class Store:
    """The few file operations the log needs, through Hadoop's file system of the path."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.root = root.rstrip("/")
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.hadoop.Path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        if not self.exists(*parts):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(*parts))]

    def create_new(self, text: str, *parts: str) -> bool:
        """Write a file unless it exists; False when another writer has it."""
        target = self.path(*parts)
        if self.fs.exists(target):
            return False
        try:
            out = self.fs.create(target, False)
        except Exception as error:  # noqa: BLE001 - the store reports an existing file this way
            if "exists" in str(error).lower():
                return False
            raise
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        return True

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move_tree(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        """Move every data file below ``source`` to the same place below ``target``."""
        if not self.exists(*source):
            return
        base = self.path(*source).toUri().getPath().rstrip("/")
        files = self.fs.listFiles(self.path(*source), True)
        moves = []
        while files.hasNext():
            status = files.next()
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            relative = status.getPath().toUri().getPath()[len(base) + 1 :]
            moves.append((status.getPath(), self.path(*target, relative)))
        for src, dst in moves:
            self.fs.mkdirs(dst.getParent())
            if not self.fs.exists(dst) and not self.fs.rename(src, dst):
                raise OSError(f"{src} could not be moved to {dst}")
        self.fs.delete(self.path(*source), True)


def bucket() -> F.Column:
    return F.substring(F.col(HUB_DIGEST), 1, PREFIX)


def latest(store: Store) -> int:
    return max((int(n.split(".")[0]) for n in store.names(COMMITS) if n.endswith(".json")), default=0)


def commits(store: Store, after: int) -> list[dict]:
    return [
        json.loads(store.read(COMMITS, f"{n:020d}.json"))
        for n in range(after + 1, latest(store) + 1)
        if store.exists(COMMITS, f"{n:020d}.json")
    ]


def publish(store: Store, token: str) -> None:
    """Make a committed push visible: its keys into the index, its rows into the hub."""
    store.move_tree((STAGING, token, "index"), (INDEX,))
    store.move_tree((STAGING, token, "data"), ())
    store.fs.delete(store.path(STAGING, token), True)


def published(store: Store) -> int:
    """A commit number up to which every push is known to be visible."""
    return int(store.read(COMMITS, PUBLISHED)) if store.exists(COMMITS, PUBLISHED) else 0


def mark_published(store: Store, number: int) -> None:
    """Raise the mark; a writer that lowers it by a race only makes others look again."""
    if number > published(store):
        out = store.fs.create(store.path(COMMITS, PUBLISHED), True)
        out.write(bytearray(str(number).encode("ascii")))
        out.close()


def roll_forward(store: Store) -> None:
    """Finish every committed push after the mark whose files are still staged."""
    top = latest(store)
    for record in commits(store, published(store)):
        if store.exists(STAGING, record["token"]):
            publish(store, record["token"])
    mark_published(store, top)


def write_index(keys: DataFrame, path: str) -> None:
    """Append the distinct keys; they are dealt by bucket before copies go, in one shuffle."""
    (
        keys.withColumn("prefix", bucket())
        .repartition("prefix")
        .distinct()
        .sortWithinPartitions("prefix", HUB_DIGEST)
        .write.mode("append")
        .option("compression", CODEC)
        .option(f"parquet.bloom.filter.enabled#{HUB_DIGEST}", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as its keys need, not 1 MB a file
        .partitionBy("prefix")
        .parquet(path)
    )


def index_keys(spark: SparkSession, path: str, prefixes: list, digests: list | None = None) -> DataFrame:
    """Stored keys from the index buckets ``prefixes`` only; ``digests`` narrows the scan."""
    store = Store(spark, path)
    folders = [f"prefix={p if p is not None else NULL_FOLDER}" for p in prefixes]
    present = set(store.names(INDEX))
    opened = [f"{store.root}/{INDEX}/{f}" for f in folders if f in present]
    schema = f"tenant_slug string, source_platform string, {HUB_DIGEST} string"
    if not opened:
        return spark.createDataFrame([], schema)
    keys = spark.read.schema(schema).option("basePath", f"{store.root}/{INDEX}").parquet(*opened)
    if digests is not None:
        named = F.col(HUB_DIGEST).isin([d for d in digests if d is not None])
        keys = keys.where(named | F.col(HUB_DIGEST).isNull() if None in digests else named)
    return keys


@dataclass
class Pending:
    """A push that has staged its rows and waits for a commit number."""

    path: str
    batch: DataFrame
    version: int
    token: str
    prefixes: list
    pairs: list = field(default_factory=list)


def _backfill(store: Store, spark: SparkSession) -> None:
    """An index for a hub written before there was one: all stored keys, once."""
    if store.exists(INDEX) or not store.names() or store.exists(COMMITS):
        return
    data = [n for n in store.names() if not n.startswith(("_", "."))]
    if not data:
        return
    keys = read_hub(spark, store.root, digest=True).select("tenant_slug", "source_platform", HUB_DIGEST)
    write_index(keys, f"{store.root}/{INDEX}")


def _few_digests(rows: DataFrame, shape: list) -> list | None:
    """The distinct digests of a batch, or None when there are more than ``LITERAL_DIGESTS``.

    The estimates of ``shape`` spare a large batch the exact count; a pair's buckets share
    no digest, so its estimates add up.
    """
    estimates = Counter()
    for r in shape:
        estimates[tuple(r[c] for c in HUB_PARTITIONS)] += r["n"]
    if max(estimates.values(), default=0) > 2 * LITERAL_DIGESTS:
        return None
    named = rows.select(HUB_DIGEST).distinct().limit(LITERAL_DIGESTS + 1).collect()
    return [r[0] for r in named] if len(named) <= LITERAL_DIGESTS else None


def _ordered(prefixes: set) -> list:
    return sorted(prefixes, key=lambda v: (v is None, v or ""))


def prepare(spark: SparkSession, path: str, batch: DataFrame) -> Pending:
    """Stage the rows of ``batch`` that the hub, as of its latest commit, does not hold."""
    from tributary.operators.hub import push, with_digest

    store = Store(spark, path)
    roll_forward(store)
    _backfill(store, spark)
    version = latest(store)
    batch = with_digest(batch)
    token = uuid.uuid4().hex
    staged = f"{store.root}/{STAGING}/{token}"
    first = not store.names(INDEX)
    if first:
        # nothing is stored: every row is new and is written once, to the place it is moved from
        pairs = {tuple(r) for r in batch.select(*HUB_PARTITIONS).distinct().collect()}
        fresh = batch
    else:
        # the batch is read several times below and its payloads are dear: they are built once
        batch.write.mode("errorifexists").option("compression", CODEC).parquet(f"{staged}/batch")
        rows = spark.read.schema(batch.schema).parquet(f"{staged}/batch")
        # buckets and (tenant, platform) pairs of a batch: at most 16 ** PREFIX and few
        shape = rows.groupBy(bucket().alias("p"), *HUB_PARTITIONS).agg(F.approx_count_distinct(HUB_DIGEST).alias("n")).collect()
        prefixes, pairs = _ordered({r["p"] for r in shape}), {(r[1], r[2]) for r in shape}
        fresh = push(index_keys(spark, path, prefixes, _few_digests(rows, shape)), rows)
    contract = [*HUB.fieldNames(), HUB_DIGEST]
    fresh = fresh.select(*contract, *[c for c in fresh.columns if c not in contract])
    if len(pairs) > 1:  # large tenants are split over tasks, small ones merged
        fresh = fresh.hint("rebalance", *map(F.col, HUB_PARTITIONS))
    fresh.write.mode("errorifexists").option("compression", CODEC).partitionBy(*HUB_PARTITIONS).parquet(f"{staged}/data")
    store.fs.delete(store.path(STAGING, token, "batch"), True)
    written = spark.read.schema(fresh.schema).parquet(f"{staged}/data")
    if first:
        prefixes = _ordered({r[0] for r in written.select(bucket()).distinct().collect()})
    write_index(written.select("tenant_slug", "source_platform", HUB_DIGEST), f"{staged}/index")
    pairs = sorted(pairs, key=repr)
    return Pending(path, batch, version, token, prefixes, [list(p) for p in pairs])


def _overlaps(record: dict, pending: Pending) -> bool:
    return bool(set(record["prefixes"]) & set(pending.prefixes)) and bool(
        {tuple(p) for p in record["pairs"]} & {tuple(p) for p in pending.pairs}
    )


def commit(spark: SparkSession, pending: Pending) -> int:
    """Take the next commit number for ``pending`` and publish it; returns the number."""
    store = Store(spark, pending.path)
    for _ in range(ATTEMPTS):
        number = pending.version + 1
        record = {"token": pending.token, "prefixes": pending.prefixes, "pairs": pending.pairs}
        if store.create_new(json.dumps(record), COMMITS, f"{number:020d}.json"):
            publish(store, pending.token)
            if published(store) == number - 1:
                mark_published(store, number)
            return number
        missed = commits(store, pending.version)
        if any(_overlaps(r, pending) for r in missed):
            store.fs.delete(store.path(STAGING, pending.token), True)
            pending = prepare(spark, pending.path, pending.batch)
        else:
            pending.version = latest(store)
    raise RuntimeError(f"no commit number after {ATTEMPTS} attempts")


def push_logged(spark: SparkSession, path: str, batch: DataFrame) -> int:
    """Insert the batch's new rows and their keys in one commit; returns its number."""
    return commit(spark, prepare(spark, path, batch))
