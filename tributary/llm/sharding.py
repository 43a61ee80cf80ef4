"""Sharding by vector bin packing: bytes, tokens and rows of the shards balanced together.

Equal texts form a group and stay in one shard, unless the group is larger than
``1 / SPLIT`` of a shard, when it is dealt in parts of that size by a hash of its ids.
Groups below that size that are still large are placed one by one; all others are first
pooled by hash into a fixed number of pools a shard.  So the packing, which runs on the
driver, sees a number of vectors that depends on the number of shards and not on the data:
each goes, largest first, to the shard whose residual capacity has the highest dot product
with it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tributary.llm.common import stored

DIMENSIONS = ("size", "tokens", "rows")
#: Pools a shard; a group is placed by itself above 1 / SINGLE, and split above 1 / SPLIT, of a shard.
POOLS, SINGLE, SPLIT = 64, 32, 4
#: Cells a shard for the numbering of its rows.
CELLS = 64
#: How much an imbalance of bytes, tokens and rows counts.
WEIGHTS = (4.0, 1.0, 1.0)


def pack(vectors: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each vector: largest first, to the highest dot product with what is left.

    Ties go to the lower shard.  A dimension without any content is ignored.
    """
    totals = vectors.sum(0)
    share = vectors / np.where(totals > 0, totals, 1) * shards
    room = np.ones((shards, vectors.shape[1])) * (totals > 0)
    where = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        where[i] = int(np.argmax(room @ (share[i] * weights)))
        room[where[i]] -= share[i]
    return where


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Identity, size, checksum, word count and group of every row; null texts count as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("k"),
        (F.octet_length(value) + 16).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("crc"),
        F.regexp_count(value, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(value).alias("g"),
    )


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, size, text_crc32, shard, slot)``: every row of ``docs`` in one shard.

    ``slot`` counts the rows of a shard from 0 without gaps, by a hash cell and then the
    key.  Null keys and repeated rows are placed like others (rows with equal text and
    equal key are one part of their group); an empty table gives no rows; columns other
    than ``key`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    rows = stored(units(docs, key, text), "units")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return spark.createDataFrame(
            [], f"`{key}` {docs.schema[key].dataType.simpleString()}, size long, text_crc32 long, shard int, slot long"
        )
    # share of a shard that a group takes in its largest dimension; at most 3 * shards * SINGLE groups pass
    share = F.greatest(*[F.col(d) * shards / F.lit(max(1, total[d])) for d in DIMENSIONS])
    large = rows.groupBy("g").agg(*sums).withColumn("share", share).where(F.col("share") > 1 / SINGLE).collect()
    first = shards * POOLS
    parts = []
    for r in sorted(large, key=lambda r: r["g"]):
        n = math.ceil(r["share"] * SPLIT) if r["share"] > 1 / SPLIT else 1
        parts.append((r["g"], first, n))
        first += n
    alone = spark.createDataFrame(parts, "g long, first int, n int")
    spread = F.xxhash64("k", "crc")
    placed = rows.join(F.broadcast(alone), "g", "left").select(
        "k",
        "size",
        "crc",
        "tokens",
        F.coalesce(
            F.col("first") + F.pmod(spread, F.col("n")).cast("int"), F.pmod(F.col("g"), F.lit(shards * POOLS)).cast("int")
        ).alias("atom"),
        F.pmod(F.xxhash64(spread), F.lit(CELLS)).cast("int").alias("cell"),
    )
    atoms = sorted(placed.groupBy("atom").agg(*sums).collect(), key=lambda r: r["atom"])
    where = pack(np.array([[r[d] for d in DIMENSIONS] for r in atoms], dtype=float), shards)
    shard_of = spark.createDataFrame(
        [(r["atom"], int(s)) for r, s in zip(atoms, where, strict=True)], "atom int, shard int"
    )
    placed = placed.join(F.broadcast(shard_of), "atom")
    counts = sorted(placed.groupBy("shard", "cell").count().collect())
    offsets, seen = [], {}
    for shard, cell, n in counts:
        offsets.append((shard, cell, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    offset = spark.createDataFrame(offsets, "shard int, cell int, offset long")
    order = Window.partitionBy("shard", "cell").orderBy("k", "crc", "size")
    return (
        placed.withColumn("rank", F.row_number().over(order))
        .join(F.broadcast(offset), ["shard", "cell"])
        .select(
            F.col("k").alias(key),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("offset") + F.col("rank") - 1).alias("slot"),
        )
    )


def shard_law(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`assign_shards` under the law ``bytes``: the shards' sizes are near equal."""
    placed = assign_shards(docs, shards, key, text)
    return placed.select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
