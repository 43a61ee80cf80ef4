"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are collapsed first, each with its smallest ids, so a vector that a third of
the rows repeat is one node.  Distinct vectors are dealt to shards by hash; each shard's
graph is built in one task of bounded size and stored as a row of flat arrays.  Blocks of
queries meet every shard, search its graph, score what they find on the original vectors
in double precision, and the shards' results are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tributary.llm.common import stored

#: Distinct vectors a shard, queries a block.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: Links of a node (twice as many on the ground level), and how wide building and searching look.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 64, 96

INDEX = (
    "dim int, shard int, nodes int, entry int, levels int, vectors binary, ids binary, ground binary, upper binary"
)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so nothing overflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def search_level(v: np.ndarray, links: np.ndarray, query: np.ndarray, starts, width: int) -> list[tuple[float, int]]:
    """The ``width`` nearest nodes found on one level, as (similarity, node), nearest first."""
    seen = np.zeros(len(v), dtype=bool)
    seen[list(starts)] = True
    best = [(float(v[s] @ query), s) for s in starts]
    heapq.heapify(best)
    todo = [(-s, n) for s, n in best]
    heapq.heapify(todo)
    while todo:
        near, node = heapq.heappop(todo)
        if len(best) >= width and -near < best[0][0]:
            break
        around = links[node]
        around = around[around >= 0]
        around = around[~seen[around]]
        if not len(around):
            continue
        seen[around] = True
        for s, n in zip((v[around] @ query).tolist(), around.tolist()):
            if len(best) < width:
                heapq.heappush(best, (s, n))
                heapq.heappush(todo, (-s, n))
            elif s > best[0][0]:
                heapq.heapreplace(best, (s, n))
                heapq.heappush(todo, (-s, n))
    return sorted(best, reverse=True)


def spread_out(v: np.ndarray, near: list[tuple[float, int]], most: int) -> list[int]:
    """Up to ``most`` of ``near``: those closer to the centre than to one already taken, then the nearest."""
    if len(near) <= most:
        return [n for _, n in near]
    nodes = [n for _, n in near]
    among = v[nodes] @ v[nodes].T
    closest = np.full(len(nodes), -2.0, dtype=among.dtype)
    taken, left = [], []
    for i, (s, _) in enumerate(near):
        if len(taken) == most:
            break
        if s > closest[i]:
            taken.append(i)
            np.maximum(closest, among[i], out=closest)
        else:
            left.append(i)
    return [nodes[i] for i in taken + left[: most - len(taken)]]


def build(v: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 3):
    """(entry, links of each level as flat rows of node numbers, -1 where there is none)."""
    n = len(v)
    draws = np.random.default_rng(seed).random(n)
    height = np.minimum((-np.log(1 - draws) / math.log(links)).astype(int), 8)
    levels = [np.full((n, 2 * links if k == 0 else links), -1, dtype=np.int32) for k in range(height.max() + 1)]
    entry, top = 0, int(height[0])
    for node in range(1, n):
        query, own = v[node], int(height[node])
        starts = [entry]
        for k in range(top, own, -1):
            starts = [search_level(v, levels[k], query, starts, 1)[0][1]]
        for k in range(min(top, own), -1, -1):
            near = search_level(v, levels[k], query, starts, width)
            chosen = spread_out(v, near, links)
            rows = levels[k]
            rows[node, : len(chosen)] = chosen
            for other in chosen:
                row = rows[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    held = [*row.tolist(), node]
                    ranked = sorted(zip((v[held] @ v[other]).tolist(), held), reverse=True)
                    row[:] = spread_out(v, ranked, rows.shape[1])
            starts = [m for _, m in near]
        if own > top:
            entry, top = node, own
    return entry, levels


def find(v: np.ndarray, entry: int, levels, query: np.ndarray, width: int) -> list[int]:
    starts = [entry]
    for k in range(len(levels) - 1, 0, -1):
        starts = [search_level(v, levels[k], query, starts, 1)[0][1]]
    return [n for _, n in search_level(v, levels[0], query, starts, width)]


def by_power_of_two(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component into [0.5, 1).

    Multiplying by a power of two is exact, so cosines of the scaled rows are those of the
    originals, bit for bit, where those do not overflow or underflow, and finite elsewhere.
    """
    _, exponent = np.frexp(np.abs(x).max(axis=-1, keepdims=True))
    return np.ldexp(x, -exponent)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query in double precision, each row by itself.

    Rows and query are scaled by powers of two first, so components of 1e200 or 1e-200
    give the cosine and not NaN or a division by zero.
    """
    vectors, query = by_power_of_two(vectors), by_power_of_two(query)
    size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * np.sqrt(np.einsum("j,j->", query, query))
    return np.einsum("ij,j->i", vectors, query) / size


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows ``(id, v array<double>, dim)``: null, empty, zero and non-finite vectors and null keys go."""
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), value.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)
    )
    return rows.withColumn("dim", F.size("v")).distinct()


def shard_index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of flat arrays for each shard, stored; every distinct vector is in one shard.

    Of the ids that share a vector the ``keep`` smallest are held, which is all that a search
    for one fewer can return.
    """
    spark = rows.sparkSession
    order = Window.partitionBy("dim", "v").orderBy("id")
    least = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    nodes = stored(least.groupBy("dim", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    counts = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(F.broadcast(counts), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def graph(table: pa.Table) -> pa.Table:
        vectors = np.array(table.column("v").to_pylist(), dtype=np.float64)
        ids = np.full((len(vectors), keep), -1, dtype=np.int64)
        held = np.zeros((len(vectors), keep), dtype=bool)
        for i, own in enumerate(table.column("ids").to_pylist()):
            ids[i, : len(own)], held[i, : len(own)] = own, True
        order = np.lexsort(ids.T[::-1])  # the graph depends on the rows, not on their order
        vectors, ids, held = vectors[order], ids[order], held[order]
        entry, levels = build(unit(vectors).astype(np.float32))
        upper = b"".join(x.tobytes() for x in levels[1:])
        row = {
            "dim": [vectors.shape[1]],
            "shard": [table.column("shard")[0].as_py()],
            "nodes": [len(vectors)],
            "entry": [entry],
            "levels": [len(levels)],
            "vectors": [vectors.tobytes()],
            "ids": [ids.tobytes() + held.tobytes()],
            "ground": [levels[0].tobytes()],
            "upper": [upper],
        }
        types = {c: pa.int32() for c in ("dim", "shard", "nodes", "entry", "levels")}
        return pa.table({c: pa.array(x, types.get(c, pa.binary())) for c, x in row.items()})

    index = dealt.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInArrow(graph, INDEX)
    return stored(index, "index")


def opened(row: dict, keep: int):
    """The arrays of an index row."""
    n, dim = row["nodes"], row["dim"]
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, dim)
    ids = np.frombuffer(row["ids"][: 8 * n * keep], dtype=np.int64).reshape(n, keep)
    held = np.frombuffer(row["ids"][8 * n * keep :], dtype=bool).reshape(n, keep)
    ground = np.frombuffer(row["ground"], dtype=np.int32).reshape(n, 2 * LINKS)
    upper = np.frombuffer(row["upper"], dtype=np.int32).reshape(row["levels"] - 1, n, LINKS)
    return vectors, ids, held, [ground, *upper]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    width: int = SEARCH_WIDTH,
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest found by cosine, ties to the smaller id.

    ``queries`` are rows like those of ``vectors``; a row is no candidate of its own id.
    Vectors that are null, zero, or hold null or non-finite components, and null ids, take
    no part; vectors of another length are no candidates; rows that repeat in id and vector
    count once; empty tables give no rows; other columns are not read.
    """
    keep = k + 1
    rows = stored(usable(vectors, key, vector), "vectors")
    index = shard_index(rows, keep, shard_rows)
    asked = stored(usable(queries, key, vector), "queries")
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("id", "v")).alias("asked")
    )
    meets = packed.join(F.broadcast(shards), "dim").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    )
    meets = meets.select("dim", "shard", "asked").join(index, ["dim", "shard"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                row = frame.slice(i, 1).to_pylist()[0]
                data, ids, held, levels = opened(row, keep)
                scaled = unit(data).astype(np.float32)
                out: list[tuple[int, int, float]] = []
                for question in row["asked"]:
                    query = np.array(question["v"])
                    nodes = find(scaled, row["entry"], levels, unit(query[None])[0].astype(np.float32), width)
                    scores = cosines(data[nodes], query)
                    found = [
                        (-float(s), int(c))
                        for s, n in zip(scores, nodes)
                        for c in ids[n][held[n]]
                        if c != question["id"]
                    ]
                    out += [(question["id"], c, -s) for s, c in heapq.nsmallest(k, found)]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    found = meets.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
