"""Ranked lexical search: Block-Max MaxScore over document shards, shard heaps merged.

Spark builds the impact index: one batched pass over the texts counts each document's terms
(only those of the query set are kept, named by a 64-bit hash that is checked to be unique
among them), the corpus statistics (documents with a term ``N``, all terms ``L``, document
frequencies) are aggregates over every document, and each posting ``(term, document)``
carries its integer impact, the term's whole contribution to a document's score.  Postings are dealt to shards
by a hash of the document, and every shard meets the whole query set, in blocks of queries.

Inside a shard task the postings of a term form a list sorted by document, cut into blocks
of ``BLOCK`` postings; a block keeps the document at its end, its largest impact and its
document numbers delta-coded.  A query walks the documents in windows:

* the global bound of a list is its largest impact times the term's repeats in the query;
  the lists whose bounds sum to no more than the current threshold (the k-th best score)
  are *non-essential*: a document found in them alone cannot enter the heap;
* candidates come from the essential lists only; their partial score plus the block maxima
  of the non-essential lists at their position is an upper bound, and a candidate whose
  bound does not beat the threshold is dropped before any non-essential block is decoded;
* the survivors get exact scores from the decoded blocks and enter a heap of ``k``.

The shard heaps are merged by a window over each query's few rows.  Scores are exact
64-bit integers, so pruning never changes a result: a document is dropped only when it
cannot beat, or tie with a smaller position, the current k-th entry.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tributary.llm.common import stored

# Fixed values of the contract: the term pattern, the letters lower-cased, the score constants.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WEIGHT_SCALE, TF_SCALE, TF_PART, LENGTH_PART = 1000, 1_000_000_000, 1000, 8
LENGTH_BASE, LENGTH_SLOPE = 25, 75

#: Postings of a block, documents of a scoring window, postings a shard should hold,
#: queries a block, distinct query terms up to which the vocabulary is broadcast.
BLOCK, WINDOW, SHARD_POSTINGS, QUERY_BLOCK, BROADCAST_TERMS = 128, 4096, 1_000_000, 2000, 1_000_000


def terms(text: str) -> F.Column:
    """The terms of a text column, in order, repeats kept; null gives an empty array."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


def _term_id(term: str) -> int:
    """XXH64 (seed 42) of the UTF-8 term as a signed long, as Spark's ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8"), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _postings(parsed: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """One pass over the texts: a row ``(uid, doc, n, tid=null, term=null)`` per document
    and ``(uid, doc, n, tid, term, tf)`` per distinct term in ``vocabulary`` (all if None)."""
    pattern = re.compile(TERM)
    lower = str.maketrans(UPPER, LOWER)
    keep = frozenset(vocabulary) if vocabulary is not None else None
    schema = pa.schema(
        [("uid", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("tid", pa.int64()),
         ("term", pa.string()), ("tf", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for uid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc", "text"))):
                found = Counter(pattern.findall((text or "").translate(lower)))
                n = sum(found.values())
                rows = [(None, None, None)] + [
                    (_term_id(t), None if keep is not None else t, c)
                    for t, c in found.items() if keep is None or t in keep
                ]
                for tid, term, tf in rows:
                    for col, value in zip(cols, (uid, doc, n, tid, term, tf)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    return parsed.mapInArrow(run, "uid long, doc long, n long, tid long, term string, tf long")


def impacts(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``(uid, doc, tid, impact)`` of the terms in ``vocabulary`` (a column ``term``).

    ``tid`` is the term's 64-bit hash; terms of the vocabulary that share one raise an
    error instead of merging.  Every row of ``docs`` is a document, also repeated rows and
    null keys (``uid`` tells them apart, ``doc`` is the key); texts are read once and the
    statistics cover all rows whatever the vocabulary.
    """
    spark = docs.sparkSession
    wanted = stored(vocabulary.select("term").distinct().withColumn("tid", F.xxhash64("term")), "vocabulary")
    n_terms = wanted.count()
    if wanted.select("tid").distinct().count() != n_terms:
        raise ValueError("two query terms share a 64-bit hash")
    small = n_terms <= BROADCAST_TERMS
    listed = [r["term"] for r in wanted.toLocalIterator()] if small else None  # bounded by BROADCAST_TERMS
    parsed = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc"), F.col(text).alias("text")
    )
    rows = stored(_postings(parsed, listed), "postings")
    totals = rows.where("tid IS NULL").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")
    ).first()
    big_n, big_l = int(totals["N"] or 0), int(totals["L"] or 0)
    postings = rows.where("tid IS NOT NULL")
    if not small:  # the exact way for a vocabulary too large to ship: a join on the term
        postings = postings.join(wanted.select("term"), "term")
    postings = postings.select("uid", "doc", "n", "tid", "tf")
    if big_n == 0:
        return spark.createDataFrame([], "uid long, doc long, tid long, impact long")
    frequency = postings.groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(
        F.lit(WEIGHT_SCALE) * F.log((2.0 * big_n + 2.0) / (F.col("df").cast("double") * 2.0 + 1.0))
    ).cast("long")
    frequency = frequency.select("tid", weight.alias("w"))
    if small:
        frequency = F.broadcast(frequency)
    m = F.lit(LENGTH_BASE) + F.expr(f"(CAST({LENGTH_SLOPE} AS BIGINT) * n * CAST({big_n} AS BIGINT)) div {big_l}")
    saturated = F.expr(f"(CAST({TF_SCALE} AS BIGINT) * tf) div ({TF_PART} * tf + {LENGTH_PART} * m)")
    return (
        postings.join(frequency, "tid")
        .withColumn("m", m)
        .select("uid", "doc", "tid", (F.col("w") * saturated).alias("impact"))
    )


class Lists:
    """The posting lists of one shard: per term, block ends, block maxima and coded blocks."""

    def __init__(self, frame: pd.DataFrame):
        uid, doc = frame["uid"].to_numpy(np.int64), frame["doc"].to_numpy(np.int64)
        unkeyed = frame["unkeyed"].to_numpy(bool)
        tid, impact = frame["tid"].to_numpy(np.int64), frame["impact"].to_numpy(np.int64)
        del frame
        # documents in key order (null keys last, then by row): their positions in the lists
        order = np.lexsort((uid, doc, unkeyed))
        first = np.ones(len(order), dtype=bool)
        first[1:] = uid[order][1:] != uid[order][:-1]
        ranked = order[first]
        self.uid, self.doc, self.unkeyed = uid[ranked], doc[ranked], unkeyed[ranked]
        self.size = len(ranked)
        pos = np.cumsum(first) - 1
        position = np.empty(len(order), dtype=np.int64)
        position[order] = pos
        by_term = np.lexsort((position, tid))
        tid, position, impact = tid[by_term], position[by_term], impact[by_term]
        cuts = np.flatnonzero(np.diff(tid)) + 1
        self.lists: dict[int, tuple] = {}
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(tid)]])):
            pos, imp = position[lo:hi], impact[lo:hi]
            starts = np.arange(0, len(pos), BLOCK)
            ends = np.minimum(starts + BLOCK, len(pos)) - 1
            coded = np.diff(pos, prepend=0)  # delta-coded positions; a block decodes from its first
            self.lists[int(tid[lo])] = (pos[starts], pos[ends], np.maximum.reduceat(imp, starts), starts, coded, imp)

    def decode(self, term: int, block: int, until: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and impacts of blocks ``block`` to ``until`` (exclusive; default: one)."""
        first, _, _, starts, coded, imp = self.lists[term]
        until = block + 1 if until is None else until
        lo = starts[block]
        hi = starts[until] if until < len(starts) else len(coded)
        pos = np.cumsum(coded[lo:hi])
        return pos - pos[0] + first[block], imp[lo:hi]

    def top(self, query: dict[int, int], k: int) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, position)`` with score above 0, best first, ties by position."""
        present = [(t, q) for t, q in query.items() if t in self.lists]
        if not present:
            return []
        bound = {t: q * int(self.lists[t][2].max()) for t, q in present}
        present.sort(key=lambda tq: (bound[tq[0]], tq[0]))
        names = [t for t, _ in present]
        repeats = np.array([q for _, q in present], dtype=np.int64)
        cumulative = np.cumsum([bound[t] for t in names])
        best_score = np.zeros(0, dtype=np.int64)
        best_pos = np.zeros(0, dtype=np.int64)
        decoded: dict[tuple[int, int], tuple] = {}

        def block(term: int, b: int):
            got = decoded.get((term, b))
            if got is None:
                got = decoded[(term, b)] = self.decode(term, b)
            return got

        for start in range(0, self.size, WINDOW):
            stop = start + WINDOW
            threshold = int(best_score[-1]) if len(best_score) == k else 0
            cut = int(np.searchsorted(cumulative, threshold, side="right"))
            if cut == len(names):
                break  # no document outside the heap can beat it any more
            partial = np.zeros(WINDOW, dtype=np.int64)
            seen = np.zeros(WINDOW, dtype=bool)
            for i in range(cut, len(names)):
                first, last = self.lists[names[i]][0], self.lists[names[i]][1]
                lo = int(np.searchsorted(last, start, side="left"))
                hi = int(np.searchsorted(first, stop, side="left"))
                if lo >= hi:
                    continue
                pos, imp = self.decode(names[i], lo, hi)
                inside = (pos >= start) & (pos < stop)
                partial[pos[inside] - start] += imp[inside] * repeats[i]
                seen[pos[inside] - start] = True
            cand = np.flatnonzero(seen)
            if not len(cand):
                continue
            score = partial[cand]
            upper = score + (cumulative[cut - 1] if cut else 0)
            keep = upper > threshold
            cand, score = cand[keep], score[keep]
            # block maxima of the non-essential lists bound the rest before any block is decoded
            at_block = []
            upper = score.copy()
            for i in range(cut):
                first, last, top_imp = self.lists[names[i]][0], self.lists[names[i]][1], self.lists[names[i]][2]
                b = np.searchsorted(last, cand + start, side="left")
                inside = b < len(last)
                inside[inside] &= first[b[inside]] <= cand[inside] + start
                upper += np.where(inside, top_imp[np.minimum(b, len(last) - 1)], 0) * repeats[i]
                at_block.append((b, inside))
            keep = upper > threshold
            cand, score = cand[keep], score[keep]
            for i in range(cut):
                if not len(cand):
                    break
                b, inside = at_block[i][0][keep], at_block[i][1][keep]
                for one in np.unique(b[inside]):
                    pos, imp = block(names[i], int(one))
                    mine = np.flatnonzero(inside & (b == one))
                    j = np.searchsorted(pos, cand[mine] + start)
                    j = np.minimum(j, len(pos) - 1)
                    hit = pos[j] == cand[mine] + start
                    score[mine[hit]] += imp[j[hit]] * repeats[i]
            good = score > threshold
            if not good.any():
                continue
            all_score = np.concatenate([best_score, score[good]])
            all_pos = np.concatenate([best_pos, cand[good] + start])
            order = np.lexsort((all_pos, -all_score))[:k]
            best_score, best_pos = all_score[order], all_pos[order]
        return [(int(s), int(p)) for s, p in zip(best_score, best_pos)]


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents of every query: ``(item_id, rank, doc_id, score, query_uid)``.

    ``item_id`` and ``doc_id`` keep the names of ``query_key`` and ``key``.  A query's
    terms count with their repeats.  Only scores above 0 are returned, best first, equal
    scores by ascending document key (null last, then by row); ranks run from 1 without
    gaps or ties.  Every query row is a query of its own (``query_uid`` tells repeated ids
    apart); a query without terms (null or empty text) returns nothing, as does an empty
    table.  Every document row counts, repeated rows and null keys too; texts of any length
    are read whole.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    asked = queries.select(
        F.col(query_key).alias("item"), F.monotonically_increasing_id().alias("qid"), terms(query_text).alias("t")
    )
    asked = stored(asked, "queries")
    qterms = asked.select("qid", F.explode("t").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    postings = stored(impacts(docs, qterms, key, text), "impacts")
    qterms = qterms.select("qid", F.xxhash64("term").alias("tid"), "qtf")
    n_postings, n_queries = postings.count(), asked.count()
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(n_postings / SHARD_POSTINGS))
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    qterms = qterms.withColumn("qblock", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    routed = qterms.select("tid", (F.col("qblock") + 0).alias("qblock")).distinct()
    if routed.count() <= BROADCAST_TERMS:
        routed = F.broadcast(routed)
    dealt = postings.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).join(routed, "tid")
    asked_everywhere = qterms.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    columns = ["qid", "uid", "unkeyed", "doc", "score"]

    def run(lists: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if lists.empty or wanted.empty:
            return pd.DataFrame({c: pd.Series([], dtype="bool" if c == "unkeyed" else "int64") for c in columns})
        index = Lists(lists)
        out: list[tuple] = []
        for qid, group in wanted.groupby("qid", sort=False):
            query = dict(zip(group["tid"].astype(int), group["qtf"].astype(int)))
            for score, pos in index.top(query, k):
                out.append((qid, int(index.uid[pos]), bool(index.unkeyed[pos]), int(index.doc[pos]), score))
        return pd.DataFrame(out, columns=columns)

    dealt = dealt.select(
        "shard", "qblock", "tid", "uid", F.col("doc").isNull().alias("unkeyed"),
        F.coalesce("doc", F.lit(0)).alias("doc"), "impact",
    )
    heaps = (
        dealt.groupBy("shard", "qblock")
        .cogroup(asked_everywhere.groupBy("shard", "qblock"))
        .applyInPandas(run, "qid long, uid long, unkeyed boolean, doc long, score long")
        .withColumn("doc", F.when(~F.col("unkeyed"), F.col("doc")))
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "uid")
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("qid", "item"), "qid").select(
        F.col("item").alias(query_key),
        F.col("rank").cast("int").alias("rank"),
        F.col("doc").alias(key),
        F.col("score"),
        F.col("qid").alias("query_uid"),
    )
