"""Phrase collocation mining: HAT-trie counting, level by level, with exact scores.

Every task counts the phrases of its texts in a shallow trie over word ids: the first
level is (language id, first word id), and under it the rest of the phrase.  The
containers are runs of id rows with counts, sorted by a hash of the subtree, then of the
phrase (one numpy sort of one key; a Python hash table a phrase was too slow), one run a
batch, until the task's budget of rows is reached.  Then the runs are merged and spilled,
subtree by subtree in that order, as rows
``(lang, first, rest, count)``, and counting starts again; Spark merges these runs by
summing them under their full key, so a very common first word is spread over many reduce
tasks instead of one.  Single words are counted by built-in functions.

Phrases of two words are counted first, then those of three and four together, and so on in
pairs of lengths.  A phrase of ``L`` words can only occur 30 times if all its phrases of
fewer words do, so a task only inserts phrases whose shorter parts are in a Bloom filter of
the frequent phrases of the pass before.  The filter has a fixed number of bits, whatever
the corpus; a false positive costs a counted phrase that the threshold removes later, never
a lost one, so the counts are exact.  A pass over two lengths inserts the shorter phrase
with the word that follows it, one row a position at most: the shorter phrase occurs as
often as all its followers together, so the longer length makes no rows of its own.

Scores, cuts and the containment rule are DataFrame joins and aggregates of the counts;
the top phrases of a language come from per-bucket windows followed by one window over
the buckets' tops, so no language is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tributary.llm.common import stored

# Fixed values of the contract: piece separators, word pattern, thresholds and score scale.
PIECES = r"[.,;:!?\x0A-\x0D]"
WORDS = r"[^\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LONGEST, MIN_COUNT, SCALE, CONTAINED_PCT, TOP = 2, 4, 30, 2_000_000, 80, 2000
UNKNOWN = "und"

#: Entries a task's trie holds before it spills; bits and hashes of the Bloom filters;
#: buckets of the first ranking step.
SPILL_ENTRIES, BLOOM_BITS, BLOOM_HASHES, RANK_BUCKETS = 300_000, 1 << 25, 3, 64

#: Stands for the follower of a phrase that ends its piece or is followed by a rare phrase.
END = 0

_MIX = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def phrase_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of (language hash, word hashes...), the same in every task and on the driver."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(columns[0]), dtype=np.uint64)
        for column in columns:
            key = (key ^ column.astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(29)
    return key


def bloom_positions(keys: np.ndarray, size: int) -> np.ndarray:
    """``BLOOM_HASHES`` bit positions a key, rows by key."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(low + np.uint64(i) * high) % np.uint64(size) for i in range(BLOOM_HASHES)], axis=1)


def bloom_holds(bits: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Whether all positions of each key are set."""
    at = bloom_positions(keys, size)
    return np.all((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1, axis=1)


def _runs(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, subtree by subtree, with their summed counts: one sorted run.

    Rows are sorted by 32 bits of a hash of (lang, first) and 32 bits of a hash of the row, but
    compared in full; a row parted by another of the same hash comes twice and is summed later.
    """
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    columns = list(rows.T)
    keys = (phrase_keys(columns[:2]) & _HIGH) | (phrase_keys(columns) >> np.uint64(32))
    order = np.argsort(keys)
    ordered = rows[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = np.any(ordered[1:] != ordered[:-1], axis=1)
    weights = np.ones(len(ordered), dtype=np.int64) if counts is None else counts[order]
    return ordered[new], np.add.reduceat(weights, np.flatnonzero(new))


def _starts(base: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``length`` words begin, and the piece of each, for pieces at ``base`` of ``sizes`` words."""
    count = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), count)
    return base[piece] + np.arange(len(piece)) - (np.cumsum(count) - count)[piece], piece


class Trie:
    """Counts of phrases of one length under (language, first word), as sorted runs.

    Words arrive as 64-bit hashes.  The phrases of a batch become rows
    ``(lang, first, rest...)``; sorting groups each first word's subtree, and a run keeps
    one row and a count a distinct phrase.  When the runs hold ``budget`` rows they are
    merged and spilled, subtree after subtree, for Spark to merge across tasks.  With
    ``ahead`` a row ends with the word that follows the phrase, or ``END``.
    """

    def __init__(self, length: int, budget: int, ahead: bool = False):
        self.length, self.budget, self.ahead = length, budget, ahead
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def phrases(self, batch: pa.RecordBatch, bits: np.ndarray, size: int) -> np.ndarray:
        """Rows ``(lang, w1..wL)`` of the phrases within a piece whose two shorter parts are in ``bits``.

        The follower of ``ahead`` is kept where the shorter part that ends with it is in ``bits`` too.
        """
        docs = batch.column("pieces")
        langs = batch.column("lang_h").to_numpy(zero_copy_only=False).astype(np.int64)
        outer = docs.offsets.to_numpy()
        inner_list = docs.flatten()
        inner = inner_list.offsets.to_numpy()
        words = inner_list.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(langs, np.diff(outer))
        sizes = np.diff(inner)
        base = inner[:-1] - inner[0]
        part, piece = _starts(base, sizes, self.length - 1)
        known = np.zeros(len(words) + 2, dtype=bool)
        known[part] = bloom_holds(bits, phrase_keys([owner[piece], *[words[part + j] for j in range(self.length - 1)]]), size)
        at, piece = _starts(base, sizes, self.length)
        keep = known[at] & known[at + 1]
        at, piece = at[keep], piece[keep]
        columns = [owner[piece], *[words[at + j] for j in range(self.length)]]
        if self.ahead:  # known[at + 2] only if the piece goes on: from three words, at + 2 is inside the phrase
            follows = known[at + 2]
            after = np.full(len(at), END, dtype=np.int64)
            after[follows] = words[at[follows] + self.length]
            columns.append(after)
        return np.column_stack(columns)

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            run = _runs(rows)
            self.runs.append(run)
            self.held += len(run[0])

    def full(self) -> bool:
        return self.held >= self.budget

    def spill(self) -> pa.RecordBatch | None:
        if not self.runs:
            return None
        rows, counts = _runs(np.concatenate([r for r, _ in self.runs]), np.concatenate([c for _, c in self.runs]))
        self.runs, self.held = [], 0
        names = ["lang_h", *[f"h{j}" for j in range(1, rows.shape[1])]]
        return pa.RecordBatch.from_arrays([*[pa.array(rows[:, j]) for j in range(rows.shape[1])], pa.array(counts)],
                                          names=[*names, "f"])


def encode(docs: DataFrame) -> DataFrame:
    """``(lang, lang_h, words, pieces)``: every piece's words and their hashes, by built-ins.

    Texts are split once; single words are counted from ``words`` and the phrase levels
    read ``pieces`` only (column pruning).
    """
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    split = F.transform(F.split(lowered, PIECES), lambda p: F.regexp_extract_all(p, F.lit(WORDS), F.lit(0)))
    lang = F.coalesce(F.col("lang"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_h"), split.alias("words")).withColumn(
        "pieces", F.transform("words", lambda p: F.transform(p, lambda w: F.xxhash64(w)))
    )


def _count_level(
    encoded: DataFrame, length: int, bloom, size: int, spill: int, min_count: int, ahead: bool = False
) -> list[DataFrame]:
    """``(lang_h, h1..hL, f)`` of phrases of ``length`` words with f >= ``min_count``; ``ahead``: of one more too.

    ``bloom`` holds the frequent phrases of ``length - 1`` words.
    """
    hashes = [f"h{j}" for j in range(1, length + 1)]
    after = f"h{length + 1}"
    made = [*hashes, after] if ahead else hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(length, spill, ahead)
        for batch in batches:
            trie.add(trie.phrases(batch, bloom.value, size))
            if trie.full():
                yield trie.spill()
        out = trie.spill()
        if out is not None:
            yield out

    schema = ", ".join(["lang_h long", *[f"{h} long" for h in made], "f long"])
    runs = encoded.select("lang_h", "pieces").mapInArrow(run, schema)
    total = F.sum("f").alias("f")
    if not ahead:
        return [stored(runs.groupBy("lang_h", *hashes).agg(total).where(F.col("f") >= min_count), f"phrases{length}")]
    # both sums read one shuffle by the shorter phrase; it keeps ``after`` so that their shuffles are equal
    dealt = runs.repartition("lang_h", *hashes)
    shorter = dealt.groupBy("lang_h", *hashes).agg(F.max(after).alias(after), total).withColumn("len", F.lit(length))
    longer = dealt.groupBy("lang_h", *made).agg(total).withColumn("len", F.lit(length + 1))
    both = stored(shorter.unionByName(longer).where(F.col("f") >= min_count), f"phrases{length}")
    return [
        both.where(F.col("len") == length).drop("len", after),
        both.where((F.col("len") == length + 1) & (F.col(after) != END)).drop("len"),
    ]


def _bloom(frequent: DataFrame, length: int, size: int):
    """A broadcast Bloom filter of frequent ``(lang_h, h1..hL)``: ``size`` bits whatever the input."""
    spark = frequent.sparkSession
    columns = ["lang_h", *[f"h{j}" for j in range(1, length + 1)]]

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = phrase_keys([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
            at = bloom_positions(keys, size).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(np.left_shift(1, at & 7).astype(np.int64))],
                                             names=["byte", "bit"])

    set_bits = frequent.select(*columns).mapInArrow(positions, "byte long, bit long").groupBy("byte").agg(
        F.bit_or("bit").alias("bits")
    )
    bits = np.zeros((size + 7) // 8, dtype=np.uint8)
    for row in set_bits.toLocalIterator():  # at most size / 8 rows
        bits[row["byte"]] = row["bits"]
    return spark.sparkContext.broadcast(bits)


def word_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The encoded texts, and ``(lang, lang_h, word, f, h1)`` of every word: texts are split once, here.

    A word's hash is checked to be unique among all words, and not ``END``.
    """
    encoded = stored(encode(docs.select("text", "lang")), "encoded")
    singles = stored(
        encoded.select("lang", "lang_h", F.explode(F.flatten("words")).alias("word")).groupBy("lang", "lang_h", "word")
        .agg(F.count("*").alias("f")).withColumn("h1", F.xxhash64("word")),
        "words",
    )
    named = singles.select("word", "h1").distinct().groupBy("h1").count()
    if not named.where((F.col("count") > 1) | (F.col("h1") == END)).isEmpty():
        raise ValueError("two words share a 64-bit hash")
    return encoded, singles


def counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, spill: int = SPILL_ENTRIES) -> DataFrame:
    """``(lang, phrase, len, f)`` of every phrase of 1 to ``longest`` words with f >= ``min_count``.

    ``docs`` has ``text`` and ``lang``; null text is empty, null lang is ``und``.  Texts are
    split once, into pieces of 64-bit word hashes; a word's hash is checked to be unique
    among all words, so phrases are counted exactly, and turned back into words by a join
    with the frequent words only.
    """
    return phrase_counts(*word_counts(docs), longest, min_count, spill)


def phrase_counts(encoded: DataFrame, singles: DataFrame, longest: int, min_count: int, spill: int) -> DataFrame:
    """``counts`` of the frames of ``word_counts``: two words first, then two lengths a pass."""
    size = BLOOM_BITS
    level = singles.where(F.col("f") >= min_count)
    vocabulary = level.select("word", F.col("h1").alias("h")).distinct()
    langs = level.select("lang", "lang_h").distinct()
    levels = [level]
    while len(levels) < longest:
        length = len(levels) + 1
        bloom = _bloom(levels[-1], length - 1, size)
        levels += _count_level(encoded, length, bloom, size, spill, min_count, ahead=2 < length < longest)
    out = []
    for length, level in enumerate(levels, 1):
        named = level.drop("word") if length == 1 else level.join(langs, "lang_h")
        for j in range(1, length + 1):
            named = named.join(vocabulary.select(F.col("h").alias(f"h{j}"), F.col("word").alias(f"w{j}")), f"h{j}")
        out.append(named.select("lang", F.concat_ws(" ", *[f"w{j}" for j in range(1, length + 1)]).alias("phrase"),
                                F.lit(length).alias("len"), "f"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def word_totals(singles: DataFrame) -> DataFrame:
    """``(lang, n)``: all word occurrences of a language, the sum of its words' counts."""
    return singles.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """Each language's ``top`` collocations: ``(lang, rank, phrase, a, l, r, n, score, k)``.

    Candidates have ``SHORTEST`` to ``longest`` words and occur ``min_count`` times or more
    within pieces; the weakest cut ``k`` gives ``l``, ``r`` and the score
    ``floor(SCALE * a / (l + r))`` (ties to the smallest ``k``), computed in decimals so no
    product overflows.  A candidate inside a longer candidate that keeps ``CONTAINED_PCT``
    percent of its count is dropped.  Order: score, then ``a`` descending, then phrase in
    byte order.  Null texts are empty, a null lang is ``und``; empty and very long texts,
    repeated rows and extra columns need no care; an empty table gives no rows.
    """
    encoded, singles = word_counts(docs)
    freq = stored(phrase_counts(encoded, singles, longest, min_count, SPILL_ENTRIES), "phrase_counts")
    cands = freq.where(F.col("len") >= SHORTEST).select("lang", "phrase", "len", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("len")), " ").alias("right"),
    )
    lf = freq.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rf = freq.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    exact = "decimal(38,0)"
    scored = (
        cuts.join(lf, ["lang", "left"])
        .join(rf, ["lang", "right"])
        .withColumn(
            "score",
            F.floor(F.col("a").cast(exact) * F.lit(SCALE).cast(exact) / (F.col("l") + F.col("r")).cast(exact)).cast("long"),
        )
    )
    weakest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "a", "cut.score", "cut.k", "cut.l", "cut.r")
    # every shorter run of 2+ words inside a candidate, with the candidate's count
    inner = cands.where(F.col("len") > SHORTEST).select(
        "lang", "len", "a", F.split("phrase", " ").alias("w")
    ).select(
        "lang", "a", "w",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(SHORTEST), F.col("len") - 1),
                    lambda size: F.transform(
                        F.sequence(F.lit(1), F.col("len") - size + 1),
                        lambda s: F.array_join(F.slice(F.col("w"), s, size), " "),
                    ),
                )
            )
        ).alias("phrase"),
    )
    covering = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(covering, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * CONTAINED_PCT)
    )
    kept = kept.join(word_totals(singles), "lang")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    local = Window.partitionBy("lang", bucket).orderBy(*order)
    near = kept.withColumn("local", F.row_number().over(local)).where(F.col("local") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k"
    )
