"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

Tokens with look-alike signs, runs of spaced-out letters and tokens with repeated letters
are lattices: every character may stand for itself or for a letter it imitates, separators
and repetitions may be dropped, each at a cost.  Viterbi picks the path that a character
bigram model of the whole corpus and the channel costs make likeliest.  A text's words and
those restored from it are looked up, whole and by their beginnings, in a logistic model
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import stored

#: Letters that a sign may imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
#: Channel costs in nats: a sign for a letter, a dropped separator, a dropped repetition.
SWAP, JOIN, REPEAT = 1.0, 0.3, 1.0

WORD = re.compile(r"[^\W\d_]+")
SIGN = re.compile(r"[0-9@$!|+€(]")
#: Signs after a word that may be punctuation: the token is tried with and without them.
TRAILING = "!|+($€@.,;:?"
SPACED = re.compile(r"[\s.\-_*](?:[\w@$!|+€][\s.\-_*]{1,2}){3,}")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Longest and shortest beginnings of words that serve as features.
SHORTEST, LONGEST = 3, 7

#: Code points with a symbol of their own in the character model; all others are word ends.
SYMBOLS = 0x250
LETTER = np.array([i if chr(i).isalpha() else 0 for i in range(SYMBOLS)], dtype=np.int64)


def character_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(pair, n)``: how often one letter follows another, word ends included, in all texts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for frame in frames:
            for value in frame.column("t").to_pylist():
                points = np.frombuffer(f" {value or ''} ".lower().encode("utf-32-le"), dtype=np.uint32)
                symbols = LETTER[np.where(points < SYMBOLS, points, 0)]
                pairs = symbols[:-1] * SYMBOLS + symbols[1:]
                if len(pairs) > SYMBOLS * 64:
                    counts += np.bincount(pairs, minlength=len(counts))
                else:
                    np.add.at(counts, pairs, 1)
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[pair])], names=["pair", "n"])

    counted = docs.select(F.col(text).alias("t")).mapInArrow(run, "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def character_model(pairs: DataFrame) -> dict[str, dict[str, float]]:
    """Log-probability of each letter after a letter; '' is the word end.

    Its size is bounded by the alphabet.  An empty corpus gives an empty model, for which
    every letter is equally likely.
    """
    n: dict[str, Counter] = {}
    for row in pairs.collect():
        a, b = row.pair // SYMBOLS, row.pair % SYMBOLS
        if a or b:
            n.setdefault(chr(a) if a else "", Counter())[chr(b) if b else ""] = row.n
    model = {}
    for a, following in n.items():
        total = sum(following.values()) + 0.5 * len(n)
        model[a] = {b: float(np.log((following[b] + 0.5) / total)) for b in n}
    return model


UNSEEN = -12.0


def restore(token: str, model: dict[str, dict[str, float]]) -> str:
    """The likeliest word behind an obfuscated token, by Viterbi over its character lattice.

    A state is the last letter written; each state keeps its best score and its path as a
    linked list, so time and memory are proportional to the token.
    """
    states: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    before = ""
    for char in token:
        options = [(c, SWAP) for c in IMITATES.get(char, "")]
        if char.isalpha():
            options.append((char, 0.0))
        skip = REPEAT if char == before else None if options else JOIN
        after: dict[str, tuple[float, tuple | None]] = {}
        for last, (score, path) in states.items():
            row = model.get(last, {})
            for letter, cost in options:
                value = score + row.get(letter, UNSEEN) - cost
                if letter not in after or value > after[letter][0]:
                    after[letter] = (value, (letter, path))
            if skip is not None:
                value = score - skip
                if last not in after or value > after[last][0]:
                    after[last] = (value, path)
        states, before = after, char
    last = max(states, key=lambda s: (states[s][0] + model.get(s, {}).get("", UNSEEN), s))
    path, letters = states[last][1], []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def suspects(text: str) -> set[str]:
    """Tokens of a lower-case text that may hide a word."""
    found, padded = set(), f" {text} "
    for pattern in (SIGN, TRIPLE):
        last = 0
        for m in pattern.finditer(padded):
            if m.start() < last:
                continue
            start, last = m.start(), m.end()
            while not padded[start - 1].isspace():
                start -= 1
            while not padded[last].isspace():
                last += 1
            token = padded[start:last]
            found.update(t for t in (token, token.rstrip(TRAILING)) if WORD.search(t))
    found.update(m[0].strip() for m in SPACED.finditer(padded))
    return found


def words_of(text: str | None, model: dict[str, dict[str, float]], cached=None) -> set[str]:
    """The words of a text and those restored from its suspect tokens; null is empty."""
    lowered = (text or "").lower()
    words = set(WORD.findall(lowered))
    decode = cached or (lambda token: restore(token, model))
    words.update(decode(token) for token in suspects(lowered))
    words.discard("")
    return words


def features_of(words: set[str]) -> set[str]:
    """Whole words as ``=word`` and their beginnings."""
    found = {f"={w}" for w in words}
    for n in range(SHORTEST, LONGEST + 1):
        found.update(w[:n] for w in words if len(w) >= n)
    return found


@dataclass
class ToxicityModel:
    """The character model, the weight of each feature, and the log-odds without any."""

    characters: dict[str, dict[str, float]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0

    def scorer(self):
        decode = lru_cache(maxsize=50_000)(lambda token: restore(token, self.characters))

        def score(text: str | None) -> float:
            found = self.weights.keys() & features_of(words_of(text, self.characters, decode))
            return 1.0 / (1.0 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(found)))))

        return score


def in_training(key: str):
    """Rows that labels may be learned from: crc32 of the key as text, modulo 4, is not 2."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, limit: int) -> tuple[DataFrame, dict]:
    """A sample of at most ``limit`` labelled rows, a quarter of it toxic, one of each near-copy.

    Returns rows ``(t, y)`` and, by class, how many labelled rows a sampled one stands for.
    Near-copies share the smallest hash of their three-word shingles.
    """
    known = labels.where(F.col("toxic").isNotNull() & in_training(key)).groupBy(key)
    known = known.agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    most = {1: limit // 4, 0: limit - limit // 4}
    order = F.xxhash64(F.col(key), F.lit("sample"))
    picked = [known.where(F.col("y") == y).orderBy(order, key).limit(n) for y, n in most.items()]
    chosen = stored(picked[0].unionByName(picked[1]), "sample")
    words = F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "")
    shingle = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 3))
    )
    rows = (
        docs.select(F.col(key), F.col(text).alias("t"))
        .join(F.broadcast(chosen), key)
        .withColumn("w", words)
        .withColumn("least", F.array_min(shingle))
        .groupBy("least", "y")
        .agg(F.min_by("t", F.struct(key, "t")).alias("t"))
    )
    rows = stored(rows.select("t", "y"), "training")
    seen = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    return rows, {y: totals.get(y, 0) / n for y, n in seen.items()}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        sample: int = 20_000, features: int = 4_000, evidence: float = 20.0) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows and ``features`` features.

    A feature qualifies when its share among toxic rows gives a log-likelihood statistic of
    at least ``evidence``.  The character model counts every text.  Without labelled rows of
    both classes the model has no features and scores every text alike.
    """
    characters = character_model(character_pairs(docs, text))
    rows, stands_for = training_rows(docs, labels, key, text, sample)
    if set(stands_for) != {0, 1}:
        return ToxicityModel(characters)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for frame in frames:
            for t, y in zip(frame.column("t").to_pylist(), frame.column("y").to_pylist(), strict=True):
                seen[y].update(features_of(words_of(t, characters)))
        names = sorted(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 100_000):
            part = names[at : at + 100_000]
            arrays = [pa.array(part), *(pa.array([seen[y][f] for f in part], pa.int64()) for y in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["f", "n0", "n1"])

    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    counted = rows.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f")
    counted = counted.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 >= 3")
    p, q = totals[1] / sum(totals.values()), F.col("n1") / (F.col("n0") + F.col("n1"))
    gain = 2 * (
        F.col("n1") * F.log(q / p) + F.when(q < 1, F.col("n0") * F.log((1 - q) / (1 - p))).otherwise(0.0)
    )
    best = counted.where(q > p).withColumn("gain", gain).where(F.col("gain") >= evidence)
    chosen = sorted(r["f"] for r in best.orderBy(F.desc("gain"), "f").limit(features).collect())
    index = {f: i for i, f in enumerate(chosen)}

    def present(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [
                sorted(index[f] for f in index.keys() & features_of(words_of(t, characters)))
                for t in frame.column("t").to_pylist()
            ]
            arrays = [frame.column("y"), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "found"])

    sampled = rows.mapInArrow(present, "y int, found array<int>").groupBy("y", "found").count().collect()
    weights, bias = logistic(sampled, len(chosen), stands_for)
    return ToxicityModel(characters, {f: float(weights[i]) for f, i in index.items() if weights[i] > 0}, bias)


def logistic(sampled, features: int, stands_for: dict, penalty: float = 0.02, rounds: int = 800):
    """Logistic regression with weights of zero or more, by Adam steps on the sampled rows."""
    sampled = sorted(sampled, key=lambda r: (r["y"], r["found"]))
    y = np.array([r["y"] for r in sampled], dtype=float)
    mass = np.array([r["count"] * stands_for[r["y"]] for r in sampled])
    mass *= sum(r["count"] for r in sampled) / mass.sum()
    row = np.repeat(np.arange(len(sampled)), [len(r["found"]) for r in sampled])
    column = np.array([i for r in sampled for i in r["found"]], dtype=np.int64)
    theta = np.zeros(features + 1)
    theta[-1] = np.log(max(1e-6, mass[y == 1].sum()) / max(1e-6, mass[y == 0].sum()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        logit = theta[-1] + np.bincount(row, theta[column], minlength=len(y))
        off = mass * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        slope = np.append(np.bincount(column, off[row], minlength=features) + penalty * theta[:-1], off.sum())
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta[:-1], float(theta[-1])


def toxicity_scores(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``(key, score)`` per input row; null and empty texts score what no feature scores.

    Repeated rows and null keys stay; an empty table gives no rows; other columns are not
    read.  Long texts are scored whole.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for frame in frames:
            scores = [score(t) for t in frame.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column("k"), pa.array(scores, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"`{key}` {kind}, score double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, held_out, score, predicted)`` of a model fitted on ``labels``."""
    scores = toxicity_scores(docs, fit(docs, labels, key, text), key, text)
    return scores.select(
        key,
        F.coalesce(~in_training(key), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, in one pass over whole rows."""
    model = fit(docs, labels, key, text)
    scored = F.pandas_udf(lambda s: s.map(model.scorer()).astype("float64"), "double")
    return docs.where(scored(F.col(text)) < threshold)
