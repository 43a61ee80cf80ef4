"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label, so a text that switches language is labelled word by
word; a document's language is the label with the largest summed posterior.

* Features of a word: its prefixes and suffixes of one to three letters, the character
  trigrams of the word framed by ``^`` and ``$``, and the lexicon languages it belongs to.
  Features are hashed into ``DIMENSIONS`` rows of a weight matrix with one column a label;
  learned transitions between labels (and start weights) join the words of a text.
* The lexicon is counted by Spark over every word of every training document: a word
  belongs to a language when it occurs there ``LEXICON_MIN`` times or more with a share of
  ``LEXICON_SHARE`` or more; each language keeps its ``LEXICON_WORDS`` most frequent words
  (the model's size, a documented bound, like the number of hashed features).
* The weights are fitted by maximum likelihood (forward-backward gradients, AdaGrad) on a
  bounded sample: at most ``SAMPLE_DOCS`` training documents a language, a window of
  ``SAMPLE_WORDS`` words from each, and as many sequences again that join windows of two
  languages, so that the transitions learn switches.  The labels of a window are its
  document's language.
* Prediction runs in Arrow batches over the whole texts: emissions are cached per distinct
  word in a task, and forward-backward runs over many texts at once, padded by length, so
  the Python loop has one step per word of the longest text of a group, not per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import stored

#: Letters make words; a text without one is ``UNDETERMINED``.
WORD = r"[^\W\d_]+"
UNDETERMINED = "und"

#: Hashed feature rows, lexicon bounds, sample bounds, training passes and step size.
DIMENSIONS = 1 << 18
LEXICON_MIN, LEXICON_SHARE, LEXICON_WORDS = 5, 0.9, 20_000
SAMPLE_DOCS, SAMPLE_WORDS, EPOCHS, STEP, L2 = 200, 48, 4, 0.3, 1e-6
#: Positions of one padded forward-backward group.
GROUP_POSITIONS = 1 << 19

_word = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Tags that keep prefix, suffix and trigram features of equal letters apart.
_TAGS = {"g": 1, "p1": 2, "p2": 3, "p3": 4, "s1": 5, "s2": 6, "s3": 7}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def feature_table(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of many words at once, and the word each belongs to, grouped by word.

    Prefixes and suffixes of one to three letters and every character trigram of the word
    framed by ``^`` and ``$`` are hashed from code points in numpy; lexicon languages add
    one row each after the hashed rows.
    """
    n = len(words)
    lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=n)
    framed = lengths + 2
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    start = np.cumsum(framed) - framed
    rows, owner = [], []
    with np.errstate(over="ignore"):
        per = framed - 2
        at = np.repeat(start, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        h = np.uint64(_TAGS["g"]) + codes[at] * _PRIMES[0] + codes[at + 1] * _PRIMES[1] + codes[at + 2] * _PRIMES[2]
        rows.append(_mix(h))
        owner.append(np.repeat(np.arange(n), per))
        for i in (1, 2, 3):
            chosen = np.flatnonzero(lengths >= i)
            for tag, first in ((f"p{i}", start[chosen] + 1), (f"s{i}", start[chosen] + framed[chosen] - 1 - i)):
                h = np.full(len(chosen), _TAGS[tag], dtype=np.uint64)
                for j in range(i):
                    h = h + codes[first + j] * _PRIMES[j]
                rows.append(_mix(h))
                owner.append(chosen)
    hashed = (np.concatenate(rows) % np.uint64(DIMENSIONS)).astype(np.int64)
    extra = [(i, DIMENSIONS + k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    owners = np.concatenate([*owner, np.array([i for i, _ in extra], dtype=np.int64)])
    allrows = np.concatenate([hashed, np.array([r for _, r in extra], dtype=np.int64)])
    order = np.argsort(owners, kind="stable")
    return allrows[order], owners[order]


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Feature rows of one word (see ``feature_table``)."""
    return feature_table([word], lexicon)[0].tolist()


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (DIMENSIONS + labels, labels): hashed rows, then one lexicon row a label
    transitions: np.ndarray  # (labels, labels)
    start: np.ndarray  # (labels,)
    lexicon: dict[str, tuple[int, ...]]

    def word_emissions(self, words: list[str]) -> np.ndarray:
        """Emission rows of distinct words, one numpy pass over their features."""
        if not words:
            return np.zeros((0, len(self.labels)))
        rows, owner = feature_table(words, self.lexicon)
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.add.reduceat(self.weights[rows], firsts, axis=0)

    def emissions(self, seq: list[str], cache: dict | None = None) -> np.ndarray:
        return self.batch_emissions([seq], {} if cache is None else cache)[0]

    def batch_emissions(self, seqs: list[list[str]], cache: dict) -> list[np.ndarray]:
        """Emissions of many sequences; ``cache`` keeps a task's rows by word."""
        if len(cache.get("index", ())) > 500_000:
            cache.clear()
        index: dict[str, int] = cache.setdefault("index", {})
        new = list({w: None for s in seqs for w in s if w not in index})
        if new:
            rows = self.word_emissions(new)
            held = cache.get("rows")
            base = 0 if held is None else len(index)
            cache["rows"] = rows if held is None else np.concatenate([held[: len(index)], rows])
            for i, w in enumerate(new):
                index[w] = base + i
        table = cache.get("rows", np.zeros((0, len(self.labels))))
        return [table[np.fromiter((index[w] for w in s), dtype=np.int64, count=len(s))] for s in seqs]


def _forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Log marginals of one sequence, pairwise marginals and log partition (for training)."""
    n, k = emit.shape
    alpha = np.empty((n, k))
    alpha[0] = start + emit[0]
    for t in range(1, n):
        alpha[t] = emit[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + trans, axis=0)
    beta = np.zeros((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(trans + (emit[t + 1] + beta[t + 1])[None, :], axis=1)
    log_z = np.logaddexp.reduce(alpha[-1])
    gamma = np.exp(alpha + beta - log_z)
    xi = np.exp(alpha[:-1, :, None] + trans[None] + (emit[1:] + beta[1:])[:, None, :] - log_z)
    return gamma, xi


def fit(sequences: list[tuple[list[str], list[int]]], labels: list[str], lexicon: dict) -> Model:
    """Maximum likelihood by AdaGrad over ``sequences`` of (words, label indexes)."""
    k = len(labels)
    model = Model(labels, np.zeros((DIMENSIONS + k, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    g_w, g_t, g_s = np.full_like(model.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    vocabulary = list({w: None for seq, _ in sequences for w in seq})
    rows, owner = feature_table(vocabulary, lexicon)
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    pieces_ = dict(zip(vocabulary, np.split(rows, cuts[1:])))
    feats = [[pieces_[w] for w in seq] for seq, _ in sequences]
    order = np.random.default_rng(7).permutation(len(sequences))
    for _ in range(EPOCHS):
        for i in order:
            seq, gold = sequences[i]
            emit = np.stack([model.weights[f].sum(axis=0) for f in feats[i]])
            gamma, xi = _forward_backward(emit, model.transitions, model.start)
            onehot = np.eye(k)[gold]
            delta = onehot - gamma  # gradient of the log-likelihood by emission
            rows = np.concatenate(feats[i])
            grad = np.repeat(delta, [len(f) for f in feats[i]], axis=0) - L2 * model.weights[rows]
            np.add.at(g_w, rows, grad**2)
            np.add.at(model.weights, rows, STEP * grad / np.sqrt(g_w[rows]))
            pair = np.zeros((k, k))
            np.add.at(pair, (gold[:-1], gold[1:]), 1.0)
            grad_t = pair - xi.sum(axis=0)
            g_t += grad_t**2
            model.transitions += STEP * grad_t / np.sqrt(g_t)
            grad_s = onehot[0] - gamma[0]
            g_s += grad_s**2
            model.start += STEP * grad_s / np.sqrt(g_s)
    return model


def posteriors(emits: list[np.ndarray], trans: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Word marginals of many sequences at once: one padded, scaled pass a group of lengths."""
    out: list[np.ndarray] = [np.zeros((0, len(start)))] * len(emits)
    order = sorted(range(len(emits)), key=lambda i: len(emits[i]))
    expt, k = np.exp(trans - trans.max()), len(start)
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and len(emits[order[j]]) * (j - i + 1) <= GROUP_POSITIONS:
            j += 1
        group = order[i:j]
        i = j
        lengths = np.array([len(emits[g]) for g in group])
        width = int(lengths.max())
        if width == 0:
            continue
        e = np.zeros((len(group), width, k))
        for r, g in enumerate(group):
            e[r, : lengths[r]] = emits[g]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        alpha = np.empty_like(e)
        a = np.exp(start - start.max()) * e[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, width):
            a = (alpha[:, t - 1] @ expt) * e[:, t]
            alive = (t < lengths)[:, None]
            a = np.where(alive, a / a.sum(axis=1, keepdims=True), alpha[:, t - 1])
            alpha[:, t] = a
        beta = np.ones_like(e)
        for t in range(width - 2, -1, -1):
            b = (e[:, t + 1] * beta[:, t + 1]) @ expt.T
            alive = (t + 1 < lengths)[:, None]
            beta[:, t] = np.where(alive, b / b.sum(axis=1, keepdims=True), 1.0)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        for r, g in enumerate(group):
            out[g] = gamma[r, : lengths[r]]
    return out


def held_out(key: str, parts: int) -> F.Column:
    """Rows whose crc32 of the key's text is 0 modulo ``parts``; a null key is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)) == 0, F.lit(True))


def lexicon_of(training: DataFrame, labels: list[str]) -> dict[str, tuple[int, ...]]:
    """Word to lexicon languages, counted over every word of every training document."""
    counted = (
        training.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w"))
        .groupBy("w", "lang")
        .agg(F.count("*").alias("c"))
    )
    totals = counted.groupBy("w").agg(F.sum("c").alias("total"))
    shared = stored(
        counted.join(totals, "w").where((F.col("c") >= LEXICON_MIN) & (F.col("c") >= F.col("total") * LEXICON_SHARE)),
        "lexicon",
    )
    lexicon: dict[str, list[int]] = {}
    for k, lang in enumerate(labels):
        top = shared.where(F.col("lang") == lang).orderBy(F.desc("c"), "w").limit(LEXICON_WORDS)
        for row in top.toLocalIterator():  # at most LEXICON_WORDS rows a language
            lexicon.setdefault(row["w"], []).append(k)
    return {w: tuple(ks) for w, ks in lexicon.items()}


def sample(training: DataFrame, labels: list[str]) -> list[tuple[list[str], list[int]]]:
    """At most SAMPLE_DOCS windows a language, and as many mixed sequences, chosen by hash."""
    counts = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * SAMPLE_DOCS / count))).otherwise(share)
    picked = (
        training.withColumn("h", F.xxhash64("doc_id", "text"))
        .where((F.pmod("h", F.lit(1_000_000)) / 1_000_000.0) < share)
        .withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
        .where(F.size("w") > 0)
        .withColumn("at", F.pmod(F.col("h"), F.greatest(F.size("w") - SAMPLE_WORDS, F.lit(1))) + 1)
        .select("lang", "h", F.slice("w", F.col("at").cast("int"), SAMPLE_WORDS).alias("w"))
        .limit(4 * SAMPLE_DOCS * max(1, len(labels)))
    )
    windows: dict[str, list[list[str]]] = {lang: [] for lang in labels}
    for row in sorted(picked.collect(), key=lambda r: r["h"]):  # bounded by the limit above
        if len(windows[row["lang"]]) < SAMPLE_DOCS:
            windows[row["lang"]].append(list(row["w"]))
    index = {lang: k for k, lang in enumerate(labels)}
    sequences = [(w, [index[lang]] * len(w)) for lang in labels for w in windows[lang]]
    rng = np.random.default_rng(11)
    if len(labels) > 1:
        for _ in range(len(sequences)):
            a, b = rng.choice(len(labels), 2, replace=False)
            wa, wb = windows[labels[a]], windows[labels[b]]
            if wa and wb:
                left, right = wa[rng.integers(len(wa))], wb[rng.integers(len(wb))]
                left, right = left[: max(1, len(left) // 2)], right[len(right) // 2 :]
                sequences.append((left + right, [a] * len(left) + [b] * len(right)))
    return sequences


def train(docs: DataFrame, parts: int = 5, key: str = "doc_id") -> Model:
    """Fit on rows that are not held out and have a language (see ``held_out``)."""
    training = docs.where(~held_out(key, parts) & F.col("lang").isNotNull()).select(
        F.col(key).alias("doc_id"), F.col("text"), F.col("lang")
    )
    labels = sorted(r["lang"] for r in training.select("lang").distinct().collect())  # a label alphabet
    if not labels:
        raise ValueError("no labelled training rows")
    lexicon = lexicon_of(training, labels)
    return fit(sample(training, labels), labels, lexicon)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, switches)`` for every row, in Arrow batches.

    ``lang_pred`` is the label with the largest summed word posterior (ties to the first
    label in sorted order), ``score`` its mean posterior, ``switches`` the number of label
    changes between neighbouring words of the most likely labels.  A null text or one
    without a letter gives ``und``, score 0 and no switches; repeated rows, null keys and
    extra columns need no care.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        cache: dict = {}
        for batch in batches:
            keys = batch.column("k").to_pylist()
            seqs = [words(t) for t in batch.column("t").to_pylist()]
            marg = posteriors(m.batch_emissions(seqs, cache), m.transitions, m.start)
            pred, score, switches = [], [], []
            for g in marg:
                if not len(g):
                    pred.append(UNDETERMINED), score.append(0.0), switches.append(0)
                    continue
                total = g.sum(axis=0)
                best = int(np.argmax(total))
                path = g.argmax(axis=1)
                pred.append(m.labels[best])
                score.append(float(min(1.0, max(0.0, total[best] / len(g)))))
                switches.append(int(np.count_nonzero(path[1:] != path[:-1])))
            yield pa.RecordBatch.from_pydict(
                {"k": keys, "lang_pred": pred, "score": score, "switches": switches},
                schema=pa.schema([("k", batch.schema.field("k").type), ("lang_pred", pa.string()),
                                  ("score", pa.float64()), ("switches", pa.int64())]),
            )

    key_type = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"k {key_type}, lang_pred string, score double, switches long"
    )
    return out.withColumnRenamed("k", key)


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """Each word of ``text`` with its most likely label: for inspecting code-switched text."""
    seq = words(text)
    if not seq:
        return []
    g = posteriors([model.emissions(seq)], model.transitions, model.start)[0]
    return [(w, model.labels[int(i)]) for w, i in zip(seq, g.argmax(axis=1))]


def languages(docs: DataFrame, parts: int = 5) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, switches)`` for every row of ``docs``.

    The model learns from rows that are not held out (crc32 of the key's text modulo
    ``parts`` is not 0) and have a language; lang, source and key are never features.
    """
    model = train(docs, parts)
    predicted = predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out("doc_id", parts).alias("held_out"), "lang_pred", "score", "switches")
