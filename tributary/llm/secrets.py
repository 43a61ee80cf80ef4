"""Secrets: fixed patterns, and strings that look random rather than like identifiers.

Two first-order character Markov models, one of random strings and one of ordinary text,
are counted from labelled samples: what the fixed patterns confirm in any document, and
strings drawn from the usual alphabets, are labelled random; all other text is ordinary.  A long token is reported when the log-likelihood
ratio of the two models exceeds ``margin`` nats a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import map_rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates for the model: at least MIN_LENGTH characters of the modelled alphabet.
MIN_LENGTH = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Symbols of the models: the alphabet and one for every other byte.
SYMBOLS = len(ALPHABET) + 1
OTHER = SYMBOLS - 1
CLASS = np.full(256, OTHER, dtype=np.int64)
CLASS[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(OTHER)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Spans of the fixed patterns and where their secret value begins."""
    spans = []
    lowered = text.lower()
    if any(h in lowered for h in ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return spans


def bigrams(text: str) -> np.ndarray:
    symbols = CLASS[np.frombuffer(text.encode(), dtype=np.uint8)]
    return np.bincount(symbols[:-1] * SYMBOLS + symbols[1:], minlength=SYMBOLS * SYMBOLS)


def drawn_strings(n: int = 3000, length: int = 40, seed: int = 7) -> list[str]:
    """Random strings over hexadecimal, alphanumeric and base-64 alphabets, a third each."""
    rng = np.random.default_rng(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64])
    return ["".join(rng.choice(list(kinds[i % 3]), length)) for i in range(n)]


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``(label, pair, n)``: character pairs of random (1) and ordinary (0) samples."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
        for frame in frames:
            plain, random = [], []
            for value in frame.column("t").to_pylist():
                at = 0
                for _, _, end, start in sorted(base_spans(value or ""), key=lambda s: s[3]):
                    random.append(value[start:end])
                    plain.append(value[at : max(at, start)])
                    at = max(at, end)
                plain.append((value or "")[at:])
            counts[0] += bigrams(" ".join(["", *plain, ""]))
            counts[1] += bigrams(" ".join(["", *random, ""]))
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(counts[label, pair], pa.int64())],
            names=["label", "pair", "n"],
        )

    counted = docs.select(F.col(text).alias("t")).mapInArrow(run, "label int, pair int, n long")
    return counted.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame, smoothing: float = 0.05) -> np.ndarray:
    """Log of P(next | symbol) under the random model over the ordinary one.

    The table has ``SYMBOLS`` squared entries whatever the size of the corpus.  Each row is
    mixed with its model's overall symbol frequencies and a uniform part, so that a pair
    never seen, or an empty corpus, gives finite values.
    """
    n = np.zeros((2, SYMBOLS, SYMBOLS))
    for row in counts.collect():
        n[row.label, row.pair // SYMBOLS, row.pair % SYMBOLS] = row.n
    n[1] += bigrams(" ".join(["", *drawn_strings(), ""])).reshape(SYMBOLS, SYMBOLS)
    uniform = 1.0 / SYMBOLS
    overall = (n.sum(1) + 1) / (n.sum((1, 2)) + SYMBOLS)[:, None]
    prior = (1 - smoothing) * overall + smoothing * uniform
    weight = 20.0
    p = (n + weight * prior[:, None, :]) / (n.sum(2) + weight)[:, :, None]
    return np.log(p[1]) - np.log(p[0])


def likeness(token: str, ratio: np.ndarray) -> float:
    """Mean log-likelihood ratio a character: above zero is likelier random."""
    symbols = CLASS[np.frombuffer(token.encode(), dtype=np.uint8)]
    return float(ratio[symbols[:-1], symbols[1:]].sum() / max(1, len(symbols)))


def secret_spans(text: str | None, ratio: np.ndarray, margin: float = 0.7) -> list[tuple[str, int, int, float]]:
    """All spans of one text by start, then kind; null is empty.

    Model spans never overlap a span of a fixed pattern.
    """
    text = text or ""
    base = base_spans(text)
    spans = [(k, s, e, round(likeness(text[v:e], ratio), 4)) for k, s, e, v in base]
    for m in TOKEN.finditer(text):
        if any(s < m.end() and m.start() < e for _, s, e, _ in base):
            continue
        value = likeness(m[0], ratio)
        if value > margin:
            spans.append(("random", m.start(), m.end(), round(value, 4)))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(
    docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", margin: float = 0.7
) -> DataFrame:
    """One row ``(key, spans array<struct<kind,start,end,score>>)`` per input row.

    A null or empty text has no spans; repeated rows, null keys, an empty table and extra
    columns need no care; long texts are scanned whole.
    """

    def spans(rows: list[dict]) -> list[dict]:
        return [
            {
                "k": r["k"],
                "spans": [
                    {"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in secret_spans(r["t"], ratio, margin)
                ],
            }
            for r in rows
        ]

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = map_rows(source, spans, f"k {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")
    return found.withColumnRenamed("k", key)


def secret_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, a digest of the contract spans and all spans, from :func:`find_secrets`."""
    found = find_secrets(docs, log_ratio(bigram_counts(docs, text)), key, text)
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        key, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
