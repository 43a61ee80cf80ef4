"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Patterns that could backtrack over long runs are anchored so that one document costs time
in proportion to its length.  A span is ``(kind, start, end, score)`` in code points, end
exclusive.  Kinds with a contract (``BASE``) are returned whenever their check passes; the
other kinds only when their score, raised by nearby words, reaches ``threshold`` and they
do not overlap a contract span.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]\.[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")

#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "local_phone": 0.3}
#: Words that raise the score when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
#: Words before a dotted number that speak for a version, not an address.
AGAINST = {"ip": ("version", "release", "v")}
WORD = re.compile(r"[a-z]+")
#: Characters read on either side of a span, and what a context word adds.
REACH, BONUS = 40, 0.25


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Each ``@`` with the run of local characters before it and a dotted domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", s, e) for s, e in emails(text)]
    if DOTTED.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                spans.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(n := digits(m[0])) <= 19 and luhn(n):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def extra_spans(text: str) -> list[tuple[str, int, int]]:
    """Kinds beyond the contract: account numbers by checksum, numbers that need context."""
    spans = []
    # a pattern reaches over spaces into what follows: go on after a confirmed number, else at the next start
    m = IBAN.search(text)
    while m:
        at = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):
            if end < len(text) and text[end].isalnum():
                continue
            compact = text[m.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and text[end - 1] != " " and mod97(compact):
                spans.append(("iban", m.start(), end))
                at = end
                break
        m = IBAN.search(text, at)
    for kind, pattern in (("ssn", SSN), ("local_phone", LOCAL_PHONE)):
        for m in pattern.finditer(text):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not (before.isalnum() or before in "+-." and before) and not after.isalnum():
                spans.append((kind, m.start(), m.end()))
    return spans


def scored(text: str, kind: str, start: int, end: int) -> float:
    before = WORD.findall(text[max(0, start - REACH) : start].lower())
    after = WORD.findall(text[end : end + REACH].lower())
    score = PRIOR[kind]
    if not set(CONTEXT[kind]).isdisjoint(before + after):
        score += BONUS
    if not set(AGAINST.get(kind, ())).isdisjoint(before[-2:]):
        score -= BONUS
    return round(min(1.0, max(0.0, score)), 2)


def pii_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by kind in the order of ``KINDS``, then start; null is empty."""
    text = text or ""
    spans = [(k, s, e, scored(text, k, s, e)) for k, s, e in base_spans(text)]
    taken = [(s, e) for _, s, e, _ in spans]
    for kind, start, end in extra_spans(text):
        if any(s < end and start < e for s, e in taken):
            continue
        score = scored(text, kind, start, end)
        if score >= threshold:
            spans.append((kind, start, end, score))
            taken.append((start, end))
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row ``(key, spans array<struct<kind,start,end,score>>)`` per input row.

    A null or empty text has no spans; repeated rows and null keys stay as they are; an
    empty table gives no rows; other columns of ``docs`` are not read, so their names
    cannot clash.  Long texts are scanned whole.
    """

    def spans(rows: list[dict]) -> list[dict]:
        return [
            {
                "k": r["k"],
                "spans": [
                    {"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in pii_spans(r["t"], threshold)
                ],
            }
            for r in rows
        ]

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = map_rows(
        source, spans, f"k {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>"
    )
    return found.withColumnRenamed("k", key)


def mask_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]``; nulls stay null."""

    def mask(value: str | None) -> str | None:
        if value is None:
            return None
        out, at = [], 0
        for kind, start, end, _ in sorted(pii_spans(value, threshold), key=lambda x: x[1:3]):
            if start >= at:
                out += [value[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join(out) + value[at:]

    masked = F.pandas_udf(lambda s: s.map(mask, na_action="ignore"), "string")
    return docs.withColumn(text, masked(F.col(text)))


def pii_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, a digest of the contract spans and all spans, from :func:`find_pii`."""
    found = find_pii(docs, key, text)
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        key,
        *counts,
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
