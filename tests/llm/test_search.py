import math
import re
from collections import Counter

import pytest

from tests.conftest import rows
from tests.llm.conftest import awkward
from tributary.llm import search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall((text or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def brute(docs, queries, k=10):
    """Every query against every document with the formula as written."""
    parsed = [(key, Counter(words(text)), len(words(text))) for key, text in docs]
    big_n = sum(1 for _, _, n in parsed if n)
    big_l = sum(n for _, _, n in parsed)
    df = Counter(t for _, tf, _ in parsed for t in tf)
    out = []
    for item, qtext in queries:
        scored = []
        for i, (key, tf, n) in enumerate(parsed):
            if not n:
                continue
            m = 25 + (75 * n * big_n) // big_l
            score = 0
            for term in words(qtext):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key if key is not None else 0, i, key, score))
        scored.sort()
        out += [(item, r + 1, s[4], s[5]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def run(frame, session, docs, queries, k=10):
    d = frame([(key, text) for key, text in docs])
    q = session.createDataFrame(queries, "item_id long, text string")
    return rows(search.search(d, q, k=k), "item_id", "rank", "doc_id", "score")


def test_small_corpus_matches_brute_force(frame, session):
    docs = [
        (1, "The cat sat on the mat."),
        (2, "A dog and a cat, and another CAT!"),
        (3, "Dogs bark; cats meow. The end."),
        (4, "Nothing here but numbers 42 and 4711"),
        (5, "The the the the cat"),
        (6, "Über café naïve — résumé CAFÉ"),
    ]
    queries = [(10, "the cat"), (11, "cat cat dog"), (12, "42"), (13, "café"), (14, "zebra"), (15, None)]
    assert run(frame, session, docs, queries) == brute(docs, queries)


def test_awkward_rows_are_documents(frame, session):
    docs = awkward() + [(8, "one two"), (9, "two one one")]
    queries = [(1, "one"), (2, "text word"), (1, "two"), (None, "one two")]
    assert run(frame, session, docs, queries) == brute(docs, queries)


def test_ties_rank_by_key_and_k_bounds(frame, session):
    docs = [(i, "same words here") for i in (5, 3, 9, 1)] + [(7, "other words")]
    got = run(frame, session, docs, [(1, "same")], k=2)
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 3)]


def test_pruning_is_exact_over_many_windows(frame, session, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 8)
    monkeypatch.setattr(search, "BLOCK", 4)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    docs = [(i, " ".join(vocab[(i * j) % 8] for j in range(1 + i % 13))) for i in range(200)]
    queries = [(q, " ".join(vocab[(q + j) % 8] for j in range(1 + q % 4))) for q in range(12)]
    assert run(frame, session, docs, queries) == brute(docs, queries)


def test_empty_tables(frame, session):
    assert run(frame, session, [], [(1, "a")]) == []
    assert run(frame, session, [(1, "a")], []) == []


@pytest.mark.parametrize("clash", ["uid", "qid", "shard", "term", "doc"])
def test_clashing_extra_columns(session, clash):
    d = session.createDataFrame([(1, "a b", 0), (2, "b c", 0)], f"doc_id long, text string, {clash} int")
    q = session.createDataFrame([(1, "b", 0)], f"item_id long, text string, {clash} int")
    got = rows(search.search(d, q), "item_id", "rank", "doc_id")
    assert got == [(1, 1, 1), (1, 2, 2)]
