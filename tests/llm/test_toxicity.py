import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import awkward
from tributary.llm import toxicity as tox

INSULTS = ["idiot", "moron", "scum", "loser", "stupid"]
PLAIN = "the river runs along old stone walls and many boats drift slowly under wide bridges toward town".split()


def corpus(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(["", "s", "ing"]) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(INSULTS)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture
def fitted(session, frame):
    rows, labels = corpus()
    labels = session.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return frame(rows), labels


@pytest.mark.parametrize(
    ("hidden", "word"),
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("s c u m", "scum"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("l-0-5-3-r", "loser")],
)
def test_restoration(session, frame, hidden, word):
    rows, _ = corpus()
    model = tox.character_model(tox.character_pairs(frame(rows)))
    assert word in tox.words_of(f"you {hidden} there!", model)


def best_path(token, model):
    """Every path through a short token's lattice."""
    paths = [("", 0.0, "")]
    for at, char in enumerate(token):
        before = token[at - 1] if at else ""
        options = [(c, tox.SWAP) for c in tox.IMITATES.get(char, "")] + ([(char, 0.0)] if char.isalpha() else [])
        after = [
            (p + c, v + model.get(last, {}).get(c, tox.UNSEEN) - cost, c) for p, v, last in paths for c, cost in options
        ]
        if char == before:
            after += [(p, v - tox.REPEAT, last) for p, v, last in paths]
        elif not options:
            after += [(p, v - tox.JOIN, last) for p, v, last in paths]
        paths = after
    return max(v + model.get(last, {}).get("", tox.UNSEEN) for _, v, last in paths), paths


def test_viterbi_finds_the_best_path(frame):
    model = tox.character_model(tox.character_pairs(frame(corpus()[0])))
    rng = random.Random(8)
    for _ in range(60):
        token = "".join(rng.choice("aost10!-$|5") for _ in range(7))
        best, paths = best_path(token, model)
        found = tox.restore(token, model)
        values = [v + model.get(last, {}).get("", tox.UNSEEN) for p, v, last in paths if p == found]
        assert max(values) == pytest.approx(best)


def test_character_counts_against_brute_force(frame):
    texts = ["Ab b", None, "", "É1a", "x" * 50_000]
    counts = {(r.pair // tox.SYMBOLS, r.pair % tox.SYMBOLS): r.n for r in tox.character_pairs(frame(list(enumerate(texts)))).collect()}
    want = {}
    for t in texts:
        line = [ord(c) if c.isalpha() and ord(c) < tox.SYMBOLS else 0 for c in f" {t or ''} ".lower()]
        for pair in zip(line, line[1:]):
            want[pair] = want.get(pair, 0) + 1
    assert counts == want


def test_held_out_accuracy_and_hidden_insults(fitted, frame):
    docs, labels = fitted
    rows = {r.doc_id: r for r in tox.judged(docs, labels).collect()}
    truth = {i: t for i, _, t in corpus()[1]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert len(held) > 150 and all(rows[i].predicted == truth[i] for i in held)
    model = tox.fit(docs, labels)
    score = model.scorer()
    assert score("the river and the 1d10t walls") > 0.3 > score("the river and the walls")


def test_labels_of_the_held_out_fold_change_nothing(fitted, session):
    docs, labels = fitted
    flipped = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where(~tox.in_training("doc_id"))
    other = labels.where(tox.in_training("doc_id")).unionByName(flipped)
    first = {r.doc_id: r.score for r in tox.judged(docs, labels).collect()}
    assert first == {r.doc_id: r.score for r in tox.judged(docs, other).collect()}


def test_awkward_rows(fitted, session, frame):
    docs, labels = fitted
    odd = frame(awkward()).selectExpr("*", "1 as score", "2 as k")
    rows = tox.judged(odd, labels.limit(0)).collect()
    assert len(rows) == len(awkward()) and len({r.score for r in rows}) == 1
    nulls = labels.unionByName(session.createDataFrame([(None, 1, 1), (3, None, None), (6, 1, 1)], labels.schema))
    model = tox.fit(docs.unionByName(frame(awkward())), nulls)
    scores = [r.score for r in tox.toxicity_scores(odd, model).collect()]
    assert len(scores) == len(awkward()) and all(0 <= s <= 1 for s in scores)
    assert tox.judged(docs.limit(0), labels).count() == 0
    kept = tox.drop_toxic(odd, labels.limit(0))
    assert kept.count() == len(awkward()) and kept.columns == odd.columns


def test_logistic_needs_no_feature_for_noise():
    from types import SimpleNamespace

    class Row(SimpleNamespace):
        def __getitem__(self, name):
            return getattr(self, name)

    rows = [Row(y=1, found=[0], count=30), Row(y=0, found=[1], count=40), Row(y=0, found=[], count=400), Row(y=1, found=[1], count=4)]
    weights, bias = tox.logistic(rows, 2, {0: 1.0, 1: 1.0})
    chance = lambda *on: 1 / (1 + np.exp(-bias - sum(weights[i] for i in on)))
    assert chance(0) > 0.8 and chance(1) < 0.3 and chance() < 0.1
