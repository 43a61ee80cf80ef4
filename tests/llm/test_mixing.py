import math
from collections import Counter

import pytest

from tests.llm.conftest import awkward
from tributary.llm import mixing


def corpus():
    """Source a holds most tokens, d very few."""
    sizes = {"a": 300, "b": 100, "c": 40, "d": 10}
    return [(i * 10 + j, f"w{i} " * 20, s) for j, (s, n) in enumerate(sizes.items()) for i in range(n)]


def test_exponent_meets_the_repetition_limit(frame):
    rows = mixing.plan(frame(corpus()), entropy=1.0, repetition=3.0, block_tokens=200).collect()
    assert max(r.repeats for r in rows) == pytest.approx(3.0, abs=1e-4)
    assert min(r.repeats for r in rows) == 1.0
    a = rows[0].exponent
    total = sum(r.tokens**a for r in rows)
    assert all(r.weight == pytest.approx(r.tokens**a / total) for r in rows)


def test_exponent_meets_the_entropy(frame):
    rows = mixing.plan(frame(corpus()), entropy=0.8, repetition=None).collect()
    entropy = -sum(r.weight * math.log(r.weight) for r in rows) / math.log(len(rows))
    assert entropy == pytest.approx(0.8, abs=1e-5)


def test_natural_shares_stay_when_they_meet_the_target(frame):
    docs = frame([(i, "a b c", "xyz"[i % 3]) for i in range(30)])
    rows = mixing.plan(docs).collect()
    assert {(r.exponent, r.repeats) for r in rows} == {(1.0, 1.0)}


def test_budgets_are_met_and_every_row_appears(frame):
    docs = frame(corpus())
    plan = mixing.plan(docs, entropy=1.0, repetition=2.5, block_tokens=200)
    out = mixing.mixed(docs, plan).collect()
    assert {r.doc_id for r in out} == {r[0] for r in corpus()}
    tokens = Counter()
    for r in out:
        tokens[r.source] += 20
    for p in plan.collect():
        assert tokens[p.s[1:]] == pytest.approx(p.repeats * p.tokens, abs=20)
    # an epoch holds a row at most once, and whole blocks stop where the budget is met
    assert max(Counter((r.doc_id, r.mix_epoch) for r in out).values()) == 1
    assert all(0 <= r.mix_position < 1 for r in out)
    for p in plan.collect():
        blocks = {(r.mix_block, r.mix_epoch) for r in out if r.source == p.s[1:]}
        assert len({b for b, e in blocks if e == 0}) <= p.blocks


def test_last_epoch_is_a_prefix_of_its_permutation(frame):
    """The sum up to the stop, by brute force over the sorted rows of each source."""
    docs = frame(corpus())
    plan = {p.s: p for p in mixing.plan(docs, entropy=1.0, repetition=2.5, block_tokens=200).collect()}
    held = docs.withColumn("s", mixing.source_name("source")).withColumn("row", mixing.row_hash("doc_id", "text"))
    for s, p in plan.items():
        if p.stop_row is None:
            continue
        own = held.where(held.s == s).selectExpr("doc_id", "row", "s", f"{p.blocks}L as blocks", f"{p.full} as full")
        own = own.withColumn("block", mixing.block_of(own.row, own.blocks))
        own = own.withColumn("order", mixing.block_hash(own.full, own.s, own.block)).collect()
        before = sum(20 for r in own if (r.order, r.block, r.row) < (p.stop_order, p.stop_block, p.stop_row))
        assert before < p.budget <= before + 20


def test_awkward_rows(frame):
    rows = [(k, t, s) for (k, t), s in zip(awkward(), [None, None, "x", "x", "x", "y", None, "y", "y", "z"])]
    docs = frame(rows).selectExpr("*", "1 as s", "2 as mix_block", "3 as row", "4 as tokens")
    out = mixing.mixed(docs, mixing.plan(docs))
    assert set(out.columns) == {*docs.columns, *mixing.ADDED}
    want = Counter((k, t) for k, t in awkward())
    got = Counter((r.doc_id, r.text) for r in out.where("mix_epoch = 0").collect())
    assert got == want
    empty = docs.limit(0)
    assert mixing.mixed(empty, mixing.plan(empty)).count() == 0
    blank = frame([(1, None, "a"), (2, "", "b")])
    assert mixing.mixed(blank, mixing.plan(blank)).count() == 2
