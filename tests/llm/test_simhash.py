import random

import numpy as np
import xxhash

from tests.conftest import plan_of
from tests.llm.conftest import awkward
from tests.llm.test_common import union_find
from tributary.llm import simhash


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Brute force over all pairs of rows; a null key is the largest."""
    prints = [(k, plain_fingerprint(t)) for k, t in rows]
    edges = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 3
    ]
    root = union_find(edges)
    groups = {}
    for i, (k, _) in enumerate(prints):
        groups.setdefault(root.get(i, i), []).append(k)
    smallest = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return sorted(
        ((k, f"{f:016x}", smallest[root.get(i, i)]) for i, (k, f) in enumerate(prints)), key=repr
    )


def corpus():
    rng = random.Random(3)
    rows = awkward()
    for group in range(12):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(150)]
        for copy in range(6):
            changed = list(words)
            for _ in range(copy % 4):
                changed[rng.randrange(150)] = f"new{rng.randrange(99)}"
            rows.append((1000 + 37 * len(rows) % 500, " ".join(changed).upper() if copy == 5 else "\t".join(changed)))
    return rows


def test_golay_keys_meet_at_one_bit():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 300)
    near = words ^ (1 << rng.integers(0, 23, 300))
    row, index = simhash.codewords(np.concatenate((words, near)))
    keys = [set(index[row == i].tolist()) for i in range(600)]
    assert all(keys[i] & keys[300 + i] for i in range(300))
    assert {len(k) for k in keys} == {1, 6}
    errors = simhash.syndrome_errors()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3


def test_keys_find_every_pair_within_three_bits(session):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values):
        for bits in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = session.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    want = {
        (a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3
    }
    assert got == want


def test_components_against_brute_force(frame):
    rows = corpus()
    docs = frame(rows).selectExpr("*", "1 as fp", "2 as component_id")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == plain_components(rows)


def test_one_row_of_each_group_stays(frame):
    rows = corpus()
    kept = simhash.drop_near_duplicates(frame(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    groups = sorted({r[2] for r in plain_components(rows)}, key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == groups


def test_empty_table(frame):
    docs = frame(awkward()).limit(0)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_keys_are_never_broadcast(session):
    """A few kilobytes of fingerprints make 43 times as many keys, whatever the planner expects of them."""
    distinct = session.range(5000).selectExpr("xxhash64(id) AS fp")
    assert "BroadcastHashJoin" not in plan_of(simhash.links(distinct))
