import zlib
from collections import defaultdict

import numpy as np

from tests.llm.conftest import awkward
from tributary.llm import sharding


def placed(docs, shards=8):
    rows = sharding.shard_law(docs, shards).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, by


def test_rows_sizes_and_slots(frame):
    docs = frame(awkward()).selectExpr("*", "1 as shard", "2 as g")
    rows, _ = placed(docs)
    want = sorted((k or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in awkward())
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_groups_stay_together_and_a_hot_group_is_split(frame):
    rng = np.random.default_rng(4)
    rows = [(i, f"text {rng.integers(1 << 40)} " * int(rng.integers(1, 60))) for i in range(1500)]
    rows += [(5000 + i, "the same text " * 12) for i in range(1000)]
    rows += [(9000 + i, "three of these " * 9 + str(i // 3)) for i in range(600)]
    got, by = placed(frame(rows))
    size = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(size) <= 1.02 * min(size)
    counts = [len(by[s]) for s in range(8)]
    assert max(counts) <= 1.15 * min(counts)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    hot = zlib.crc32(("the same text " * 12).encode())
    assert len(where.pop(hot)) > 1 and all(len(s) == 1 for s in where.values())


def test_packing_prefers_the_matching_residual():
    vectors = np.array([[9.0, 1.0], [1.0, 9.0], [8.0, 1.0], [1.0, 8.0]])
    where = sharding.pack(vectors, 2, (1.0, 1.0))
    assert where[0] != where[1] and where[0] != where[2] and where[1] != where[3]


def test_repeatable_and_empty(frame):
    docs = frame([(i, f"t{i % 50}") for i in range(300)])
    first = {tuple(r) for r in sharding.assign_shards(docs).collect()}
    assert first == {tuple(r) for r in sharding.assign_shards(docs.repartition(7)).collect()}
    assert sharding.shard_law(docs.limit(0)).count() == 0
