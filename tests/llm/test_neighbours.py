import numpy as np
import pytest

from tributary.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, k=5, every=50):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, query in good:
        if q % every:
            continue
        a = np.array(query, dtype=np.float32).astype(float)
        scored = []
        for i, v in good:
            if i != q and len(v) == len(query):
                b = np.array(v, dtype=np.float32).astype(float)
                scored.append((-float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), i))
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def found(session, rows, **options):
    frame = session.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as id", "2 as dim")
    out = {}
    for r in nn.nearest(frame, frame.where("vec_id % 50 = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_over_shards(session):
    v = np.random.default_rng(1).normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want, got = exact(rows), found(session, rows, shard_rows=700)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.95 * 5 * len(want)
    for q in want:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)


def test_recall_in_clusters(session):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(20, 16)).repeat(80, 0) + 0.05 * rng.normal(size=(1600, 16))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want, got = exact(rows), found(session, rows, shard_rows=2000)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_common_vector_and_ties(session):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(150)]
    rows += [(1000 - i, [1.0] * 8) for i in range(150)]
    want, got = exact(rows), found(session, rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q]))


def test_awkward_rows(session):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]),
            (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0]), (350, [0.5, 0.5]),
            (400, [1.0, 2.0, 3.0]), (1, [0.0, -3.0]), (2, [3e38, 3e38])]
    want, got = exact(rows), found(session, rows)
    assert got.keys() == {0, 350}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert found(session, []) == {}


def test_huge_and_tiny_vectors_rank_by_their_cosines(session):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    scaled = [(i, (x * (1e200 if i % 3 == 0 else 1e-200 if i % 3 == 1 else 1.0)).tolist()) for i, x in enumerate(base)]
    frame = session.createDataFrame(scaled, "vec_id long, embedding array<double>")
    got = {}
    for r in nn.nearest(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for q in (0, 50, 100):
        a = base[q]
        scored = sorted((-(a @ base[i]) / np.linalg.norm(a) / np.linalg.norm(base[i]), i) for i in range(120) if i != q)
        want[q] = [(i, -s) for s, i in scored[:5]]
    assert [i for q in sorted(got) for i, _ in got[q]] == [i for q in sorted(want) for i, _ in want[q]]
    assert all(np.isfinite(s) for q in got for _, s in got[q])
    assert [s for q in sorted(got) for _, s in got[q]] == pytest.approx([s for q in sorted(want) for _, s in want[q]], rel=1e-12)


def test_cosines_of_huge_and_tiny_vectors():
    import math

    import numpy as np

    from tributary.llm.neighbours import cosines

    plain = cosines(np.array([[1.0, 2.0], [3.0, -1.0]]), np.array([1.0, 1.0]))
    for scale in (1e200, 1e-200, 1e-310):
        got = cosines(np.array([[1.0, 2.0], [3.0, -1.0]]) * scale, np.array([1.0, 1.0]) * scale)
        assert np.all(np.isfinite(got)) and np.allclose(got, plain, rtol=1e-12, atol=0)
    assert math.isclose(plain[0], 3 / math.sqrt(10), rel_tol=1e-15)
    exact = np.array([[0.1, 0.7, -0.3]])
    assert cosines(exact * 2.0**600, np.array([0.2, 0.5, 0.9]) * 2.0**-600)[0] == cosines(exact, np.array([0.2, 0.5, 0.9]))[0]
