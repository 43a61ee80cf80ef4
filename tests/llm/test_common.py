import random

from tributary.llm.common import components


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def solved(session, edges):
    rows = components(session.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_random_graphs(session):
    rng = random.Random(5)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    assert solved(session, edges) == union_find(edges)


def test_chain_star_loops_and_repeats(session):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 50)]
    assert solved(session, chain + star + star + [(7, 7), (99, 99)]) == union_find(chain + star)


def test_no_edges(session):
    assert solved(session, []) == {}
    assert solved(session, [(3, 3)]) == {}


def test_stages_keep_clashing_extra_columns(frame, session):
    from tributary.llm import decontamination, lines, mixing, simhash

    base = [(1, "the cat sat on the mat today"), (2, "the cat sat on the mat today"), (3, "a wholly other text here")]
    extra = "doc_id long, text string, lang string, source string, n_chars long, winner int, copies int, __held int, __s int, __gone int, __row_key int"
    docs = session.createDataFrame([(k, t, "en", "s", len(t), 7, 8, 9, 10, 11, 12) for k, t in base], extra)
    bench = session.createDataFrame([(1, "nothing like the documents at all")], "item_id long, text string")
    for out in (
        simhash.drop_near_duplicates(docs, words=3, max_bits=3),
        decontamination.drop_contaminated(docs, bench),
        lines.dedup_lines(docs),
        mixing.mixed(docs, mixing.plan(docs, entropy=0.98, repetition=2.0)),
    ):
        got = out.collect()
        assert got and all(r["winner"] == 7 and r["copies"] == 8 and r["__held"] == 9 and r["__s"] == 10 for r in got)
        assert out.columns[: len(docs.columns)] == docs.columns
