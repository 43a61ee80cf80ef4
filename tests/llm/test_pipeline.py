import random
from collections import Counter

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.llm.test_simhash import plain_components
from tributary.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def corpus():
    rng = random.Random(12)
    vocabulary = [a + b for a in "ba de ki lo mu na po ru si to".split() for b in "ral ten mis vok dan".split()]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(20)) for i in range(6)]
    rows, labels = [], []
    for i in range(900):
        body, source = text(rng.randrange(30, 80)), "main" if i % 3 else f"side{i % 4}"
        if i % 5 == 0:
            body += " " + rng.choice(["scumbag", "moronic", "worthless"]) + " " + text(3)
        elif i % 37 == 1:
            body = text(10) + " " + items[i % 6][1] + " " + text(10)
        if i % 4:
            labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, body, source))
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(0, 300, 2)]  # exact copies
    rows += [(3000, None, "main"), (3001, "", "main"), (None, "a text without a key " * 9, None)]
    return rows, labels, items


@pytest.fixture
def folder(session, frame, tmp_path):
    rows, labels, items = corpus()
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    session.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    session.createDataFrame(items, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plain_holds(text, items):
    words = (text or "").split()
    there = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    own = [[tuple(t.split()[j : j + 5]) for j in range(16)] for _, t in items]
    return any(sum(w in there for w in o) >= 0.8 * len(o) for o in own)


def test_every_stage_against_brute_force(session, folder):
    _, _, items = corpus()
    docs = session.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(session, docs, folder)
        if name != "sharding":
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/{name}")
        docs = session.read.parquet(f"{folder}/{name}")
        seen[name] = (before, docs.collect())

    before, after = seen["toxicity"]
    bad = {i for i, _, _ in corpus()[0] if i is not None and i < 900 and i % 5 == 0}
    bad |= {2000 + i for i in bad if i < 300 and i % 2 == 0}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id not in bad)

    before, after = seen["near_duplicates"]
    groups = {g for _, _, g in plain_components([(r.doc_id, r.text) for r in before])}
    assert Counter(r.doc_id for r in after) == Counter(groups)

    before, after = seen["decontamination"]
    want = [r for r in before if not plain_holds(r.text, items)]
    assert 0 < len(want) < len(before) and Counter(after) == Counter(want)

    before, after = seen["mixing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and len(after) > len(before)
    assert max(Counter(r.doc_id for r in after).values()) <= 2

    before, after = seen["sharding"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    assert Counter(r.text_crc32 for r in after).keys() == Counter(r.text_crc32 for r in after).keys()


def test_run_and_registration(session, folder):
    rows = corpus_pipeline.run(session, folder)
    assert {"doc_id", "shard", "slot"} <= set(rows.columns) and rows.count() > 300
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages_take_empty_tables(session, folder):
    empty = session.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(session, empty, folder).count() == 0


def test_scores_use_the_text_alone(session, frame):
    rows, labels, _ = corpus()
    model = toxicity.fit(frame(rows), session.createDataFrame(labels, LABELS))
    docs = frame([(1, "moronic tenlo"), (77, "moronic tenlo")]).selectExpr("doc_id", "text", "'x' as lang", "source")
    assert len({r.score for r in toxicity.toxicity_scores(docs, model).collect()}) == 1
