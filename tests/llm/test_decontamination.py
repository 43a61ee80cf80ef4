import random

from tests.conftest import plan_of
from tests.llm.conftest import awkward
from tributary.llm import decontamination as dec

QUESTION = "A train leaves Paris at 9 and travels 120 km with Anna while Bob waits 30 minutes for Anna to arrive"
CHANGED = "A train leaves Rome at 8 and travels 75 km with Eve while Tom waits 45 minutes for Eve to arrive"
BROKEN = "A train leaves Rome at 8 and travels 75 km with Eve while Tom waits 45 minutes for Zoe to arrive"
FILLER = "some words of a page that nobody asks about, and more of them follow. "


def held(session, frame, texts, items):
    docs = frame(list(enumerate(texts))).selectExpr("*", "1 as item", "2 as window", "3 as k")
    bench = session.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = dec.contaminated(docs, bench).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_templates_are_found_with_other_slots(session, frame):
    texts = [FILLER, FILLER + QUESTION + ". " + FILLER, FILLER + CHANGED + " " + FILLER, FILLER + BROKEN, QUESTION.upper()]
    found = held(session, frame, texts, [QUESTION])
    assert set(found) == {(1, 0), (2, 0)}
    assert not found[1, 0].changed and found[2, 0].changed


def test_one_edit_of_a_repeated_value_leaves_the_other_windows(session, frame):
    edited = "Eve".join(QUESTION.rsplit("Anna", 1))
    both = "Zoe".join(edited.split("Anna"))
    found = held(session, frame, [FILLER + edited + " " + FILLER, FILLER + both], [QUESTION])
    assert set(found) == {(0, 0)}
    assert (found[0, 0].matched, found[0, 0].total, found[0, 0].changed) == (14, 17, True)


def test_slots_of_tokens(session):
    words = session.createDataFrame([("He met Anna, 3.5 km off; paid 20% on The 5th.\nBig day",)], "t string")
    got = words.select(dec.tokens(words.t).alias("w")).first().w
    assert got == ["he", "met", "\x01anna", "\x0235", "\x03km", "off", "paid", "\x0220\x03", "on", "\x01the", "\x025th", "big", "day"]


def windows(text, n=5):
    words = text.split()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_plain_words_against_brute_force(session, frame):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    items = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    texts = []
    for i in range(150):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            part = items[i % 20].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            text[len(text) // 2 : len(text) // 2] = part
        texts.append(" ".join(text))
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own = [tuple(item.split()[j : j + 5]) for j in range(max(1, len(item.split()) - 4))]
            there = windows(text, len(own[0])) if len(text.split()) >= len(own[0]) else set()
            if sum(w in there for w in own) >= 0.8 * len(own):
                want.add((d, i))
    assert set(held(session, frame, texts, items)) == want


def test_awkward_rows(session, frame):
    bench = session.createDataFrame([(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (4, "7 km"), (5, "one")], "item_id long, text string")
    docs = frame([*awkward(), (8, QUESTION), (8, QUESTION), (None, QUESTION), (9, "9 km"), (10, "7 km")])
    rows = sorted((str(r.doc_id), r.item_id) for r in dec.contaminated(docs, bench).collect())
    assert rows == sorted([("8", 1), ("None", 1), ("4", 5), ("None", 5), ("10", 4)])
    kept = dec.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 5, 6, 7, 9]))
    assert dec.contaminated(docs.limit(0), bench).count() == 0
    assert dec.contaminated(docs, bench.limit(0)).count() == 0
    assert dec.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_both_joins_agree(session, frame, monkeypatch):
    texts, items = [FILLER + QUESTION, CHANGED, BROKEN], [QUESTION, FILLER]
    small = set(held(session, frame, texts, items))
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 0)
    assert set(held(session, frame, texts, items)) == small


def test_no_python_in_the_plan(session, frame):
    bench = session.createDataFrame([(1, QUESTION)], "item_id long, text string")
    plan = plan_of(dec.drop_contaminated(frame([(1, QUESTION)]), bench))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
