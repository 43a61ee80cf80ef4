import re
from collections import Counter

from tests.conftest import plan_of, rows
from tests.llm.conftest import awkward
from tributary.llm import collocations as col

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_count, top=2000, longest=4):
    """The contract read literally: count every phrase, score every cut, test every longer one."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[(lang, tuple(words[i : i + size]))] += 1
    cands = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= min_count}
    out = {}
    for (lang, words), a in cands.items():
        best = None
        for k in range(1, len(words)):
            left, right = f[(lang, words[:k])], f[(lang, words[k:])]
            score = (2_000_000 * a) // (left + right)
            if best is None or score < best[0]:
                best = (score, left, right)
        contained = any(
            other_lang == lang and len(other) > len(words) and 100 * b >= 80 * a
            and any(other[s : s + len(words)] == words for s in range(len(other) - len(words) + 1))
            for (other_lang, other), b in cands.items()
        )
        if not contained:
            out.setdefault(lang, []).append((-best[0], -a, " ".join(words).encode(), best[1], best[2]))
    result = []
    for lang, items in out.items():
        items.sort()
        for rank, (score, a, phrase, left, right) in enumerate(items[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result, key=repr)


def mine(session, docs, **kw):
    frame = session.createDataFrame(docs, "text string, lang string")
    got = col.collocations(frame, **kw)
    return rows(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score")


TEXT = [
    ("New York is big. new york city, NEW YORK CITY hall; the new york times", "en"),
    ("the new york times and new york city hall. The New  York\tcity", "en"),
    ("hot dog hot dog hot dog! hot dog stand, hot dog stand", "en"),
    ("der hot dog hot dog ist gut. hot dog", "de"),
    ("a b a b a b a b a b a b", None),
]


def test_matches_brute_force(session):
    assert mine(session, TEXT, min_count=2) == brute(TEXT, 2)


def test_spills_and_false_positives_change_nothing(session, monkeypatch):
    monkeypatch.setattr(col, "BLOOM_BITS", 64)
    expect = brute(TEXT * 3, 3)
    assert mine(session, TEXT * 3, min_count=3) == expect
    frame = session.createDataFrame(TEXT * 3, "text string, lang string")
    spilled = rows(col.collocations(frame, min_count=3).drop("k"))
    assert sorted(spilled, key=repr) == expect
    tiny = col.counts(frame, min_count=3, spill=2)
    assert rows(tiny) == rows(col.counts(frame, min_count=3))


def test_top_and_ties(session):
    docs = [("x y. p q. m n. x y. p q. m n", "en")]
    got = mine(session, docs, min_count=2, top=2)
    assert got == brute(docs, 2, top=2)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == ["m n", "p q"]


def test_awkward_rows(session):
    docs = [(text, "en") for _, text in awkward()] + [(None, None), ("", "fr")]
    assert mine(session, docs, min_count=2) == brute(docs, 2)


def test_empty_table(session):
    assert mine(session, [], min_count=2) == []


def test_extra_clashing_columns(session):
    frame = session.createDataFrame(
        [(t, l, 1, "x") for t, l in TEXT], "text string, lang string, phrase int, rest string"
    )
    got = rows(col.collocations(frame, min_count=2), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got == brute(TEXT, 2)



def test_every_longest_length(session):
    for longest in (1, 2, 3, 5, 6):
        assert mine(session, TEXT * 2, min_count=2, longest=longest) == brute(TEXT * 2, 2, longest=longest)


def test_three_and_four_words_are_counted_in_one_pass(session, monkeypatch):
    passes, real = [], col._count_level

    def counted(encoded, length, *args, **kw):
        passes.append(length)
        return real(encoded, length, *args, **kw)

    monkeypatch.setattr(col, "_count_level", counted)
    frame = session.createDataFrame(TEXT, "text string, lang string")
    found = rows(col.counts(frame, min_count=2), "lang", "phrase", "len", "f")
    assert passes == [2, 3]
    assert ("en", "new york city hall", 4, 2) in found and ("en", "hot dog hot", 3, 2) in found


def test_texts_are_split_once(session):
    frame = session.createDataFrame(TEXT, "text string, lang string")
    assert "regexp_extract_all" not in plan_of(col.collocations(frame, min_count=2))
