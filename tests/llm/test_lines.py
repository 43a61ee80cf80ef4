import random

import numpy as np

from tests.llm.conftest import awkward
from tests.llm.test_common import union_find
from tributary.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_drops(rows, similarity=0.8):
    """All pairs of lines; an occurrence is (key, null first, row hash replaced by the text, line)."""
    places = {}
    for k, text in rows:
        for at, line in enumerate(lines.normalised(text)):
            if line:
                places.setdefault(line, set()).add((k, text, at))
    known = list(places)
    prints = [int(lines.simhashes([x])[0]) & (1 << 64) - 1 for x in known]
    links = []
    for i, a in enumerate(known):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                x, y = a.decode(), known[j].decode()
                if edits(x, y) <= np.floor((1 - similarity) * max(len(x), len(y)) + 1e-9):
                    links.append((i, j))
    root = union_find(links)
    groups = {}
    for i, a in enumerate(known):
        groups.setdefault(root.get(i, i), set()).update(places[a])
    gone = {}
    for group in groups.values():
        first = min(group, key=lambda p: (p[0] is not None, p[0], p[2]))
        for k, text, at in group - {first}:
            gone.setdefault((k, text), set()).add(at)
    return {k: ",".join(map(str, sorted(v))) for k, v in gone.items()}


def corpus():
    rng = random.Random(6)
    base = [" ".join(rng.choice("sun moon star rain wind leaf tree road".split()) + str(rng.randrange(9)) + rng.choice("abcd") for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(60)] += rng.choice(["", "x", ","])
            own.append(" ".join(words))
        own += ["", "Copyright 2021 by us!", "***"]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    return rows


def test_normalisation():
    assert lines.normalised("A,  b\t7!\n\n***\n É 12") == [b"a b 0", b"", b"", "é 00".encode()]
    assert lines.normalised(None) == [b""]


def test_words_hash_alike_in_any_run():
    alone = [int(lines.simhashes([x])[0]) for x in (b"one two three", b"four", b"five six")]
    assert lines.simhashes([b"one two three", b"four", b"five six"]).tolist() == alone
    same = lines.simhashes([b"two one three", b"three one two"])
    assert same[0] == same[1] == alone[0]


def test_majorities_of_long_and_short_runs():
    rng = np.random.default_rng(5)
    size = np.array([1, 2, 254, 255, 256, 700, 3])
    hashes = rng.integers(0, 1 << 63, size.sum()).astype(np.uint64) | np.uint64(1)
    first = np.cumsum(size) - size
    want = []
    for a, n in zip(first, size):
        own = [int(x) for x in hashes[a : a + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > n))
    assert [int(x) & (1 << 64) - 1 for x in lines.majorities(hashes, first, size)] == want


def test_edit_distances():
    rng = random.Random(3)
    for _ in range(1500):
        a = "".join(rng.choice("abü") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "bü"])
        b = "".join(b)
        d = edits(a, b)
        assert lines.edit_distance(a, b) == d
        assert edits(*lines.trimmed(a, b)) == d
        for most in (0, 1, 3, 20):
            assert lines.few_edits(a, b, most) == (d if d <= most else None)
        assert lines.similar(a, b, 0.8) == (d <= np.floor(0.2 * max(len(a), len(b)) + 1e-9))
    long = "word " * 20_000
    assert lines.similar(long, long[:50_000] + "x" + long[50_000:], 0.8) and not lines.similar(long, long[:70_000], 0.8)


def test_blocks_find_every_pair_within_three_bits(session):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    for v in list(values):
        for bits in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    prints = session.createDataFrame([(v, None) for v in signed], "fp long, label long")
    crowded = lines.crowded_keys(prints)
    got = {(r.a, r.b) for r in lines.near_fingerprints(crowded, prints).collect()}
    assert {(r.a, r.b) for r in lines.hub_fingerprints(crowded).collect()} <= got
    same = prints.selectExpr("fp", "7L as label")
    assert lines.near_fingerprints(crowded, same).isEmpty()
    mask = (1 << 64) - 1
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}


def test_keys_shared_by_chance_are_not_written(session):
    """Two equal blocks do not make a row: only fingerprints within three bits of another do."""
    rng = random.Random(8)
    chance = [rng.getrandbits(38) << 26 | 0x1234567 for _ in range(300)]
    near = chance[0] ^ 1 << 50
    signed = [v - (1 << 64) if v >> 63 else v for v in [*chance, near]]
    crowded = lines.crowded_keys(session.createDataFrame([(v,) for v in signed], "fp long")).collect()
    assert {r.fp for r in crowded} == {signed[0], signed[-1]} and {r.hub for r in crowded} == {min(signed[0], signed[-1])}
    assert len({r.key for r in crowded}) == len(crowded) / 2 == 6
    assert lines.crowded_keys(session.createDataFrame([], "fp long")).isEmpty()


def test_near_values_of_a_key():
    rng = random.Random(9)
    value = [rng.getrandbits(12) * 0x1001001 for _ in range(400)] + [7 << 40 | 1 << i for i in range(64)] * 2
    rows = np.array(sorted((rng.randrange(3) if i < 400 else 5, v) for i, v in enumerate(value)), dtype=np.uint64)
    near = lines.near_some(rows[:, 0], rows[:, 1])
    for i, (k, v) in enumerate(rows.tolist()):
        assert near[i] == any(j != i and k == x and (v ^ y).bit_count() <= 3 for j, (x, y) in enumerate(rows.tolist()))


def test_many_pairs_at_once_are_judged_as_each_alone():
    rng = random.Random(7)
    left, right = [], []
    for i in range(1200):
        size = 6000 if i < 3 else rng.choice([0, 1, 5, 63, 64, 65, 130, 300])
        a = [rng.choice("abcde é𝔘" if i % 3 else "ab c") for _ in range(size)]
        b = list(a)
        for _ in range(rng.randrange(size // 3 + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        left.append("".join(a))
        right.append("".join(b))
    want = [lines.similar(a, b, 0.8) for a, b in zip(left, right)]
    assert 200 < sum(want) < 1000
    assert lines.similar_pairs(left, right, 0.8).tolist() == want
    assert lines.similar_pairs([], [], 0.8).tolist() == []
    few = [(a, b) for a, b in zip(left, right) if 0 < len(a) <= len(b) < 140]
    few.sort(key=lambda p: -len(p[1]))
    got = lines.distances([a for a, _ in few], [b for _, b in few])
    assert got.tolist() == [lines.edit_distance(a, b) for a, b in few]


def test_filter_stops_no_wanted_row(session):
    rng = random.Random(2)
    wanted = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)]
    bits = lines.row_filter(session.createDataFrame([(w,) for w in wanted], "row_key long"))
    assert all(bits[w % lines.FILTER_BITS >> 3] >> (w % lines.FILTER_BITS & 7) & 1 for w in wanted)
    assert sum(int(b).bit_count() for b in bits) <= 500


def test_verdicts_against_brute_force(frame):
    rows = corpus()
    want = plain_drops(rows)
    assert len(want) > 20
    docs = frame(rows).selectExpr("*", "1 as line", "2 as h", "3 as lines")
    got = {r.doc_id: r for r in lines.line_verdicts(docs).collect()}
    assert {k: r.dropped for k, r in got.items()} == {k: want.get((k, t), "") for k, t in rows}
    assert all(got[k].n_lines == t.count("\n") + 1 for k, t in rows)


def test_rebuilt_texts(frame):
    docs = frame([(1, "same line here\nown first"), (2, "x y\nSame line, here!\n\nown second"), (3, None), (4, "")])
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == [
        "same line here\nown first", "x y\n\nown second", None, "",
    ]


def test_numbers_are_compared_digit_by_digit(frame):
    """Equal after masking, but only the last two pairs are alike in more than eight of ten characters."""
    texts = ["1999-12-31", "2021-01-05", "42", "17", "1.50", "15.0", "row 7 of the long table", "row 8 of the long table", "order 12345678", "order 12345679"]
    docs = frame(list(enumerate(texts)))
    got = {r.doc_id: r.n_dropped for r in lines.line_verdicts(docs).collect()}
    assert sorted(i for i in got if got[i]) == [7, 9]
    assert [r.text for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [t if i not in (7, 9) else "" for i, t in enumerate(texts)]
    for text in [*texts, "A,  b\t7!\n\n***\n É 12", "1,--2 3. .4", "", None, "7", "-7-"]:
        assert [lines.masked(x) for x in lines.literal(text)] == lines.normalised(text)
    rows = [(i, f"{i % 97:02d}.{i * 7919 % 10000:04d}") for i in range(60)]
    kept = {r.doc_id for r in lines.line_verdicts(frame(rows)).collect() if not r.n_dropped}
    near = [(i, j) for i in range(60) for j in range(i) if edits(rows[i][1], rows[j][1]) <= 1]
    root = union_find(near)
    assert kept == {min(j for j in range(60) if root.get(j, j) == root.get(i, i)) for i in range(60)}


def test_awkward_rows(frame):
    docs = frame(awkward())
    rows = lines.line_verdicts(docs).collect()
    assert len(rows) == len(awkward())
    # the null key comes first and keeps "one"; both rows of key 4 lose it
    assert sorted((str(r.doc_id), r.dropped) for r in rows if r.n_dropped) == [("4", "0"), ("4", "0")]
    twice = frame([(4, "one"), (4, "one")])
    assert [r.n_dropped for r in lines.line_verdicts(twice).collect()] == [0, 0]
    assert lines.line_verdicts(docs.limit(0)).count() == 0
    assert lines.dedup_lines(docs.limit(0)).count() == 0
