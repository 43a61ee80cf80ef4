import public_tokenizers
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import awkward
from tributary.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = st.sampled_from([*"ab1' \n\t.,é\u00a0\u3000x", "<|endoftext|>", "don't", " word", "  "])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), st.integers(1, 12))
def test_pieces_keep_the_count(text, limit):
    parts = list(tokens.pieces(text, limit))
    assert "".join(parts) == text
    model = tokens.tokenizer(PATH)
    count = lambda t: len(model.encode(t, add_special_tokens=False))
    assert sum(map(count, parts)) == count(text)


def test_batches_are_bounded():
    held = list(tokens.batches(["x y " * 5000, "", "a"], 1000, 4000))
    assert all(sum(map(len, b)) <= 4000 + 1010 for _, b in held)
    assert sorted({i for o, _ in held for i in o}) == [0, 1, 2]


def test_counts(frame):
    model = tokens.tokenizer(PATH)
    rows = [*awkward(), (8, "a <|endoftext|> b" * 300), (9, "mixed  spaces\n\n and 'quotes' " * 4000)]
    docs = frame(rows).selectExpr("*", "1 as n_tokens", "2 as k")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, PATH).collect())
    want = [
        (k or -1, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False))) for k, t in rows
    ]
    assert got == sorted(want)
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0
