import pytest

from tributary.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def session(spark):
    return prepare(spark)


@pytest.fixture
def frame(session):
    """A documents table of (doc_id, text[, source]) rows."""

    def make(rows, schema=DOCS):
        if schema == DOCS:
            rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return session.createDataFrame(rows, schema)

    return make


def awkward():
    """Nulls, empty, blank and long texts, repeated rows, a null key and odd characters."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (4, "one"),
        (None, "one"),
        (None, None),
        (5, "ünï €  \U0001f600 \x00 text"),
        (6, "a" * 60_000),
        (7, "word " * 30_000),
    ]
