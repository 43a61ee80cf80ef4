"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts longer than ``piece_bytes`` are cut where the tokenizer's own pre-tokenizer cuts (a
single space between two non-space characters), so the counts of the pieces add up to the
count of the whole text.  Batches close when they hold ``batch_bytes`` bytes, whatever the
number of texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECE_BYTES, BATCH_BYTES = 32 << 10, 1 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer per worker process; parallelism comes from Spark's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str, limit: int) -> Iterator[str]:
    """Cut ``text`` before single spaces, about every ``limit`` characters.

    Where no such place follows, the rest stays whole: a cut anywhere else could change the
    count.
    """
    start = 0
    while len(text) - start > limit:
        at = text.find(" ", start + limit)
        while 0 < at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def batches(texts: list[str], piece_bytes: int, batch_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces with the index of their text, in batches of about ``batch_bytes`` bytes."""
    owner: list[int] = []
    held: list[str] = []
    room = batch_bytes
    for i, text in enumerate(texts):
        for piece in pieces(text, piece_bytes):
            owner.append(i)
            held.append(piece)
            room -= len(piece) + 64
            if room <= 0:
                yield owner, held
                owner, held, room = [], [], batch_bytes
    if held:
        yield owner, held


def token_counts(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    piece_bytes: int = PIECE_BYTES,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row ``(key, n_bytes, n_tokens)`` per input row.

    ``path`` is a ``.json`` vocabulary readable at the same place on every worker.  No
    tokens are added around a text; special strings inside texts count as the library
    counts them by default.  A null or empty text counts zero; repeated rows, null keys and
    extra columns need no care; an empty table gives no rows.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for frame in frames:
            texts = [t or "" for t in frame.column("t").to_pylist()]
            counts = [0] * len(texts)
            for owner, held in batches(texts, piece_bytes, batch_bytes):
                for i, encoded in zip(owner, model.encode_batch_fast(held, add_special_tokens=False), strict=True):
                    counts[i] += len(encoded)
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [frame.column("k"), sizes, pa.array(counts, pa.int64())], names=[key, "n_bytes", "n_tokens"]
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
