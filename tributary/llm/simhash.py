"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four blocks of 16 bits.  At 3 or fewer differing bits one
block is equal, and of the two 24-bit halves of the other 48 bits one differs in at most
one bit.  23 bits of each half are decoded with the perfect binary Golay code: the
codewords nearest to the half and to its 23 neighbours at one bit are one or six, and two
halves that differ in at most one bit share one of them.  So fingerprints are joined on
(equal block, codeword index), a key of 28 bits, and the bit distance is verified in the
join.  Equal fingerprints are collapsed first; a fingerprint has fewer than 43,745 others
within 3 bits, so links stay proportional to the fingerprints however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tributary.llm.common import components, shelter, stored

SEED = 42
MAX_BITS = 3
#: Generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b110001110101
BLOCKS = tuple(((0xFFFF << 16 * i) ^ (1 << 64)) - (1 << 64) if i == 3 else 0xFFFF << 16 * i for i in range(4))


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text (ASCII case folded, ASCII white space splits).

    Fewer words than a shingle make one shingle; no words give zero.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(parts) - words + 1)
    ends = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends)], dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows ``(k, row_key, fp)``: the key, a hash of key and text, the fingerprint as a signed long."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("t").cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [frame.column("k"), frame.column("row_key"), pa.array(values)], names=["k", "row_key", "fp"]
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("row_key"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"k {kind}, row_key long, fp long")


@lru_cache(maxsize=1)
def syndrome_errors() -> np.ndarray:
    """The error pattern of weight 0 to 3 of each syndrome; the code is perfect, so all 2048 are met."""
    table = np.zeros(2048, dtype=np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            table[syndrome(np.array([error]))[0]] = error
    return table


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words, as polynomials over two elements, by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the 12-bit indices of the codewords nearest to a word or to a neighbour of it."""
    near = words[:, None] ^ np.concatenate(([0], 1 << np.arange(23)))[None, :]
    index = np.sort((near ^ syndrome_errors()[syndrome(near)]) >> 11, axis=1)
    fresh = np.concatenate((np.ones((len(words), 1), bool), index[:, 1:] != index[:, :-1]), axis=1)
    row, column = np.nonzero(fresh)
    return row, index[row, column]


def fuzzy_keys(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, row, mask of the other half that was tried before) for every block and half."""
    v = values.view(np.uint64)
    for block in range(4):
        equal = (v >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64)
        places = [b for b in range(64) if b // 16 != block]
        for half in range(2):
            bits = places[24 * half : 24 * half + 23]
            word = np.zeros(len(v), dtype=np.int64)
            for i, b in enumerate(bits):
                word |= (v >> np.uint64(b) & np.uint64(1)).astype(np.int64) << i
            before = sum(1 << b for b in places[:23]) if half else 0
            row, index = codewords(word)
            key = (block * 2 + half) << 28 | equal[row] << 12 | index
            yield key, row, np.full(len(row), before, dtype=np.uint64).view(np.int64)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints ``fp`` at ``max_bits`` or fewer bits.

    A pair is kept at the first block and half that finds it; the codewords shared there
    can repeat it.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys are complete up to {MAX_BITS} bits")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            values = np.array(frame.column("fp").to_numpy(zero_copy_only=False), dtype=np.int64)
            for key, row, before in fuzzy_keys(values):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(values[row]), pa.array(before)], names=["key", "fp", "before"]
                )

    keys = distinct.select("fp").mapInArrow(run, "key long, fp long, before long")
    left = keys.select("key", F.col("fp").alias("a"), "before")
    # planned by the size of the fingerprints, but 43 times as many rows: never broadcast
    right = keys.select(F.col("key").alias("same"), F.col("fp").alias("b")).hint("merge")
    other = F.col("a").bitwiseXOR(F.col("b"))
    block = F.shiftright("key", 29)
    fresh = [(block <= i) | (other.bitwiseAND(F.lit(BLOCKS[i])) != 0) for i in range(3)]
    return left.join(
        right,
        (F.col("key") == F.col("same"))
        & (F.col("a") < F.col("b"))
        & (F.bit_count(other) <= max_bits)
        & fresh[0]
        & fresh[1]
        & fresh[2]
        & ((F.col("before") == 0) | (F.bit_count(other.bitwiseAND(F.col("before"))) > 1)),
    ).select("a", "b")


def grouped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS
) -> tuple[DataFrame, DataFrame]:
    """The fingerprint table, and ``(fp, first, component, smallest)`` of each distinct fingerprint."""
    prints = stored(fingerprints(docs, key, text, words), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("k").alias("first")), "distinct")
    member = components(links(distinct, max_bits))
    known = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = known.groupBy("component").agg(F.min("first").alias("smallest"))
    return prints, known.join(smallest, "component")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """Rows ``(key, fingerprint, component_id)``, one for every row of ``docs``.

    ``component_id`` is the smallest key that links of ``max_bits`` or fewer bits reach.
    Null and empty texts have fingerprint zero and are linked like any other; a null key is
    larger than any; repeated rows repeat; an empty table gives no rows; other columns are
    not read.
    """
    prints, groups = grouped(docs, key, text, words, max_bits)
    return prints.join(groups.select("fp", "smallest"), "fp", "left").select(
        F.col("k").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("smallest").alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates.

    The row with the smallest key stays (of several, the one with the smallest row hash; of
    repeated rows, one), so a component of null keys keeps a row as well.
    """
    docs, restore = shelter(docs, {"winner", "copies"})
    prints, groups = grouped(docs, key, text, words, max_bits)
    least = prints.groupBy("fp", "k").agg(F.min("row_key").alias("row_key"), F.count("*").alias("n"))
    winner = (
        least.join(groups.select("fp", "component", "smallest"), "fp")
        .where(F.col("k").eqNullSafe(F.col("smallest")))
        .groupBy("component")
        .agg(F.min("row_key").alias("winner"))
    )
    kept = stored(winner.select("winner"), "winners")
    copies = prints.join(kept, prints["row_key"] == kept["winner"]).groupBy("winner").agg(F.count("*").alias("copies"))
    # whole rows are shuffled once, at every size alike: the winners grow with the documents
    tagged = docs.withColumn("__row_key", F.xxhash64(key, text)).join(
        stored(copies, "copies").hint("merge"), F.col("__row_key") == F.col("winner")
    )
    once = tagged.where("copies = 1").select(*docs.columns)
    repeated = tagged.where("copies > 1").dropDuplicates(["__row_key"]).select(*docs.columns)
    return restore(once.unionByName(repeated))
