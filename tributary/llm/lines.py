"""Fuzzy line deduplication.

Lines are normalised (case, punctuation outside of numbers and white space) and count as
repeats when equal then.  With their digits masked, their words make a 64-bit SimHash, and
distinct fingerprints are joined on pigeonhole blocks: of five blocks at least two are equal
at three or fewer differing bits.  Pairs of lines whose edit similarity, digits as they
stand, is ``similarity`` or more are linked, and of each connected group, exact repeats
included, the first occurrence stays.  Blank lines, and lines without a letter or digit, are
never dropped.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.llm.common import components, shelter, stored

MAX_BITS, SIMILARITY = 3, 0.8
#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Every digit becomes 0 in what is fingerprinted; punctuation goes.
DIGITS = bytes.maketrans(b"123456789", b"000000000")
PUNCTUATION = string.punctuation.encode()
#: White space other than the line feed becomes a space.
SPACES = bytes.maketrans(b"\t\v\f\r", b"    ")
#: By byte: 1 for punctuation, 2 for a digit.
KIND = np.array([1 if i in PUNCTUATION else 2 if i in b"0123456789" else 0 for i in range(256)], dtype=np.uint8)
#: Lines are hashed in runs of about so many bytes.
RUN_BYTES = 1 << 17
#: An odd multiplier and its inverse modulo 2 ** 64, for hashes of all words of a run at once.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def normalised(text: str | None) -> list[bytes]:
    """The lines of a text, in order, masked and with single spaces; null is one empty line."""
    folded = (text or "").lower().encode().translate(DIGITS, PUNCTUATION)
    return single_spaced(folded)


def single_spaced(folded: bytes) -> list[bytes]:
    """The lines without white space at their ends, and with one space for each run of it."""
    lines = [line.strip(b" ") for line in folded.translate(SPACES).split(b"\n")]
    return [b" ".join(line.split()) if b"  " in line else line for line in lines]


def literal(text: str | None) -> list[bytes]:
    """The same lines with their digits, and with the punctuation between two digits."""
    folded = (text or "").lower().encode()
    kind = KIND[np.frombuffer(folded, dtype=np.uint8)]
    if (kind == 2).any():
        drop = kind == 1
        drop[1:-1] &= (kind[:-2] != 2) | (kind[2:] != 2)
        folded = np.frombuffer(folded, dtype=np.uint8)[~drop].tobytes()
    else:
        folded = folded.translate(None, PUNCTUATION)
    return single_spaced(folded)


def masked(line: bytes) -> bytes:
    return line.translate(DIGITS, PUNCTUATION)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, RUN_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def simhashes(lines: list[bytes]) -> np.ndarray:
    """SimHash over the words of each line; no line may be empty."""
    run = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)
    gap = (run == 32) | (run == 10)
    ends = np.flatnonzero(gap)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((run.astype(np.uint64) + 1) * powers(FACTOR, len(run)))))
    words = (sums[ends] - sums[starts]) * powers(INVERSE, len(run))[starts]
    words ^= words >> np.uint64(31)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    words ^= words >> np.uint64(29)
    words *= np.uint64(0x94D049BB133111EB)
    words ^= words >> np.uint64(32)
    last = np.flatnonzero(run[ends] == 10)
    first = np.concatenate(([0], last[:-1] + 1))
    size = last - first + 1
    return majorities(words, first, size)


#: The bits of a byte as eight counters of a byte each.
LANES = sum((np.arange(256, dtype=np.uint64) >> np.uint64(i) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def majorities(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that more than half of them have.

    Bits are counted eight to a word, in parts of at most 255 hashes, so that no counter
    overflows into the next.
    """
    parts = (size + 254) // 255
    begin = np.cumsum(parts) - parts
    part = np.arange(parts.sum()) - np.repeat(begin, parts)
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(first, parts) + 255 * part, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), begin, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def runs(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line) + 1
        if size >= RUN_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lines):
        yield start, len(lines)


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(key, text)


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(k, row_key, line, h, fp, n)`` of every line with content; n is its length."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            owner, place, lines = [], [], []
            for i, value in enumerate(frame.column("t").to_pylist()):
                for j, line in enumerate(literal(value)):
                    if line:
                        owner.append(i)
                        place.append(j)
                        lines.append(line)
            for a, b in runs(lines):
                part = lines[a:b]
                rows = pa.array(owner[a:b], pa.int32())
                norm = pa.array(part, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column("k").take(rows),
                        frame.column("row_key").take(rows),
                        pa.array(place[a:b], pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(x) for x in part], pa.binary()),
                        pa.array(simhashes([masked(x) for x in part])),
                        pc.utf8_length(norm),
                    ],
                    names=["k", "row_key", "line", "h", "fp", "n"],
                )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("k"), row_key(key, text).alias("row_key"), F.col(text).alias("t"))
    return source.mapInArrow(run, f"k {kind}, row_key long, line int, h binary, fp long, n int")


def _block(fp: str, i: int) -> Column:
    at, width = BLOCKS[i]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def checked_bits(max_bits: int) -> int:
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the blocks are complete up to {MAX_BITS} bits")
    return max_bits


def run_starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)


def near_some(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values, sorted by key, have another of their key within ``MAX_BITS``."""
    near = np.zeros(len(key), dtype=bool)
    starts = run_starts(key)
    at, step = np.flatnonzero(key[1:] == key[:-1]), 1
    while len(at):
        unsure = ~(near[at] & near[at + step])
        a = at[unsure]
        a = a[np.bitwise_count(value[a] ^ value[a + step]) <= MAX_BITS]
        near[a] = near[a + step] = True
        step += 1
        if step % 64 == 0:  # a large family is soon near throughout
            settled = np.logical_and.reduceat(near, starts)
            at = at[~settled[np.searchsorted(starts, at, side="right") - 1]]
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
    return near


def crowded_keys(prints: DataFrame) -> DataFrame:
    """Rows ``(key, fp, hub)`` of the keys that several near fingerprints share; hub is the smallest of them.

    A key is two blocks, and its fingerprints are dealt by the first of them: four copies of
    each instead of one for every key, and what meets by chance only is never written.
    """
    first = F.posexplode(F.array(*[_block("fp", i) for i in range(len(BLOCKS) - 1)])).alias("at", "block")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[frame.column(c).to_numpy(zero_copy_only=False) for c in ("at", "fp")] for frame in frames]
        if not parts:
            return
        at, fp = (np.concatenate(column) for column in zip(*parts, strict=True))
        for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
            value = fp[at == i]
            bits = value.view(np.uint64)
            left, right = (bits >> np.uint64(x) & np.uint64((1 << width) - 1) for x, width in (BLOCKS[i], BLOCKS[j]))
            key = np.uint64(n << 26) | left << np.uint64(13) | right
            order = np.lexsort((value, key))
            key, value = key[order], value[order]
            near = near_some(key, value.view(np.uint64))
            key, value = key[near].view(np.int64), value[near]
            starts = run_starts(key)
            hub = np.repeat(value[starts], np.diff(np.append(starts, len(key))))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(hub)], names=["key", "fp", "hub"])

    dealt = prints.select("fp", first).repartition("at", "block").select("at", "fp")
    return dealt.mapInArrow(run, "key long, fp long, hub long")


def hub_fingerprints(crowded: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``: the hub of a key and each fingerprint near it."""
    near = F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= checked_bits(max_bits)
    return crowded.where((F.col("hub") < F.col("fp")) & near).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def near_fingerprints(crowded: DataFrame, labelled: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of near fingerprints whose labels ``(fp, label)`` differ.

    A null label differs from every other; a fingerprint without a label has one of its own.
    """
    own = F.when(F.col("known"), F.col("label")).otherwise(F.col("fp"))
    keyed = crowded.select("key", "fp").join(labelled.withColumn("known", F.lit(True)), "fp", "left")
    keyed = keyed.select("key", "fp", own.alias("label"))
    left = keyed.select("key", F.col("fp").alias("a"), F.col("label").alias("la"))
    right = keyed.select(F.col("key").alias("same"), F.col("fp").alias("b"), F.col("label").alias("lb"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= checked_bits(max_bits)
    apart = F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") != F.col("lb"))
    met = (F.col("key") == F.col("same")) & (F.col("a") < F.col("b"))
    return left.join(right, met & near & apart).select("a", "b").distinct()


def allowed(left: int, right: int, similarity: float) -> int:
    """The largest edit distance of lines of these lengths that is similar enough."""
    return int((1 - similarity) * max(left, right) + 1e-9)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end, which leaves the distance as it is."""

    def shared(same) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(low, middle) else (low, middle - 1)
        return low

    n = shared(lambda i, j: a[i:j] == b[i:j])
    a, b = a[n:], b[n:]
    n = shared(lambda i, j: a[len(a) - j : len(a) - i] == b[len(b) - j : len(b) - i])
    return a[: len(a) - n], b[: len(b) - n]


def reach(a: str, b: str, i: int, j: int) -> int:
    """How far ``a`` from i and ``b`` from j agree."""
    least = min(len(a) - i, len(b) - j)
    step = 8
    n = 0
    while n < least and a[i + n : i + min(n + step, least)] == b[j + n : j + min(n + step, least)]:
        n = min(n + step, least)
        step *= 2
    low, high = n, min(n + step, least)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[i + low : i + middle] == b[j + low : j + middle] else (low, middle - 1)
    return low


def few_edits(a: str, b: str, most: int) -> int | None:
    """The edit distance when it is ``most`` or less, by furthest-reaching diagonals: time grows with its square."""
    goal = len(b) - len(a)
    ends: dict[int, int] = {}
    for edits in range(most + 1):
        after = {}
        for diagonal in range(-edits, edits + 1):
            if edits:
                i = max(
                    ends.get(diagonal, -2) + 1,  # another character
                    ends.get(diagonal + 1, -2) + 1,  # one of a is dropped
                    ends.get(diagonal - 1, -2),  # one of b is added
                )
            else:
                i = 0
            if i < 0 or i > len(a) or not 0 <= i + diagonal <= len(b):
                i = min(i, len(a), len(b) - diagonal)
                if i < 0 or i + diagonal < 0:
                    continue
            i += reach(a, b, i, i + diagonal)
            after[diagonal] = i
        if after.get(goal, -1) >= len(a):
            return edits
        ends = after
    return None


def edit_distance(a: str, b: str) -> int:
    """Edit distance by a column of bit vectors, one step a character of ``b``."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        match = places.get(c, 0)
        across = match | down
        along = (((match & up) + up) ^ up) | match
        rise, fall = down | (full & ~(along | up)), up & along
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~(across | rise)), rise & across
    return score


def similar(a: str, b: str, similarity: float) -> bool:
    """Edit similarity, 1 - distance / longer length, of ``similarity`` or more."""
    most = allowed(len(a), len(b), similarity)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    # up to this distance, diagonals are quicker than a pass of bit vectors over the lengths left
    few = int((len(b) * (0.7 + len(a) / 8000)) ** 0.5)
    if few_edits(a, b, min(most, few)) is not None:
        return True
    return most > few and edit_distance(a, b) <= most


#: Pairs gathered before they are compared, and characters of them.
GATHERED_PAIRS, GATHERED_CHARS = 20_000, 8 << 20
#: Pairs are compared at once in groups of so many characters, if the shorter line has no more than the second.
GROUP_CHARS, LONG = 1 << 20, 1 << 14


def codes(texts: list[str], width: int) -> np.ndarray:
    """One row a text: its code points plus one, then zeros."""
    size = np.array([len(x) for x in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    top = points.max(initial=0)
    out = np.zeros((len(texts), width), dtype=np.uint8 if top < 255 else np.uint16 if top < 65535 else np.uint32)
    out[np.arange(width) < size[:, None]] = points + np.uint32(1)
    return out


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of many pairs at once: for each pair the bit vectors of ``edit_distance``, 64 bits a word.

    ``right`` is sorted by length, longest first; nothing is empty.
    """
    one, end = np.uint64(1), np.uint64(63)
    size = np.array([len(x) for x in left])
    words = int(size.max() + 63) // 64
    score, last = size.copy(), (size - 1) // 64
    ending = [last == w for w in range(words)]
    top = [np.where(e, (size - 1) % 64, 63).astype(np.uint64) if e.any() else None for e in ending]
    places = codes(left, 64 * words)
    columns = codes(right, len(right[0]))
    kind = np.promote_types(places.dtype, columns.dtype)
    places, columns = places.astype(kind, copy=False), np.ascontiguousarray(columns.astype(kind, copy=False).T)
    going = (columns != 0).sum(axis=1)
    up = np.full((words, len(left)), ~np.uint64(0))
    down = np.zeros_like(up)
    for column, n in zip(columns, going.tolist(), strict=True):
        match = np.packbits(places[:n] == column[:n, None], axis=1, bitorder="little").view(np.uint64)
        more, less = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for w in range(words):
            u, d, m = up[w, :n], down[w, :n], match[:, w]
            across = m | d
            m = m | less
            along = (((m & u) + u) ^ u) | m
            rise, fall = d | ~(along | u), u & along
            plus, minus = rise >> end, fall >> end
            if top[w] is not None:
                at, ends = top[w][:n], ending[w][:n]
                score[:n] += ends * ((rise >> at & one).view(np.int64) - (fall >> at & one).view(np.int64))
            rise, fall = rise << one | more, fall << one | less
            up[w, :n] = fall | ~(across | rise)
            down[w, :n] = rise & across
            more, less = plus, minus
    return score


def similar_pairs(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """``similar`` of each pair; lines that are not very long are compared many at once."""
    fine = np.zeros(len(left), dtype=bool)
    groups: dict[int, list[tuple[int, int, str, str]]] = {}
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        most = allowed(len(a), len(b), similarity)
        if abs(len(a) - len(b)) > most:
            continue
        x, y = sorted(trimmed(a, b), key=len)
        if len(y) <= most:
            fine[i] = True
        elif not x or len(x) > LONG:
            fine[i] = bool(x) and similar(a, b, similarity)
        else:
            # long lines with few edits are quicker by diagonals
            words = (len(x) + 63) // 64
            if words >= 16 and few_edits(x, y, min(most, words)) is not None:
                fine[i] = True
            else:
                step = 1 << max(words.bit_length() - 3, 0)  # a quarter of a power of two
                groups.setdefault(-(-words // step) * step, []).append((i, most, x, y))
    for words, group in groups.items():
        group.sort(key=lambda p: -len(p[3]))
        many = max(GROUP_CHARS // (64 * words), 16 * words)
        for at in range(0, len(group), many):
            index, most, x, y = zip(*group[at : at + many], strict=True)
            if len(index) < 8 * words:  # few pairs are quicker one by one
                fine[list(index)] = [edit_distance(a, b) <= m for a, b, m in zip(x, y, most, strict=True)]
            else:
                fine[list(index)] = distances(list(x), list(y)) <= np.array(most)
    return fine


#: Bits of the filter on row keys: two megabytes, whatever the number of rows.
FILTER_BITS = 1 << 24
#: Lines of a row stand so far apart in the filter.
LINE_STEP = 40503


def row_filter(rows: DataFrame) -> np.ndarray:
    """A bitmap of ``row_key`` modulo its size; it may let others pass but stops none of ``rows``."""
    place = F.pmod("row_key", F.lit(FILTER_BITS)) + 1  # these functions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in parts.collect():
        bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits


def line_place(row: Column, line: Column) -> Column:
    """A value for each line of a row, to stand beside ``row_key`` in the filter."""
    return row.bitwiseXOR(line.cast("long") * LINE_STEP)


def line_texts(docs: DataFrame, first: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``(h, norm)`` of the lines whose first occurrence is in ``first(h, row_key, line)``.

    The documents are read again; a bitmap of bounded size keeps most documents and lines
    that are not wanted out of the join that decides.
    """
    place = line_place(F.col("row_key"), F.col("line"))
    bits = row_filter(first.select("row_key").union(first.select(place)))

    def wanted(places: np.ndarray) -> np.ndarray:
        places = places % FILTER_BITS
        return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = frame.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64)
            held = wanted(rows)
            owner, place, lines = [], [], []
            for row, value in zip(rows[held].tolist(), frame.column("t").filter(pa.array(held)).to_pylist(), strict=True):
                for j, line in enumerate(literal(value)):
                    if line:
                        owner.append(row)
                        place.append(j)
                        lines.append(line)
            owner, place = np.array(owner, dtype=np.int64), np.array(place, dtype=np.int64)
            found = np.flatnonzero(wanted(owner ^ place * LINE_STEP))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[found]),
                    pa.array(place[found].astype(np.int32)),
                    pa.array([lines[i] for i in found.tolist()], pa.binary()).cast(pa.string()),
                ],
                names=["row_key", "line", "norm"],
            )

    source = docs.select(row_key(key, text).alias("row_key"), F.col(text).alias("t"))
    lines = source.mapInArrow(run, "row_key long, line int, norm string")
    return lines.join(first, ["row_key", "line"]).select("h", "norm").dropDuplicates(["h"])


def line_components(
    docs: DataFrame, distinct: DataFrame, max_bits: int, similarity: float, key: str, text: str
) -> DataFrame:
    """Rows ``(node, component, first)`` of the lines that similar lines connect.

    Only lines with another line's fingerprint, or one near it, take part in what follows.
    First, fingerprints are compared with the smallest one of each key, by one line of each,
    and the lines of a fingerprint with the first of them.  Then all near pairs that these
    links leave in different groups are compared; a link inside a group changes nothing.
    So many variants of one line give a few comparisons each, not one for every pair.
    """
    longer = F.floor(F.greatest("na", "nb") * F.lit(1 - similarity) + F.lit(1e-9))
    lengths = F.abs(F.col("na") - F.col("nb")) <= longer

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(c + name) for c in ("h", "fp", "n", "group") if c in rows.columns])

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))

    def gathered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, pairs, chars = [], 0, 0
        for frame in frames:
            held, pairs, chars = [*held, frame], pairs + frame.num_rows, chars + frame.nbytes
            if pairs >= GATHERED_PAIRS or chars >= GATHERED_CHARS:
                yield pa.Table.from_batches(held)
                held, pairs, chars = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def verify(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in gathered(frames):
            left, right = frame.column("x").to_pylist(), frame.column("y").to_pylist()
            fine = pa.array(similar_pairs(left, right, similarity))
            yield from frame.select(["a", "b"]).filter(fine).to_batches()

    def verified(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("h").alias("a"), F.col("norm").alias("x")), "a")
        sides = sides.join(texts.select(F.col("h").alias("b"), F.col("norm").alias("y")), "b")
        return stored(sides.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"), "links")

    prints = stored(distinct.groupBy("fp").agg(F.count("*").alias("lines")), "prints")
    crowded = stored(crowded_keys(prints), "crowded")
    several = prints.where("lines > 1").select(F.col("fp").alias("f"))
    wanted = crowded.select(F.col("fp").alias("f")).union(several).distinct()
    distinct = stored(distinct.join(wanted, F.col("fp") == F.col("f"), "left_semi"), "near")
    texts = line_texts(docs, distinct.select("h", "first.row_key", "first.line"), key, text)
    texts = stored(texts, "texts")
    prints = distinct.groupBy("fp").agg(F.min("h").alias("h"), F.min_by("n", "h").alias("n"), F.count("*").alias("lines"))
    prints = stored(prints, "prints")
    hubs = hub_fingerprints(crowded, max_bits).join(side(prints, "a"), F.col("a") == F.col("fpa"))
    hubs = hubs.drop("a").join(side(prints, "b"), (F.col("b") == F.col("fpb")) & lengths)
    shared = side(prints.where("lines > 1"), "a")
    own = side(distinct, "b").join(shared, (F.col("fpb") == F.col("fpa")) & (F.col("ha") != F.col("hb")) & lengths)
    stars = stored(ordered(hubs).union(ordered(own)).distinct(), "stars")
    links = verified(stars)

    group = components(links)
    grouped = distinct.join(group, F.col("h") == F.col("node"), "left").select(
        "h", "fp", "n", F.coalesce("component", "h").alias("group")
    )
    grouped = stored(grouped, "grouped")
    label = F.when(F.min("group") == F.max("group"), F.xxhash64(F.min("group")))
    linked = grouped.join(group.select("node"), F.col("h") == F.col("node"), "left_semi").select(F.col("fp").alias("f"))
    several = prints.where("lines > 1").select(F.col("fp").alias("f"))
    some = grouped.join(linked.union(several).distinct(), F.col("fp") == F.col("f"), "left_semi")
    labelled = stored(some.groupBy("fp").agg(label.alias("label")), "labelled")
    apart = F.col("groupa") != F.col("groupb")
    across = near_fingerprints(crowded, labelled, max_bits).join(side(grouped, "a"), F.col("a") == F.col("fpa"))
    across = across.drop("a").join(side(grouped, "b"), (F.col("b") == F.col("fpb")) & lengths & apart)
    divided = labelled.where("label is null").select(F.col("fp").alias("f"))
    divided = grouped.join(divided, F.col("fp") == F.col("f"), "left_semi")
    same = (F.col("fpa") == F.col("fpb")) & (F.col("ha") < F.col("hb"))
    within = side(divided, "a").join(side(divided, "b"), same & lengths & apart)
    rest = ordered(across).union(ordered(within)).distinct().join(stars, ["a", "b"], "left_anti")
    member = components(links.union(verified(stored(rest, "rest"))))
    return member.join(distinct.select("h", "first"), F.col("node") == F.col("h")).select("node", "component", "first")


def dropped_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_bits: int = MAX_BITS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Rows ``(k, row_key, lines)``: the line numbers, from 0, that each document loses.

    The first occurrence of a group has the smallest key (null first), row hash and line
    number.  Rows that repeat in key and text are one document: all keep what one keeps.
    Null and empty texts lose nothing; empty tables give no rows; other columns are not read.
    """
    lines = stored(line_table(docs, key, text), "lines")
    distinct = lines.groupBy("h", "fp", "n").agg(
        F.min(F.struct("k", "row_key", "line")).alias("first"), F.count("*").alias("times")
    )
    distinct = stored(distinct, "distinct")
    member = stored(line_components(docs, distinct, max_bits, similarity, key, text), "member")
    least = member.groupBy(F.col("component").alias("root")).agg(F.min("first").alias("least"))
    linked = member.join(least, F.col("component") == F.col("root")).select("node", "least")
    alone = distinct.where("times > 1").join(member, F.col("h") == F.col("node"), "left_anti").select("h", distinct["first"])
    verdict = stored(linked.union(alone).toDF("vh", "keep"), "verdict")
    occurrence = lines.select("k", "row_key", "line", "h").join(verdict, F.col("h") == F.col("vh"))
    gone = occurrence.where(~F.struct("k", "row_key", "line").eqNullSafe(F.col("keep")))
    return gone.groupBy("k", "row_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def line_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows ``(key, n_lines, n_dropped, dropped)`` for every row of ``docs``; ``dropped`` lists line numbers."""
    gone = stored(dropped_lines(docs, key, text, **options), "gone").select(F.col("row_key").alias("gone_key"), "lines")
    value = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(key).alias("k"),
        row_key(key, text).alias("row_key"),
        (F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
    )
    return counted.join(gone, F.col("row_key") == F.col("gone_key"), "left").select(
        F.col("k").alias(key),
        "n_lines",
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_dropped"),
        F.coalesce(F.array_join("lines", ","), F.lit("")).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; rows and other columns stay."""
    docs, restore = shelter(docs)
    gone = stored(dropped_lines(docs, key, text, **options), "gone")
    gone = gone.select(F.col("row_key").alias("__gone_key"), F.col("lines").alias("__gone"))
    held = docs.withColumn("__row_key", row_key(key, text)).join(gone, F.col("__row_key") == F.col("__gone_key"), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("__gone", i))
    return restore(
        held.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(
            *docs.columns
        )
    )
