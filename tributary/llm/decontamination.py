"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Numbers, names and units of a text become typed slots; the hashes of its word windows, with
only the type of a slot counted, are joined with the windows of the benchmark's items.  A
document holds an item when ``similarity`` of the item's windows are met, either with the
item's own slot values or on alignments whose slots are consistent: wherever the item repeats
a slot's value, the document repeats what it put there.  So a question is found as it stands and with other numbers or names in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tributary.llm.common import shelter, stored

WINDOW, SIMILARITY = 5, 0.8
#: Windows need so many words that are not slots.  An item without such a window is met only as it stands.
LITERALS = 2
#: Up to so many benchmark windows, of a few dozen bytes each, are broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 200_000

#: First characters of a slot token: a name, a number, a unit.
NAME, NUMBER, UNIT, ABOVE = "\u0001", "\u0002", "\u0003", "\u0004"
#: A capitalised word that does not begin a sentence or a line.
NAMES = r"\p{Lu}(?<=[^\s.!?:] \p{Lu})\p{Ll}[\p{L}']*"
NUMBERS = r"[0-9][0-9.,]*"
UNITS = (
    r"(?<=[0-9][.,]? ?)(km/h|km|cm|mm|miles?|feet|foot|inches|kg|mg|lbs?|pounds?|ounces?|liters?|litres?|ml|"
    r"seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|m|g|l|s|h|%)(?![\p{L}])"
)
PUNCTUATION = "[^\\p{L}\\p{N}\\s\u0001-\u0003]+"


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; a slot is its type character and its value."""
    value = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "   ")
    value = F.regexp_replace(value, NAMES, NAME + "$0")
    value = F.regexp_replace(value, UNITS, UNIT + "$1")
    value = F.regexp_replace(value, NUMBERS, NUMBER + "$0")
    value = F.regexp_replace(F.lower(value), PUNCTUATION, "")
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def is_slot(token: Column) -> Column:
    return (token < ABOVE) & (token != "")


def typed(token: Column) -> Column:
    return F.xxhash64(F.when(token < ABOVE, F.left(token, F.lit(1))).otherwise(token))


def window_hashes(hashed: Column, size: int) -> Column:
    """Hash of each window of ``size`` words, given the hash of each; empty when there are fewer.

    ``hashed`` has to be a column of its own: inside the lambda an expression would be
    evaluated for every window.
    """
    if size == 1:
        return F.transform(hashed, lambda h: F.xxhash64(F.lit(1), h))
    starts = F.when(F.size(hashed) >= size, F.sequence(F.lit(1), F.size(hashed) - (size - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(F.lit(size), *[F.element_at(hashed, i + k) for k in range(size)]))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows ``(item, at, size, window, words, total, exact)`` of the benchmark's windows.

    Items shorter than a window are one window of their own length; empty items have none.
    Repeated items count once.
    """
    words = (
        benchmark.select(F.col(item).alias("item"), tokens(F.col(text)).alias("w"))
        .where("w[0] <> ''")
        .distinct()
        .withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
        .withColumn("h", F.transform("w", typed))
    )
    by_size = F.coalesce(*[F.when(F.col("size") == n, window_hashes(F.col("h"), n)) for n in range(1, WINDOW + 1)])
    windows = words.select("item", "w", "size", F.posexplode(by_size).alias("at", "window")).select(
        "item", "at", "size", "window", F.slice("w", F.col("at") + 1, F.col("size")).alias("words")
    )
    literal = F.size(F.filter("words", lambda t: ~is_slot(t))) >= F.least(F.col("size"), F.lit(LITERALS))
    kept = windows.withColumn("literal", literal)
    some = kept.groupBy("item").agg(
        F.count_if("literal").alias("literals"), F.count("*").alias("windows")
    )
    return (
        kept.join(some, "item")
        .where("literal or literals = 0")
        .select(
            "item", "at", "size", "window", "words",
            F.when(F.col("literals") > 0, F.col("literals")).otherwise(F.col("windows")).alias("total"),
            (F.col("literals") == 0).alias("exact"),
        )
    )


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(key, text)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Rows ``(key, item, row_key, matched, total, changed)``: the items each document holds.

    ``matched`` of the item's ``total`` windows are met as they stand or consistently;
    ``changed`` tells whether a slot holds another value than in the item.  Null and empty texts hold nothing;
    null keys stay null; repeated rows are told once; empty tables give no rows; other
    columns are not read.  Documents are read whole.
    """
    items = stored(item_windows(benchmark, item, item_text), "items")
    found = items.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(found["sizes"]) or [WINDOW]
    windows = F.concat(*[window_hashes(F.col("h"), n) for n in sizes])
    # where the windows of a size begin within the concatenated array
    first, offset = [], F.lit(0)
    for n in sizes:
        first.append(F.when(F.col("size") == n, offset))
        offset = offset + F.greatest(F.size("w") - (n - 1), F.lit(0))
    exploded = (
        docs.select(F.col(key).alias("k"), row_key(key, text).alias("row_key"), tokens(F.col(text)).alias("w"))
        .withColumn("h", F.transform("w", typed))
        .select("k", "row_key", "w", F.posexplode(windows).alias("place", "met"))
    )
    side = items.select(
        "item", F.col("at").alias("item_at"), "size", "window", F.col("words").alias("item_words"), "total", "exact"
    )
    side = F.broadcast(side) if found["n"] <= BROADCAST_WINDOWS else side
    hits = exploded.join(side, F.col("met") == F.col("window")).withColumn("at", F.col("place") - F.coalesce(*first))
    hits = hits.select(
        "k", "row_key", "item", "item_at", "total", "exact", (F.col("at") - F.col("item_at")).alias("shift"),
        F.filter(
            F.arrays_zip(F.col("item_words").alias("i"), F.slice("w", F.col("at") + 1, F.col("size")).alias("d")),
            lambda p: is_slot(p["i"]),
        ).alias("slots"),
    )
    hits = hits.withColumn("same", F.forall("slots", lambda p: p["i"] == p["d"]))
    hits = stored(hits.where("not exact or same").drop("exact"), "hits")
    pair = ["row_key", "item"]
    # items met often enough at all
    likely = hits.groupBy(*pair, "item_at").agg(F.first("total").alias("total")).groupBy(*pair)
    likely = likely.agg(F.count("*").alias("n"), F.first("total").alias("total"))
    likely = likely.where(F.col("n") >= F.ceil(F.col("total") * similarity)).select(*pair)
    held = stored(hits.join(likely, pair, "left_semi"), "likely")
    # alignments on which one value of the item meets two of the document: only windows with the item's values count there
    slots = held.select(*pair, "shift", F.explode("slots").alias("s")).select(*pair, "shift", "s.i", "s.d").distinct()
    per_value = slots.groupBy(*pair, "shift", "i").agg(F.count("*").alias("values"), F.max(F.col("i") != F.col("d")).alias("c"))
    per_shift = per_value.groupBy(*pair, "shift").agg(F.max("values").alias("values"), F.max("c").alias("c"))
    aligned = held.join(per_shift, [*pair, "shift"], "left").where("same or coalesce(values, 1) = 1")
    met = aligned.groupBy("k", *pair, "item_at").agg(
        F.first("total").alias("total"), F.min(F.coalesce("c", F.lit(False))).alias("c")
    )
    return (
        met.groupBy("k", *pair)
        .agg(F.count("*").alias("matched"), F.first("total").alias("total"), F.max("c").alias("changed"))
        .where(F.col("matched") >= F.ceil(F.col("total") * similarity))
        .select(F.col("k").alias(key), F.col("item").alias(item), "row_key", "matched", "total", "changed")
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``."""
    docs, restore = shelter(docs)
    found = stored(contaminated(docs, benchmark, key, text, **options).select(F.col("row_key").alias("__held")), "held")
    return restore(docs.join(found.distinct(), row_key(key, text) == F.col("__held"), "left_anti"))
