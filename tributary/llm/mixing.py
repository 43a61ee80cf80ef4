"""Mixing sources to target weights by temperature.

The weight of a source is its token share to the power of an exponent in [0, 1].  The
exponent is bisected to the largest that still meets the target entropy, and raised, if
need be, to the smallest that keeps every source within the repetition limit.  The weights
then become budgets: the smallest total in which every source appears at least once in
whole.  A source repeats its documents in epochs; an epoch is a permutation of blocks of
documents, and the last one stops when the budget is met.

All decisions about a document follow from its own columns and one row of its source, so
mixing takes one pass over the documents and no shuffle of them, whatever a source's share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tributary.llm.common import shelter, stored

#: Tokens of a block, cells in which a source's blocks are summed first, and the seed of all permutations.
BLOCK_TOKENS, CELL_BITS, SEED = 100_000, 8, 17
#: What :func:`mixed` adds to a row.
ADDED = ("mix_epoch", "mix_block", "mix_position", "mix_weight")
#: Exponents tried a round, and rounds: 15 ** 6 steps are finer than 2 ** -23.
TRIED, ROUNDS = 15, 6


def source_name(source: str) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")


def row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.lit(SEED), key, text)


def entropies(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Relative entropy and the largest repetition under each exponent, in one aggregate."""
    columns = []
    for i, a in enumerate(exponents):
        p = F.exp(F.col("ln") * a)
        columns += [F.sum(p).alias(f"z{i}"), F.sum(p * F.col("ln") * a).alias(f"e{i}")]
    row = shares.agg(F.count("*").alias("n"), F.min("ln").alias("least"), F.max("ln").alias("most"), *columns).first()
    out = []
    for i, a in enumerate(exponents):
        z, e = row[f"z{i}"], row[f"e{i}"]
        spread = math.log(z) - e / z
        out.append((spread / math.log(row["n"]) if row["n"] > 1 else 1.0, math.exp(min(700.0, (1 - a) * (row["most"] - row["least"])))))
    return out


def solve_exponent(shares: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """The exponent for ``shares(ln)``, by bisection with several sections a round.

    Entropy falls and repetition falls as the exponent rises.  1 keeps the natural shares.
    """

    def smallest(meets) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / (TRIED + 1) for i in range(TRIED + 2)]
            good = [meets(r) for r in entropies(shares, grid)]
            if good[0]:
                return grid[0]
            at = good.index(True) if True in good else TRIED + 1
            low, high = grid[at - 1], grid[at]
        return high

    exponent = 1.0
    if entropy is not None:  # the largest exponent with enough entropy
        if entropies(shares, [1.0])[0][0] < entropy:
            exponent = smallest(lambda r: r[0] < entropy)
    if repetition is not None:
        exponent = max(exponent, smallest(lambda r: r[1] <= repetition))
    return exponent


def plan(
    docs: DataFrame,
    entropy: float | None = 0.98,
    repetition: float | None = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each source: its tokens, exponent, weight, repetitions and where its last epoch stops.

    Columns ``s, tokens, exponent, weight, repeats, blocks, full, budget, stop_order, stop_block, stop_row``: the
    rows of an epoch are ordered by (block hash, block, row hash); the last epoch holds those
    up to the stop.  A source without tokens has weight 0 and appears once.
    """
    units = stored(
        docs.select(source_name(source).alias("s"), word_count(text).alias("tokens"), row_hash(key, text).alias("row")),
        "units",
    )
    sources = stored(units.groupBy("s").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    if not total["all"]:
        exponent = 1.0
    else:
        shares = sources.where("tokens > 0").select((F.log("tokens") - F.log(F.lit(total["all"]))).alias("ln"))
        exponent = solve_exponent(shares, entropy, repetition)
    repeats = F.pow(F.lit(float(total["most"] or 1)) / F.greatest("tokens", F.lit(1)), F.lit(1 - exponent))
    repeats = F.when(F.col("tokens") > 0, F.round(repeats, 9)).otherwise(1.0)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total["all"] or 1), F.lit(exponent))).otherwise(0.0)
    mass = sources.agg(F.sum(power)).first()[0] or 1.0
    sources = sources.select(
        "s",
        "tokens",
        F.lit(exponent).alias("exponent"),
        F.round(power / mass, 12).alias("weight"),
        repeats.alias("repeats"),
        F.floor(repeats).cast("int").alias("full"),
        F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("blocks"),
        ((repeats - F.floor(repeats)) * F.col("tokens")).alias("budget"),
    )
    sources = stored(sources, "weights")
    dealt = units.join(sources.select("s", "blocks", "full", "budget"), "s").withColumn("block", block_of(F.col("row"), F.col("blocks")))
    dealt = stored(
        dealt.withColumn("order", block_hash(F.col("full"), F.col("s"), F.col("block")))
        .withColumn("cell", F.shiftright("order", 63 - CELL_BITS))
        .select("s", "block", "order", "cell", "row", "tokens", "budget"),
        "dealt",
    )

    def crossing(sums: DataFrame, order: list[str]) -> DataFrame:
        """For each source the part in which its budget is met: ``from`` is the sum before it."""
        before = F.sum("n").over(Window.partitionBy("s").orderBy(*order)) - F.col("n") + F.col("base")
        return sums.withColumn("from", before).where("from < budget and budget <= from + n")

    cells = dealt.groupBy("s", "cell").agg(F.sum("tokens").alias("n"), F.max("budget").alias("budget"))
    cell = crossing(cells.withColumn("base", F.lit(0.0)), ["cell"]).select("s", "cell", F.col("from").alias("base"))
    blocks = dealt.join(cell, ["s", "cell"]).groupBy("s", "order", "block")
    blocks = blocks.agg(F.sum("tokens").alias("n"), F.max("budget").alias("budget"), F.max("base").alias("base"))
    block = stored(
        crossing(blocks, ["order", "block"]).select("s", "order", "block", F.col("from").alias("base")), "stops"
    )
    rows = dealt.join(block, ["s", "order", "block"]).groupBy("s", "order", "block", "row")
    rows = rows.agg(F.sum("tokens").alias("n"), F.max("budget").alias("budget"), F.max("base").alias("base"))
    stop = crossing(rows, ["row"]).select(
        "s", F.col("order").alias("stop_order"), F.col("block").alias("stop_block"), F.col("row").alias("stop_row")
    )
    return stored(sources.join(stop, "s", "left"), "mixture")


def block_of(row: Column, blocks: Column) -> Column:
    return F.pmod(row, blocks).cast("long")


def block_hash(epoch: Column, source: Column, block: Column) -> Column:
    """Where a block comes in the permutation of an epoch: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), epoch.cast("int"), source, block), 1)


def mixed(
    docs: DataFrame, mixture: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``docs`` once for each epoch that holds them, with ``mix_epoch, mix_block, mix_position, mix_weight``.

    ``mix_position`` in [0, 1) orders the mixture: the blocks of all sources are spread evenly
    over it, each source in the order of its permutations.  Every row appears at least once.
    Null sources are one source; null and empty texts have no tokens; rows that repeat in key
    and text are dealt alike; columns of ``docs`` with the names above are replaced.
    """
    docs, restore = shelter(docs)
    plan_ = mixture.select(*[F.col(c).alias(f"__{c}") for c in mixture.columns])
    held = docs.withColumn("__source", source_name(source)).withColumn("__row", row_hash(key, text))
    held = held.join(plan_, F.col("__source") == F.col("__s"))
    held = held.withColumn("mix_block", block_of(F.col("__row"), F.col("__blocks")))
    order = block_hash(F.col("__full"), F.col("__source"), F.col("mix_block"))
    at, stop = (order, F.col("mix_block"), F.col("__row")), ("__stop_order", "__stop_block", "__stop_row")
    last = at[2] <= F.col(stop[2])
    for column, end in ((at[1], stop[1]), (at[0], stop[0])):
        last = (column < F.col(end)) | ((column == F.col(end)) & last)
    copies = F.col("__full") + F.coalesce(last, F.lit(False)).cast("int")
    spread = held.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    begins = block_hash(F.col("mix_epoch"), F.col("__source"), F.col("mix_block")) / F.lit(2.0**63)
    span = F.greatest(F.col("__repeats"), F.col("mix_epoch") + 1)
    return restore(
        spread.withColumn("mix_position", (F.col("mix_epoch") + begins) / span).select(
            *[c for c in docs.columns if c not in ADDED],
            "mix_epoch",
            "mix_block",
            "mix_position",
            F.col("__weight").alias("mix_weight"),
        )
    )
