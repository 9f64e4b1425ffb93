"""Mixing sources to target weights by temperature.

Each source's token share p is raised to an exponent t in [0, 1] and normalised: 1 keeps the natural mix, 0
makes all sources equal. Entropy falls and repetition falls as t rises, so bisection finds the largest t whose
entropy reaches the target, then raises it as far as the repetition limit demands. The target closes a stated part of the gap between the
natural entropy and that of equal sources, so it moves every mix that is not level already. A source's weight times
the budget is its token budget: whole passes over its documents, then part of one more. ``least_repeats`` raises the budget until every
source is drawn so many times.

Every pass visits the source's blocks (hash buckets of documents) in a pseudo-random order of its own; ``place`` is the block's
place in it, from 0. The last pass takes whole blocks in that order and, of the block in which the budget ends, documents in
another pseudo-random order. Tokens are counted once: source, hash and count of each row, with the columns to be kept, are written to the shared
folder. :func:`mixed` answers from these; :func:`drawn` reads its input again for all columns and joins the decisions on blocks, so texts
are neither stored nor shuffled. Places and running sums over a source's blocks, and over the documents of its last block, are made in
two levels (ranges of the order, then rows inside a range), so no window holds all blocks of a source or all documents of a block; the number of blocks grows with the source's tokens and rows. Driver data: one row per source (``most_sources`` at most).

Defined results: a null source is a source of its own; null and empty texts have no tokens and come
with their block; a source without tokens gets no weight and no rows; repeated rows are drawn each and share a block, and the cut takes all or
none of them; null keys are keys; an empty table gives an empty result; input columns named n_tokens, pass_no, block or place are replaced by
:func:`mixed` and kept by :func:`drawn`, others may have any name and are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, apart, column, others, persisted
from .token_counts import token_counter

BLOCK_TOKENS, BLOCK_ROWS, FEWEST, RANGE_BITS, DOCUMENT_BITS = 1 << 20, 1 << 16, 16, 12, 6
BROADCAST_ROWS = 200_000
CLOSING = 0.9  #: part of the gap between natural and greatest entropy that is closed


def words_of(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(column(text), F.lit("")), SPACE_CLASS + "+"), "")).cast("long")


def weights_at(exponent: float, tokens: list[int]) -> list[float]:
    total = sum(tokens)
    raised = [(n / total) ** exponent if n else 0.0 for n in tokens]
    return [x / sum(raised) for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repetition(weights: list[float], tokens: list[int], budget: float) -> float:
    return max((w * budget / n for w, n in zip(weights, tokens, strict=True) if n), default=0.0)


def raised(weights: list[float], tokens: list[int], budget: float, least_repeats: float) -> float:
    """The budget, or what draws every source ``least_repeats`` times."""
    return max(budget, least_repeats * max((n / w for w, n in zip(weights, tokens, strict=True) if n), default=0.0))


def exponent_for(tokens: list[int], budget: float, target_entropy: float, most_repeats: float, least_repeats: float = 0.0) -> float:
    """The largest exponent with at least the entropy, raised until no source repeats more often than allowed."""

    def largest(holds) -> float:
        low, high = 0.0, 1.0
        if holds(1.0):
            return 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    def allowed(t: float) -> bool:
        weights = weights_at(t, tokens)
        return repetition(weights, tokens, raised(weights, tokens, budget, least_repeats)) <= most_repeats * (1 + 1e-12)

    chosen = largest(lambda t: entropy(weights_at(t, tokens)) >= target_entropy)
    if not allowed(chosen):
        if not allowed(1.0):
            raise ValueError("the budget exceeds the corpus times the repetition limit")
        low, high = chosen, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if allowed(middle) else (middle, high)
        chosen = high
    return chosen


@dataclass(frozen=True)
class Plan:
    """Per source: number of blocks, whole passes, and tokens left for the last pass."""

    source: str
    blocks: int
    passes: int
    left: int


def target_of(sizes: list[int], entropy_share: float, closing: float) -> float:
    """The entropy to reach: a share of the greatest one, and a part of the way from the natural one to it."""
    greatest, natural = math.log(max(sum(1 for n in sizes if n), 1)), entropy(weights_at(1.0, sizes))
    return max(entropy_share * greatest, natural + closing * max(greatest - natural, 0.0))


def planned(
    tokens: dict[str, int], budget: float | None, entropy_share: float, most_repeats: float, rows: dict[str, int] | None = None, closing: float = CLOSING, least_repeats: float = 0.0
) -> list[Plan]:
    names = sorted(tokens)
    sizes = [tokens[s] for s in names]
    if not sum(sizes):
        return []
    budget = float(sum(sizes)) if budget is None else float(budget)
    weights = weights_at(exponent_for(sizes, budget, target_of(sizes, entropy_share, closing), most_repeats, least_repeats), sizes)
    budget = raised(weights, sizes, budget, least_repeats)
    plans = []
    for name, n, weight in zip(names, sizes, weights, strict=True):
        if n:
            due = max(round(weight * budget), math.ceil(least_repeats * n))
            parts = max(n / BLOCK_TOKENS, (rows or {}).get(name, 0) / BLOCK_ROWS, FEWEST)
            plans.append(Plan(name, 1 << math.ceil(math.log2(parts)), due // n, due % n))
    return plans


def permuted(blocks: DataFrame, seed: int) -> DataFrame:
    """(source, blocks, passes, left) rows as (source, pass_no, block, place, turn): each pass's permutation of the source's blocks."""
    passes = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass_no")).where("pass_no < passes OR left > 0")
    return passes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).withColumn("turn", F.xxhash64(F.lit(seed), "source", "pass_no", "block"))


def placed(rows: DataFrame, by: list[str], turn: str, size: str, ties: list[Column], bits: int, own: str = "_") -> DataFrame:
    """``rows`` plus ``place`` and ``done`` (behind the prefix ``own``): of the rows of one group, how many come before by ``turn``, and
    the size of these and the row itself.

    Two levels: rows inside a range of turns, and 2^bits ranges; no window holds more than one of the two.
    """
    place, done, part = own + "place", own + "done", own + "range"
    ranged = rows.withColumn(part, F.shiftrightunsigned(turn, 64 - bits))
    inside = Window.partitionBy(*by, part).orderBy(turn, *ties)
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, part).agg(F.count(F.lit(1)).alias(own + "n"), F.sum(size).alias(own + "s"))
    shifts = sums.select(*by, part, *(F.coalesce(F.sum(own + x).over(before), F.lit(0)).alias(own + x) for x in "ns"))
    numbered = ranged.withColumn(place, F.row_number().over(inside)).withColumn(done, F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.join(shifts, [*by, part]).select(*map(column, rows.columns), (F.col(own + "n") + F.col(place) - 1).alias(place), (F.col(own + "s") + F.col(done)).alias(done))


@dataclass(frozen=True)
class Draw:
    """What is drawn of counted rows: ``blocks`` (group, blocks) of each source, ``chosen`` blocks of each pass (group, block, pass_no, place,
    all, room), and of those that are not drawn whole the rows ``cut`` (group, block, pass_no, place, hash)."""

    blocks: DataFrame
    chosen: DataFrame
    cut: DataFrame


def _named(docs: DataFrame, source: str, key: str, text: str, seed: int) -> tuple[Column, Column]:
    """The name of a row's source, and the hash that deals it to a block."""
    return F.coalesce(F.concat(F.lit("="), column(source).cast("string")), F.lit("null")), F.xxhash64(F.lit(seed), column(key), column(text))


def decided(keyed: DataFrame, group: str, hashed: str, tokens: str, budget: float | None, entropy_share: float, most_repeats: float, seed: int, most_sources: int, closing: float, least_repeats: float) -> Draw:
    """The draw for counted rows (group, hash, tokens), columns of these names."""
    spark = keyed.sparkSession
    keyed = keyed.select(column(group).alias("group"), column(hashed).alias("hash"), column(tokens).alias("size"))
    totals = keyed.groupBy("group").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    plans = planned({r["group"]: int(r["n"] or 0) for r in totals}, budget, entropy_share, most_repeats, {r["group"]: r["rows"] for r in totals}, closing, least_repeats)
    # one row per source, at most most_sources of them
    table = F.broadcast(spark.createDataFrame([(p.source, p.blocks, p.passes, p.left) for p in plans], "source string, blocks long, passes int, left long"))
    dealt = keyed.join(table.select(F.col("source").alias("group"), "blocks"), "group").withColumn("block", F.pmod("hash", "blocks"))

    sizes = dealt.groupBy(F.col("group").alias("source"), "block").agg(F.sum("size").alias("size"))
    order = permuted(table, seed).join(sizes, ["source", "block"])  # blocks without rows have nothing to give
    room = F.col("left") - F.col("done") + F.col("size")
    order = placed(order, ["source", "pass_no"], "turn", "size", [F.col("block")], RANGE_BITS, "")
    chosen = order.withColumn("room", F.when(F.col("pass_no") < F.col("passes"), F.col("size")).otherwise(room)).where((F.col("pass_no") < F.col("passes")) | (F.col("room") > 0))
    chosen = persisted(chosen.select(F.col("source").alias("group"), "block", "pass_no", "place", (F.col("size") <= F.col("room")).alias("all"), "room"))
    if sum(p.blocks * (p.passes + 1) for p in plans) <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)

    # one block of each source at most; rows of one hash are counted together
    partly = F.broadcast(chosen.where("NOT all").select("group", "block", "pass_no", F.col("place").alias("at"), "room"))
    cut = dealt.join(partly, ["group", "block"]).groupBy("group", "block", "pass_no", "at", "room", "hash").agg(F.sum("size").alias("size"))
    cut = placed(cut.withColumn("turn", F.xxhash64(F.lit(seed), "group", "pass_no", "hash")), ["group"], "turn", "size", [F.col("hash")], DOCUMENT_BITS, "_")
    cut = cut.where("_done <= room").select("group", "block", "pass_no", F.col("at").alias("place"), "hash")
    return Draw(table.select(F.col("source").alias("group"), "blocks"), chosen, cut)


def taken(rows: DataFrame, draw: Draw, group: str, hashed: str, own: str, names: list[Column]) -> DataFrame:
    """``rows`` as often as the draw takes them: ``names`` plus ``pass_no``, ``block`` and ``place``, those with the prefix ``own``."""
    block, results = own + "block", [*names, *(F.col(own + x) for x in ("pass_no", "block", "place"))]
    dealt = rows.join(draw.blocks.toDF(group, own + "blocks"), group).withColumn(block, F.pmod(hashed, own + "blocks"))
    chosen = draw.chosen.select(F.col("group").alias(group), F.col("block").alias(block), F.col("pass_no").alias(own + "pass_no"), F.col("place").alias(own + "place"), F.col("all").alias(own + "all"))
    whole = dealt.join(chosen.where(f"{own}all").drop(own + "all"), [group, block]).select(*results)
    partly = F.broadcast(draw.chosen.where("NOT all").select(F.col("group").alias(group), F.col("block").alias(block)))  # one block of each source
    cut = draw.cut.select(F.col("group").alias(group), F.col("block").alias(block), F.col("hash").alias(hashed), F.col("pass_no").alias(own + "pass_no"), F.col("place").alias(own + "place"))
    return whole.unionByName(dealt.join(partly, [group, block], "left_semi").join(cut, [group, block, hashed]).select(*results))


def mixed(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", tokens: Column | None = None, budget: float | None = None, entropy_share: float = 0.0,
    most_repeats: float = 4.0, seed: int = 7, most_sources: int = 100_000, closing: float = CLOSING, least_repeats: float = 0.0, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` drawn to the mixed weights: the columns ``keep`` (default: all), ``n_tokens``, ``pass_no``, ``block`` and ``place``.

    ``tokens`` counts a row's tokens (default: words between white space); ``budget`` is the number of tokens in all (default: as many
    as there are).
    """
    own = apart(docs)
    kept = docs if keep is None else docs.select(*map(column, keep))
    names, (name, dealing) = [column(c) for c in others(kept, "n_tokens", "pass_no", "block", "place")], _named(docs, source, key, text, seed)
    group, hashed, counts = own + "group", own + "hash", own + "tokens"
    keyed = persisted(docs.select(*names, name.alias(group), dealing.alias(hashed), (words_of(text) if tokens is None else tokens).alias(counts)))
    draw = decided(keyed, group, hashed, counts, budget, entropy_share, most_repeats, seed, most_sources, closing, least_repeats)
    found = taken(keyed, draw, group, hashed, own, [*names, F.col(counts)])
    return found.select(*names, F.col(counts).alias("n_tokens"), *(F.col(own + x).alias(x) for x in ("pass_no", "block", "place")))


def drawn(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", tokens: Column | None = None, budget: float | None = None, entropy_share: float = 0.0,
    most_repeats: float = 4.0, seed: int = 7, most_sources: int = 100_000, closing: float = CLOSING, least_repeats: float = 0.0,
) -> DataFrame:
    """Rows of ``docs`` as often as :func:`mixed` draws them, with their own columns only. ``docs`` is read twice and must give the same rows."""
    own = apart(docs)
    names, (name, dealing) = [column(c) for c in docs.columns], _named(docs, source, key, text, seed)
    group, hashed, counts = own + "group", own + "hash", own + "tokens"
    keyed = persisted(docs.select(name.alias(group), dealing.alias(hashed), (words_of(text) if tokens is None else tokens).alias(counts)))
    draw = decided(keyed, group, hashed, counts, budget, entropy_share, most_repeats, seed, most_sources, closing, least_repeats)
    return taken(docs.select(*names, name.alias(group), dealing.alias(hashed)), draw, group, hashed, own, names).select(*names)


def op9_mixing(spark, sf_dir):
    """Nine tenths of the way to level sources, in as many tokens as there are: large sources are cut, small ones repeated."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    counts = token_counter(public_tokenizers.path("piece_bpe_32k.model"))
    return mixed(docs, tokens=counts(F.col("text")), keep=("doc_id", "source")).select("doc_id", "source", "n_tokens", "pass_no", "block", "place")
