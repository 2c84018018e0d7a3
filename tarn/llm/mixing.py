"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words.  A source's target is met by
whole passes over it plus a remaining budget, which is fitted on the length
counts alone: an equal share of every length first, then the longest lengths
that still fit, then a bounded-knapsack dynamic programme over what is left.
Within a length, documents are taken in a seeded order.

Only length counts meet in one task, one task a source; targets are found by a
few sums over the sources, however many there are.  Documents are ranked inside
(source, length, slice of the seeded order), with about as many slices as the
square root of all rows, so a length that holds a third of all rows is still
spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._common import RID, WORD_CLASS, carried, numbered
from tarn.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: The dynamic programme covers budgets up to this many words, or twice the longest document that fits; more is taken greedily before.
DP_WORDS = 1 << 16
NO, NAME, LEN, SLICE, ORDER = "__tarn_no", "__tarn_name", "__tarn_len", "__tarn_slice", "__tarn_order"


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: their rank by code point, null last. Sorted by ranges, counted by range; no task meets all of them."""
    ranges = sources.repartitionByRange(NO, NAME).sortWithinPartitions(NO, NAME).withColumn("at", F.monotonically_increasing_id())
    ranges = materialize(ranges, "mix-ranges")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = ranges.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    met = ranges.withColumn("part", part).join(first, "part")
    return met.withColumn("place", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "at")


def fit_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MAX_REPEATS) -> DataFrame:
    """``sources`` (``__tarn_no``, ``__tarn_name``, ``source_size``) with ``target``.

    Targets go by weight and add up to ``share`` of all sizes, none above ``most``
    times its own size; what a source can't use is shared again among the others
    by weight.  A source is stopped where ``most`` times its size is under the
    others' rate times its weight; the rate only rises, so a few rounds of sums
    settle it.
    """
    weight = F.element_at(F.lit(list(map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(_ranked(sources).withColumn("weight", weight).withColumn("top", F.lit(float(most)) * F.col("source_size")), "mix-sources")
    whole = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    rate, stopped = 0.0, -1
    while True:
        over = F.col("top") < F.lit(rate) * F.col("weight")
        seen = rows.agg(F.sum(F.when(over, F.col("top"))).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")).first()
        if seen.n == stopped or not seen.weight:
            break
        rate, stopped = (whole - (seen.used or 0.0)) / seen.weight, seen.n
    return rows.withColumn("target", F.least("top", F.lit(rate) * F.col("weight"))).select(NO, NAME, "source_size", "target")


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be found, never above it.

    ``counts`` holds the documents of each length. Exact up to what the first
    two steps fixed: the dynamic programme reaches every sum that the lengths
    left over can make.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return counts
    if budget <= 0 or not counts:
        return {}
    # leave room for the programme: a spread of lengths stays untaken, and any document that fits is an item
    half = max([DP_WORDS // 2, *(n for n in counts if n <= budget)])
    aim = max(0, budget - half)
    taken = {n: c * aim // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    for n in sorted(counts, reverse=True):
        if left <= 2 * half:
            break
        more = min(counts[n] - taken[n], max(0, (left - half) // n))
        taken[n] += more
        left -= more * n
    # lengths within the window, each count split into powers of two
    spares = {n: min(counts[n] - taken[n], left // n) for n in sorted(counts, reverse=True) if n <= left and counts[n] > taken[n]}
    unit = math.gcd(*spares) or 1
    left = min(left, sum(n * c for n, c in spares.items())) // unit
    items = []
    for n, spare in spares.items():
        part = 1
        while spare > 0:
            use = min(part, spare)
            items.append((n, use))
            spare -= use
            part *= 2
    # for each sum, the item that reached it first
    reach, mask, by = 1, (1 << (left + 1)) - 1, np.zeros(left + 1, dtype=np.int32)
    for i, (n, use) in enumerate(items):
        new = (reach << (n // unit * use)) & mask & ~reach
        if new:
            by[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))] = i
            reach |= new
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at:
        n, use = items[by[at]]
        taken[n] += use
        at -= n // unit * use
    return taken


def _fit_source(most: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        target = float(pdf["target"].iloc[0])
        counts = dict(zip(pdf[LEN].astype(int), pdf["docs"].astype(int), strict=True))
        total = sum(n * c for n, c in counts.items())
        passes = min(most, int(target / total + 1e-9)) if total else 0
        budget = round(target - passes * total) if passes < most else 0
        taken = fit_budget(counts, budget)
        return pd.DataFrame({NO: pdf[NO], NAME: pdf[NAME], LEN: pdf[LEN], "passes": passes, "extra": [taken.get(int(n), 0) for n in pdf[LEN]]})

    return fit


def decide(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MAX_REPEATS,
    seed: int = 20240229,
    rid: str | None = None,
) -> DataFrame:
    """One row per row of ``df``: its number ``__tarn_rid``, ``id_col``, ``size``, ``source_size``, ``target`` (its source's) and ``taken``.

    ``taken`` counts the words that the mix takes of a row, repeats counted: a
    multiple of ``size``, at most ``most`` times it.  Sources, ordered by code
    point with null last, take ``weights`` in turn.  Null and empty texts have
    size 0 and nothing to take.  Equal rows are told apart by their numbers:
    those in column ``rid``, or such as they get in the one scan that counts
    their words.  A second run takes the same rows.  An empty table gives none.
    """
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    rows = df.select(
        number.alias(RID),
        F.col(id_col).alias("__tarn_id"),
        F.col(source).isNull().alias(NO),
        F.coalesce(F.col(source), F.lit("")).alias(NAME),
        words(F.col(text)).alias(LEN),
        # identifiers alone decide the order; rows without one are spread by their numbers
        F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), number)).alias(ORDER),
    )
    rows = materialize(rows, "mix-rows")
    bits = max(4, math.ceil(math.log2(max(1, rows.count())) / 2))
    rows = rows.withColumn(SLICE, F.shiftrightunsigned(F.xxhash64(ORDER), 64 - bits).cast("int"))
    slices = rows.groupBy(NO, NAME, LEN, SLICE).agg(F.count("*").alias("here"))
    lengths = materialize(rows.groupBy(NO, NAME, LEN).agg(F.count("*").alias("docs")), "mix-lengths")
    sources = lengths.groupBy(NO, NAME).agg(F.sum(F.col(LEN) * F.col("docs")).alias("source_size"))
    targets = materialize(fit_targets(sources, weights, share, most), "mix-targets")
    plan = lengths.join(targets, [NO, NAME]).groupBy(NO, NAME).applyInPandas(_fit_source(most), f"{NO} boolean, {NAME} string, {LEN} long, passes long, extra long")
    plan = materialize(plan.join(targets, [NO, NAME]), "mix-plan")

    before = Window.partitionBy(NO, NAME, LEN).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    first = slices.withColumn("first", F.coalesce(F.sum("here").over(before), F.lit(0))).join(plan, [NO, NAME, LEN])
    inside = Window.partitionBy(NO, NAME, LEN, SLICE).orderBy(ORDER, RID)
    placed = rows.join(first, [NO, NAME, LEN, SLICE]).withColumn("rank", F.row_number().over(inside) + F.col("first"))
    copies = F.col("passes") + (F.col("rank") <= F.col("extra")).cast("long")
    return placed.select(
        RID,
        F.col("__tarn_id").alias(id_col),
        F.col(LEN).alias("size"),
        "source_size",
        "target",
        (copies * F.col(LEN)).alias("taken"),
    )


def mix_sources(df: DataFrame, id_col: str = "doc_id", text: str = "text", scanned: bool = False, **options) -> DataFrame:
    """``df`` as mixed: each row as often as the mix takes it, columns unchanged; rows of size 0 go. ``scanned``: a plain read of files, so no numbered copy is needed."""
    rows = numbered(df, "mix-input", scanned)
    taken = decide(rows, id_col, text, rid=RID, **options).where("taken > 0").select(RID, F.expr("cast(taken div size as int)").alias("__tarn_copies"))
    # most rows are taken, so their numbers are never few: one and the same join at every size
    met = rows.join(materialize(taken, "mix-taken").hint("merge"), RID).withColumn("__tarn_copy", F.explode(F.sequence(F.lit(1), F.col("__tarn_copies"))))
    return met.select(*carried(df, [RID]))
