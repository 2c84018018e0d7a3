"""Sharding by histogram sort.

Rows are ordered by a 120-bit key: 60 hashed bits of the key columns, then 60
bits of the row's number, which only matter between rows whose key columns are
equal.  Splitters between shards are found by counting exact
bytes: a round counts the bytes that lie between evenly spaced probes inside
every open bracket, keeps a probe that is near enough to its target, and opens
the narrower bracket around each other target.  Only bracket counts reach the
driver: at most ``4096 * (n_shards - 1)`` numbers a round, whatever the input.
Rows move once, when every splitter is known.

Slots number a shard's rows without gaps.  A shard is not sorted in one task:
it is cut into bins by key, and by number where many rows have one key; the
bins' exact counts give each bin's first slot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._common import RID, carried, hash60, numbered
from tarn.session import materialize

DIGIT = 12
LEVELS = 10  # 5 digits of the key hash, 5 of the position hash
K1, K2, SIZE, BIN, PART = "__tarn_k1", "__tarn_k2", "__tarn_size", "__tarn_bin", "__tarn_part"
#: Up to so many bins of equal keys are broadcast; more are joined by a shuffle.
BROADCAST_BINS = 100_000


def _digit(level: int) -> Column:
    column, shift = (K1, 48 - DIGIT * level) if level < 5 else (K2, 48 - DIGIT * (level - 5))
    return F.shiftright(F.col(column), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _prefix(level: int) -> list[Column]:
    """The key's digits above ``level`` as one or two numbers."""
    if level <= 5:
        return [F.shiftright(F.col(K1), 60 - DIGIT * level) if level < 5 else F.col(K1)]
    return [F.col(K1), F.shiftright(F.col(K2), 60 - DIGIT * (level - 5))]


def _edge(level: int, prefix: tuple[int, ...], digit: int) -> tuple[int, int]:
    """The smallest key (k1, k2) whose digits down to ``level`` are ``prefix`` and ``digit``."""
    if level < 5:
        return (((prefix[0] if prefix else 0) << DIGIT) + digit) << (48 - DIGIT * level), 0
    head = prefix[1] if len(prefix) > 1 else 0
    return prefix[0], ((head << DIGIT) + digit) << (48 - DIGIT * (level - 5))


def find_splitters(keyed: DataFrame, shares: list[float], slack: float = 0.0) -> list[tuple[int, int]]:
    """Splitters over ``keyed`` (k1, k2, size): below the i-th lie about ``shares[i]`` of all bytes.

    A splitter is settled when the bytes below it are within ``slack`` (a share
    of all bytes) of its target, or when one row alone lies between two probes.
    """
    level0 = keyed.groupBy(_digit(0).alias("d")).agg(F.sum(SIZE).alias("b"), F.count("*").alias("n")).collect()
    total = sum(r.b for r in level0)
    if not total:
        return []
    slack *= total
    settled: dict[int, tuple[int, int]] = {}
    brackets: dict[int, tuple[tuple[int, ...], float]] = {i: ((), 0) for i in range(len(shares))}
    counts = {(): {r.d: (r.b, r.n) for r in level0}}
    for level in range(LEVELS):
        if level:
            wanted = sorted({p for p, _ in brackets.values()})
            inside = F.lit(False)
            for p in wanted:
                match = F.lit(True)
                for column, value in zip(_prefix(level), p, strict=True):
                    match &= column == F.lit(value)
                inside |= match
            names = [f"p{i}" for i in range(len(_prefix(level)))]
            found = (
                keyed.where(inside)
                .groupBy(*[c.alias(n) for c, n in zip(_prefix(level), names, strict=True)], _digit(level).alias("d"))
                .agg(F.sum(SIZE).alias("b"), F.count("*").alias("n"))
                .collect()
            )
            counts = {}
            for r in found:
                counts.setdefault(tuple(r[n] for n in names), {})[r.d] = (r.b, r.n)
        opened = {}
        for i, (prefix, below) in brackets.items():
            target, at = total * shares[i], below
            for digit in sorted(counts[prefix]):
                size, n = counts[prefix][digit]
                if at + size < target:
                    at += size
                    continue
                low, high = target - at, at + size - target
                if min(low, high) <= slack or n == 1 or level == LEVELS - 1:
                    settled[i] = _edge(level, prefix, digit + (high < low))
                elif level < 4:
                    opened[i] = (((prefix[0] if prefix else 0) << DIGIT) + digit,), at
                elif level == 4:
                    opened[i] = ((prefix[0] << DIGIT) + digit,), at
                else:
                    opened[i] = (prefix[0], ((prefix[1] if len(prefix) > 1 else 0) << DIGIT) + digit), at
                break
            else:
                settled[i] = _edge(level, prefix, max(counts[prefix]) + 1)
        brackets = opened
        if not brackets:
            break
    return [settled[i] for i in sorted(settled)]


def shard_of(splitters: list[tuple[int, int]], low: int, high: int) -> Column:
    """How many splitters a row's key reaches: a balanced tree of comparisons, inside generated code."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    k1, k2 = splitters[mid]
    below = F.col(K1) < F.lit(k1) if not k2 else (F.col(K1) < F.lit(k1)) | ((F.col(K1) == F.lit(k1)) & (F.col(K2) < F.lit(k2)))
    return F.when(below, shard_of(splitters, low, mid)).otherwise(shard_of(splitters, mid + 1, high))


def _bins(keyed: DataFrame, bin_bytes: int) -> Callable[[DataFrame], DataFrame]:
    """Adds to rows with keys their bins of about ``bin_bytes``: ranges of the key, cut again by the second number where one range holds far more (equal keys)."""
    total = keyed.agg(F.sum(SIZE)).first()[0] or 0
    bits = min(40, max(0, math.ceil(math.log2(max(1, total / bin_bytes)))))
    coarse = lambda df: df.withColumn(BIN, F.shiftrightunsigned(K1, 60 - bits))
    mass = coarse(keyed).groupBy(BIN).agg(F.sum(SIZE).alias("bytes"), F.count("*").alias("rows"))
    # a range of a hashed key holds one bin's bytes, give or take: what holds 8 times that in more than one row has equal keys or long rows
    large = mass.where((F.col("bytes") > 8 * bin_bytes) & (F.col("rows") > 1))
    large = materialize(large.select(BIN, F.ceil(F.log2(F.col("bytes") / bin_bytes)).cast("int").alias("cut")), "shard-large-bins")
    n = large.count()
    part = F.when(F.col("cut").isNull(), F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned({K2}, 60 - cut)"))

    def cut(df: DataFrame) -> DataFrame:
        if not n:
            return coarse(df).withColumn(PART, F.lit(0).cast("long"))
        return coarse(df).join(F.broadcast(large) if n <= BROADCAST_BINS else large, BIN, "left").withColumn(PART, part).drop("cut")

    return cut


def histogram_shards(
    df: DataFrame,
    n_shards: int,
    keys: list[str] | None = None,
    text: str = "text",
    overhead: int = 16,
    tolerance: float = 0.002,
    bin_bytes: int = 1 << 20,
    scanned: bool = False,
) -> DataFrame:
    """``df`` with ``size`` (UTF-8 bytes of ``text`` plus ``overhead``), ``shard`` and ``slot``, in shards of nearly equal bytes.

    ``keys`` (``doc_id`` by default) decide the order, by their hash.  Rows with
    equal keys, nulls among them, are told apart by the number they get when
    they are written, so even one key that holds a third of all rows is spread
    over shards and bins; such rows' own slots depend on how the input is laid
    out, all others' do not.  ``df`` may be any DataFrame; if it is a plain read
    of files (``scanned``), it is not copied first.

    A null text has no bytes.  An empty table gives an empty result.  Input
    columns named like an output are replaced.
    """
    keys = keys or ["doc_id"]
    keep = carried(df, ["size", "shard", "slot"])
    size = F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0)) + F.lit(overhead)
    rows = numbered(df, "shard-rows", scanned).select(*keep, RID, size.alias(SIZE), hash60(*[F.col(c) for c in keys]).alias(K1), hash60(F.col(RID), F.lit(n_shards)).alias(K2))
    keyed = materialize(rows.select(RID, K1, K2, SIZE), "shard-keys")
    splitters = find_splitters(keyed, [i / n_shards for i in range(1, n_shards)], tolerance / n_shards)

    cut, bins = _bins(keyed, bin_bytes), [BIN, PART]
    placed = lambda df: cut(df).withColumn("shard", shard_of(splitters, 0, len(splitters)))
    before = Window.partitionBy("shard").orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed(keyed).groupBy("shard", *bins).count()
    first = counts.select("shard", *bins, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__tarn_first"))
    inside = Window.partitionBy("shard", *bins).orderBy(K1, K2, RID)
    slot = F.col("__tarn_first") + F.row_number().over(inside) - 1
    return placed(rows).join(first, ["shard", *bins]).select(*keep, F.col(SIZE).alias("size"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
