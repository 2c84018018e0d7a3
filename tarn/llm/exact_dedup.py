"""Exact deduplication over a log-structured merge index of digests.

An entry is (digest, best row, count).  Rows are dealt to memtables by a hash of
their number, about log2 of their count of them; each flushes one run: its entries, combined per digest,
sorted, and beside it a blocked Bloom filter, one 64-bit word for every few
digests.  A flushed entry is a hit if its own run met the digest twice, or if
the filter of another run may hold it.  All other entries are final as they
are: filters miss nothing.  Compaction merges the hits of all runs and keeps for
each digest the best row: most code points, then smallest identifier.

A digest that several rows share is only a hint.  The whole normalised bytes of
such rows, and of no others, are read again and compared; where one digest turns
out to hold several texts, each text becomes a variant of it and is indexed on
its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import RID, SPACE_CLASS, carried, join_hot, numbered, without
from tarn.session import materialize, scratch_path

ID, DIGEST, POINTS, VARIANT = "__tarn_id", "__tarn_digest", "__tarn_points", "__tarn_variant"
KEY = [DIGEST, VARIANT]
#: Rows below which one memtable is enough, and digests for which a filter has one word of 64 bits.
MEMTABLE_ROWS, WORD_KEYS = 4096, 6
#: Up to so many shared digests are broadcast (8 bytes each) to find their texts; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    """The text without white space; a null text counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best() -> Column:
    """Orders rows of equal texts, the one to keep first. Rows without identifier come last; equal rows by number."""
    return F.struct((-F.col(POINTS)).alias("points"), F.col(ID).isNull().alias("no_id"), F.col(ID).alias("id"), F.col(RID).alias("rid"))


class DigestIndex:
    """Sorted digest runs and their filters in the shared folder."""

    def __init__(self, rows: DataFrame, memtables: int | None = None):
        """Flush ``rows`` (rid, id, digest, variant, points) as sorted runs, combined before they are shuffled."""
        n = rows.count()
        self.memtables = memtables or max(1, math.ceil(math.log2(max(1, n / MEMTABLE_ROWS))))
        self._words = max(1, n // (self.memtables * WORD_KEYS))
        dealt = rows.withColumn("run", F.pmod(F.xxhash64(F.col(RID)), F.lit(self.memtables)).cast("int"))
        entries = dealt.groupBy("run", *KEY).agg(F.min(_best()).alias("best"), F.count("*").alias("n"))
        self._path, self._schema = scratch_path(rows.sparkSession, "digest-runs"), entries.schema
        entries.sortWithinPartitions("run", *KEY).write.partitionBy("run").parquet(self._path)
        self._spark = rows.sparkSession
        word = self._hashed(self.entries()).groupBy("block", "run").agg(F.bit_or("mask").alias("word"))
        self.filters = materialize(word.groupBy("block").agg(F.collect_list(F.struct("run", "word")).alias("words")), "digest-filters")

    def entries(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)

    def _hashed(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the filter word that a key falls into and the four bits it has there."""
        bits = " | ".join(f"shiftleft(1L, cast(shiftright(hash, {6 * i}) & 63 AS int))" for i in range(4))
        hashed = keys.withColumn("hash", F.xxhash64(*KEY))
        return hashed.withColumns({"block": F.pmod(F.shiftrightunsigned("hash", 24), F.lit(self._words)), "mask": F.expr(bits)}).drop("hash")

    def hits(self) -> DataFrame:
        """Entries whose digest their own run met more than once, or that the filter of another run may hold."""
        probed = self._hashed(self.entries()).join(self.filters, "block")
        return probed.where("n > 1 OR exists(words, w -> w.run <> run AND w.word & mask = mask)").drop("block", "mask", "words")

    def compact(self) -> DataFrame:
        """One entry for each digest that several rows share: (digest, variant, best, n); all other entries stand as they are."""
        return self.hits().groupBy(*KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")).where("n > 1")

    def lookup(self, digests: list[str]) -> DataFrame:
        """Entries of a few digests; runs whose filters can't hold any are not read."""
        asked = self._spark.createDataFrame([(d, "") for d in digests], f"{DIGEST} string, {VARIANT} string")
        met = self._hashed(asked).join(self.filters, "block").select("mask", F.explode("words").alias("w")).where("w.word & mask = mask")
        runs = [r.run for r in met.select("w.run").distinct().collect()]
        return self.entries().where(F.col("run").isin(runs) & F.col(DIGEST).isin(digests))


def _write_log(df: DataFrame, id_col: str, text: str, digest: Callable[[Column], Column], rid: str | None, clashes: DataFrame | None = None) -> DataFrame:
    """One row per row of ``df``, from one scan: its number, identifier, digest and length, and its whole text if its digest is one of ``clashes``."""
    norm = normalised(F.col(text))
    given = F.col(rid) if rid else F.lit(None).cast("long")
    rows = df.select(given.alias("given"), F.col(id_col).alias(ID), digest(norm).alias(DIGEST), F.length(F.coalesce(F.col(text), F.lit(""))).alias(POINTS), norm.alias(VARIANT))
    if clashes is None:
        rows = rows.withColumn(VARIANT, F.lit(""))
    else:
        rows = rows.join(clashes.withColumn("clash", F.lit(True)), DIGEST, "left").withColumn(VARIANT, F.when(F.col("clash"), F.col(VARIANT)).otherwise(""))
    return materialize(rows.select(F.coalesce("given", F.monotonically_increasing_id()).alias(RID), ID, *KEY, POINTS), "digest-log")


def _clashes(df: DataFrame, text: str, digest: Callable[[Column], Column], shared: DataFrame) -> DataFrame | None:
    """Digests of ``shared`` that hold more than one text; None where bytes confirm them all.

    Only texts with a shared digest are compared.  Grouping by digest and whole
    bytes combines copies on the map side: a hot group sends one copy of its
    text from each task.
    """
    keys = shared.select(F.xxhash64(DIGEST).alias("key")).distinct()
    norm = normalised(F.col(text))
    texts = df.select(norm.alias("norm"), digest(norm).alias(DIGEST)).withColumn("key", F.xxhash64(DIGEST))
    if shared.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(keys), "key", "left_semi").groupBy(DIGEST, "norm").agg(F.lit(1).alias("one"))
    else:
        # copies are combined before they are shuffled, so that no key is hot in the join
        texts = texts.groupBy("key", DIGEST, "norm").agg(F.lit(1).alias("one")).join(keys, "key", "left_semi")
    clash = materialize(texts.groupBy(DIGEST).agg(F.count("*").alias("texts")).where("texts > 1").select(DIGEST), "digest-clashes")
    return None if clash.isEmpty() else clash


def decide(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    memtables: int | None = None,
    digest: Callable[[Column], Column] = sha256_hex,
    rid: str | None = None,
) -> DataFrame:
    """One row per row of ``df``: its number ``__tarn_rid``, ``id_col``, ``keep_id``, ``group_size``, ``kept``, and its digest.

    Texts are equal if they are identical without white space.  Null and empty
    texts are equal to each other.  Of rows that agree in length and
    identifier, exactly one is kept.  Rows without identifier are kept only
    where no other row of the group is as long.  An empty table gives none.

    ``rid`` names a column that numbers the rows; without it rows get numbers
    in the one scan that writes the log.  No step matches rows across scans by
    their place: texts are found again by their digests.
    """
    rows = _write_log(df, id_col, text, digest, rid)
    groups = materialize(DigestIndex(rows, memtables).compact(), "digest-groups")
    clashes = _clashes(df, text, digest, groups)
    if clashes is not None:
        rows = _write_log(df, id_col, text, digest, rid, clashes)
        groups = materialize(DigestIndex(rows, memtables).compact(), "digest-groups")
    named = groups.select(*KEY, F.struct("best", "n").alias("group"), F.col("n").alias("copies"))
    met = join_hot(rows, named, KEY, "copies", rows.count(), [RID], "left")
    alone = F.col("group").isNull()
    return met.select(
        RID,
        F.col(ID).alias(id_col),
        F.when(alone, F.col(ID)).otherwise(F.col("group.best.id")).alias("keep_id"),
        F.coalesce(F.col("group.n"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col(RID) == F.col("group.best.rid"))).alias("kept"),
        F.col(DIGEST).alias("digest"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", scanned: bool = False, **options) -> DataFrame:
    """``df`` without the rows that :func:`decide` drops, columns unchanged. ``scanned``: it is a plain read of files, so no numbered copy is needed."""
    rows = numbered(df, "dedup-rows", scanned)
    dropped = materialize(decide(rows, id_col, text, rid=RID, **options).where(~F.col("kept")).select(RID), "dedup-dropped")
    return without(rows, dropped).select(*carried(df, [RID]))
