"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard.

Two permutations make a whole signature: the first scatters a document's
shingles over a ring, the second, shifted round the ring by one step more for
each coordinate, orders them; a coordinate is the least value.  With 28 bands
of 4 coordinates a pair at Jaccard 0.8 shares no band with probability 4e-7.

Documents with equal shingle sets are one class from the start.  Classes that
share a band are compared by their full sets, but not pair by pair:

1. every class with the smallest class it shares a band with;
2. where that left them apart, with the smallest class of each band;
3. where a band still holds several components, the members outside its
   largest component with all others, in blocks, inside the tasks; only links
   leave a task, and a pair is looked at in the first band that it shares.

No band, block or partner is capped.  A band or a class may hold a third of all
rows: joins on either are salted.  Rows are numbered in one written copy of the
texts, which all later steps read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from tarn.llm import _words
from tarn.llm._common import RID, carried, join_hot, numbered, small_batches, without
from tarn.llm.components import components
from tarn.session import materialize, release

BANDS, ROWS = 28, 4
SHINGLE = 4
#: About what a block holds: members that are compared, those that they are compared with, and shingles of either.
BLOCK_A, BLOCK_B, BLOCK_SHINGLES = 512, 1024, 4_000_000


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted, distinct hashes of ``size``-word shingles, A-Z in lower case.

    Fewer words make one shingle; no words, none. A null text has no words.
    """
    for _, part in _words.pieces(texts):
        hashes, counts, _ = _words.word_hashes(part, lower=True)
        wide = _words.windows(hashes, size)
        at = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(wide[at : at + n - size + 1])
            else:
                yield _words.windows(hashes[at : at + n], n) if n else np.zeros(0, np.uint64)
            at += n


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the ring of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each coordinate; the first permutation is the top half of the scattered shingle hash."""
    ring = (_words.mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, (1 << 18) // len(_SHIFTS))
    for i in range(0, len(ring), step):
        np.minimum(out, _second(ring[None, i : i + step] + _SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    quads = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _words.mix(key * np.uint64(0x9E3779B97F4A7C15) + quads[:, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, digest, bands = [], [], []
        for s in shingle_sets(pdf["text"].tolist()):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
        yield pd.DataFrame({"rid": pdf["rid"], "id": pdf["id"], "n": n, "digest": digest, "bands": bands})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "shingles": [s.tobytes() for s in shingle_sets(pdf["text"].tolist())]})


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of 0.8 or more, exactly."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


@pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    view = lambda x: np.frombuffer(x, dtype=np.uint64)
    return pd.Series([linked(view(x), view(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v), written already, whose full sets are linked; many may share one v."""
    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    often = pairs.groupBy("v").agg(F.count("*").alias("copies")).join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return join_hot(with_u, often, ["v"], "copies", pairs.count(), ["u"]).where(_linked("a", "b")).select("u", "v")


def _compare(rows: list) -> Iterator[tuple[int, int]]:
    """Links between side A and side B of a unit, at most one for each member of A and component of B."""
    left = [r for r in rows if r.side == 0]
    right = [r for r in rows if r.side == 1]
    if not left or not right:
        return
    sets = [np.frombuffer(r.shingles, dtype=np.uint64) for r in right]
    size = np.array([len(s) for s in sets])
    node, label = np.array([r.node for r in right]), np.array([r.label for r in right])
    minor, bands = np.array([r.minor for r in right]), np.stack([np.asarray(r.bands) for r in right])
    for r in left:
        mine = np.frombuffer(r.shingles, dtype=np.uint64)
        n = len(mine)
        fit = (label != r.label) & (5 * np.minimum(size, n) >= 4 * np.maximum(size, n)) & (~minor | (node > r.node))
        shared = bands == np.asarray(r.bands)[None, :]
        at = np.flatnonzero(fit & shared[:, r.band] & (shared.argmax(axis=1) == r.band))
        if not len(at):
            continue
        all_ = np.concatenate([sets[i] for i in at])
        found = np.searchsorted(mine, all_)
        hit = mine[np.minimum(found, n - 1)] == all_
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[at])[:-1]]))
        good = at[100 * both >= 80 * (n + size[at] - both)]
        for x in np.unique(label[good], return_index=True)[1]:
            yield int(r.node), int(node[good[x]])


def _compare_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units arrive together, sorted by key; one is held at a time."""
    key, rows = None, []
    for pdf in batches:
        links = []
        for r in pdf.itertuples(index=False):
            if (r.bucket, r.i, r.j) != key:
                links += _compare(rows)
                key, rows = (r.bucket, r.i, r.j), []
            rows.append(r)
        yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    yield pd.DataFrame(list(_compare(rows)), columns=["u", "v"], dtype="int64")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def decide(df: DataFrame, id_col: str = "doc_id", text: str = "text", rid: str | None = None, scanned: bool = False) -> DataFrame:
    """One row per row of ``df``: its number ``__tarn_rid``, ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    A row without words has no shingles, is linked with nothing and stays.  Of
    a component, the row with the smallest identifier stays; where several rows
    carry it, one of them.  Rows without identifier take part; a component of
    such rows alone has a null ``component_id`` and keeps its first row.  An
    empty table gives none.  ``rid`` names a column that numbers the rows,
    whenever they are read; without it ``df`` is written once, with numbers,
    unless it is a plain read of files (``scanned``).
    """
    spark = df.sparkSession
    small_batches(spark)
    if rid is None:
        df, rid = numbered(df if scanned else df.select(id_col, text), "near-rows", scanned), RID
    source = df.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    signed = materialize(source.mapInPandas(_sign, f"rid long, id {id_type}, n long, digest binary, bands array<long>"), "near-signed")

    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")
    classes = signed.where("n > 0").groupBy("digest").agg(best, F.count("*").alias("copies"))
    classes = materialize(classes.select("digest", "best", F.col("best.rid").alias("node"), "copies"), "near-classes")

    # a class is represented by one of its rows
    members = signed.join(classes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "n", F.posexplode("bands").alias("band", "key"))
    members = materialize(members.select("node", "n", "band", F.xxhash64("band", "key").alias("bucket")), "near-bands")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("copies"), F.min("node").alias("pivot")).where("copies > 1")
    buckets = materialize(buckets.withColumn("size", F.col("copies")), "near-buckets")
    bands, members = members, materialize(join_hot(members, buckets, ["bucket"], "copies", members.count(), ["node"]), "near-members")
    release(bands)

    nodes = members.select("node").distinct()
    chosen = source.join(nodes.withColumnRenamed("node", "rid"), "rid").select(F.col("rid").alias("node"), "text")
    sets = materialize(chosen.mapInPandas(_sets, "node long, shingles binary"), "near-sets")

    first = members.groupBy("node").agg(F.min("pivot").alias("v")).where("v <> node").select(F.col("node").alias("u"), "v")
    first = materialize(first, "near-first")
    labels = _relabelled(None, _verify(first, sets))

    pivots = buckets.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left")
    pivots = pivots.select("bucket", "copies", F.coalesce("pivot_label", "pivot").alias("pivot_label"))
    told = join_hot(_labelled(members, labels), pivots, ["bucket"], "copies", members.count(), ["node"])
    apart = told.where("label <> pivot_label").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    apart = materialize(apart.join(first, ["u", "v"], "left_anti"), "near-apart")
    labels = _relabelled(labels, _verify(apart, sets))

    told = materialize(_labelled(members.where("size > 2"), labels), "near-told")
    release(members, buckets, first, apart)
    labels = _relabelled(labels, _units(told, signed, sets))
    release(told, sets)
    return _assign(signed, classes, labels, id_col)


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after ``links`` (u, v) came to those that ``labels`` has; the same where there are no new links."""
    links = materialize(links, "near-links")
    if labels is not None:
        if links.isEmpty():
            return labels
        found = materialize(components(links.union(labels.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")))), "near-labels")
    else:
        found = materialize(components(links), "near-labels")
    release(links, labels)
    return found


def _units(members: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside bands that still hold several components."""
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    blocks = lambda rows, shingles, most: F.ceil(F.greatest(rows / most, shingles / BLOCK_SHINGLES)).cast("int")
    open_ = (
        counts.groupBy("bucket")
        .agg(F.max(F.struct("n", "label", "shingles")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("copies"), F.sum("shingles").alias("shingles"))
        .where("labels > 1")
        .select(
            "bucket",
            "copies",
            F.col("top.label").alias("main"),
            blocks(F.col("copies") - F.col("top.n"), F.col("shingles") - F.col("top.shingles"), BLOCK_A).alias("blocks_a"),
            blocks(F.col("copies"), F.col("shingles"), BLOCK_B).alias("blocks_b"),
        )
    )
    inside = join_hot(members.select("bucket", "band", "node", "label"), open_, ["bucket"], "copies", members.count(), ["node"])
    inside = materialize(inside.withColumn("minor", F.col("label") != F.col("main")), "near-open")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    plain = ["bucket", "band", "node", "label", "minor"]
    a = inside.where("minor").select(*plain, F.lit(0).alias("side"), block("blocks_a").alias("i"), every("blocks_b").alias("j"))
    b = inside.select(*plain, F.lit(1).alias("side"), every("blocks_a").alias("i"), block("blocks_b").alias("j"))
    rows = a.union(b).join(sets, "node").join(signed.select(F.col("rid").alias("node"), "bands"), "node")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInPandas(_compare_units, "u long, v long")


def _assign(signed: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Every row with its component; rows of large classes, and classes of large components, are salted before they meet their head."""
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "near-named")
    release(classes, labels)
    heads = named.groupBy("label").agg(F.min("best").alias("head"), F.count("*").alias("members"))
    named = join_hot(named, heads, ["label"], "members", named.count(), ["node"])
    rows = signed.select("rid", "id", "n", "digest").where("n > 0")
    met = join_hot(rows, named.select("digest", "head", "copies"), ["digest"], "copies", signed.count(), ["rid"])
    out = [RID, id_col, "n_shingles", "component_id", "kept"]
    some = met.select("rid", "id", "n", F.col("head.id"), F.col("rid") == F.col("head.rid")).toDF(*out)
    none = signed.where("n = 0").select("rid", "id", "n", "id", F.lit(True)).toDF(*out)
    return some.union(none)


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", scanned: bool = False) -> DataFrame:
    """``df`` with one row of each component, columns unchanged. ``scanned``: it is a plain read of files, so no numbered copy is needed."""
    rows = numbered(df, "near-input", scanned)
    dropped = materialize(decide(rows, id_col, text, rid=RID).where(~F.col("kept")).select(RID), "near-dropped")
    return without(rows, dropped).select(*carried(df, [RID]))
