"""N-gram Jaccard join of a corpus with itself over an R-tree of count vectors, exact.

A document is a set of hashed shingles.  Its point has one coordinate for each of
``GROUPS`` groups of hashes: how many of its shingles fall into the group.  Two sets
can't share more than the sum, over all coordinates, of the smaller count; a node of
the R-tree has the largest count of each coordinate below it, and the least and the
largest size, so a whole node goes where even that falls short.  Pairs that survive
are verified on their full sets.

Points of text without much in common are all about equally far apart, so no tree
over a whole corpus prunes well.  The points are therefore dealt to many small trees
that lose no pair: in any order of all shingles, two linked sets share one among the
first ``n - ceil(0.9 n) + 1`` of each.  The order puts what is common last, as told
by a table of counts that all shingles are added up in, so lines and passages that
many documents have rarely decide who meets whom.

Sets that are equal are one class from the start.  In a dense group pairs need not
all be looked at, as components are asked for:

1. every class is bounded, and if that lets it through verified, against the smallest class that it meets;
2. in trees that still hold several components, members outside the largest search
   the tree for the point with the highest bound in another component; those pairs
   are verified, many at once;
3. whoever survived a search with each other is one group, found as components of
   spanning forests, so no pair leaves a task for it; groups that still hold
   several components are searched again, with their sets beside them, and every
   surviving pair is verified inside its task.

A tree with many members is cut into blocks of bounded size; rows of hot shingles,
classes and components are salted.  Nothing is capped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from tarn.llm import _words
from tarn.llm._common import BROADCAST_ROWS, RID, join_hot, numbered, read, small_batches
from tarn.llm.components import components
from tarn.llm.near_dedup import _assign, _relabelled, shingle_sets
from tarn.session import materialize, release

SHINGLE = 3
#: Linked: PERCENT * union <= 100 * intersection.
PERCENT = 90
GROUPS = 64
#: Cells of the table of counts (its size is fixed: one byte a cell when it is broadcast), and pieces that it is added up in.
CELL_BITS, PIECES = 22, 256
#: A shingle is common if its cell holds more than chance explains: over the average by so many of its roots. Each doubling of that is a class of its own.
COMMON = 3
#: Points in a leaf, children of a node.
LEAF, FAN_OUT = 16, 8
#: Trees of up to so many points are one leaf; rows and pairs that are held at once.
ONE_LEAF, GATHERED, PAIRS = 64, 4096, 20_000
#: Sides of a unit that a row is on.
LEFT, BOTH, RIGHT = range(3)
#: Members of one block on either side, and shingles of either, where sets are beside them.
BLOCK_A, BLOCK_B, BLOCK_SHINGLES = 1024, 2048, 4_000_000


def at_least(n: int) -> int:
    """The least overlap that a set of ``n`` needs with any that it is linked with."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    return n - at_least(n) + 1 if n else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) are linked, exactly."""
    if min(len(a), len(b)) < at_least(max(len(a), len(b))):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((_words.mix(shingles) % np.uint64(groups)).astype(np.int64), minlength=groups).astype("<u4")


def packed(counts: np.ndarray) -> bytes:
    """A point in one byte a coordinate where that is enough, else in four."""
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(points: list[bytes], groups: int = GROUPS) -> np.ndarray:
    return np.array([np.frombuffer(p, dtype="u1" if len(p) == groups else "<u4") for p in points], dtype=np.uint32).reshape(len(points), groups)


# ---- which shingles are common


def common_classes(source: DataFrame, cell_bits: int = CELL_BITS) -> np.ndarray:
    """A class for each cell of shingle hashes, 0 for what is ordinary; all texts are counted."""
    cells, width = 1 << cell_bits, (1 << cell_bits) // PIECES
    shift = np.uint64(64 - cell_bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.int64)
        for pdf in batches:
            for s in shingle_sets(pdf["text"].tolist(), SHINGLE):
                np.add.at(total, (s >> shift).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        for k, part in enumerate(total.reshape(PIECES, width)):
            if part.any():
                yield pd.DataFrame({"piece": [k], "task": [task], "counts": [zlib.compress(part.astype("<i8").tobytes(), 1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, packed in zip(pdf["piece"], pdf["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(packed), dtype="<i8")
                held[k] = held[k] + part if k in held else part
        for k, part in held.items():  # PIECES of them at most
            yield pd.DataFrame({"piece": [k], "counts": [zlib.compress(part.tobytes(), 1)]})

    counted = source.select("text").mapInPandas(count, "piece int, task int, counts binary")
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = counted.repartition(parts, "piece").select("piece", "counts").mapInPandas(add, "piece int, counts binary")
    total = np.zeros((PIECES, width), np.int64)
    for r in added.toLocalIterator():  # the table itself, of fixed size
        total[r.piece] = np.frombuffer(zlib.decompress(bytes(r.counts)), dtype="<i8")
    usual = total.sum() / cells
    more = (total.reshape(-1) - usual) / (COMMON * (1 + np.sqrt(usual)))
    return np.ceil(np.log2(np.maximum(0.5, more)) + 1).astype(np.uint8)


def prefix(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, in that order."""
    rank = classes[(shingles >> np.uint64(64 - int(len(classes)).bit_length() + 1)).astype(np.int64)]
    return shingles[np.lexsort((shingles, rank))[: prefix_length(len(shingles))]]


def _sign(classes: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, digest, first, points = [], [], [], []
            for s in shingle_sets(pdf["text"].tolist(), SHINGLE):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first.append(prefix(s, classes).view(np.int64))
                points.append(packed(point(s)))
            yield pd.DataFrame({"rid": pdf["rid"], "id": pdf["id"], "n": n, "digest": digest, "first": first, "point": points})

    return run


# ---- the R-tree


@dataclass
class RTree:
    """Points in leaves of ``LEAF``; each level has the corner and the sizes of its nodes, the root's level last."""

    order: np.ndarray
    points: np.ndarray
    sizes: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def pack(points: np.ndarray) -> RTree:
        """Bulk-loaded: halved along the widest of size and coordinates until a leaf is full."""
        sizes = points.sum(axis=1, dtype=np.int64)
        wide = np.concatenate([sizes[:, None], points], axis=1)
        order, stack = np.arange(len(points)), [(0, len(points))]
        while stack:
            start, end = stack.pop()
            if end - start <= LEAF:
                continue
            mine = wide[order[start:end]]
            along = int((mine.max(axis=0) - mine.min(axis=0)).argmax())
            half = LEAF * (-(-(end - start) // LEAF) // 2)  # leaves stay full
            order[start:end] = order[start:end][np.argpartition(mine[:, along], half - 1 if half == end - start else half)]
            stack += [(start, start + half), (start + half, end)]
        points, sizes = points[order], sizes[order]
        levels, high, low, top, fan = [], points, sizes, sizes, LEAF
        while not levels or len(levels[-1][0]) > 1:
            cut = np.arange(0, len(high), fan)
            high, low, top = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)
            levels.append((high, low, top))
            fan = FAN_OUT
        return RTree(order, points, sizes, levels)

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of points that may be linked with ``q``, bounds of their overlap)."""
        n = int(q.sum())
        at = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            at = at[self._may(q, n, *(x[at] for x in self.levels[k]))[0]]
            fan, most = (FAN_OUT, len(self.levels[k - 1][0])) if k else (LEAF, len(self.points))
            at = (at[:, None] * fan + np.arange(fan)).reshape(-1)
            at = at[at < most]
        may, bound = self._may(q, n, self.points[at], self.sizes[at], self.sizes[at])
        return self.order[at[may]], bound[may]

    @staticmethod
    def _may(q: np.ndarray, n: int, high: np.ndarray, low: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a set below a corner may be linked with ``q``, and the summed minima."""
        bound = np.minimum(high, q).sum(axis=1, dtype=np.int64)
        fits = (100 * low * PERCENT <= 100 * 100 * n) & (100 * top >= PERCENT * n)
        return fits & (bound > 0) & ((100 + PERCENT) * bound >= PERCENT * (n + low)), bound


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole units, about ``GATHERED`` rows of them at a time (a row for each 8 KB of sets, too); units arrive together, sorted by (bucket, i, j, side)."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf) + (int(pdf["shingles"].str.len().sum()) >> 13 if "shingles" in pdf else 0)
        if n < GATHERED:
            continue
        rows = pd.concat(held, ignore_index=True)
        starts = _starts(rows)
        if len(starts) > 1:  # the last unit may go on
            yield rows.iloc[: starts[-1]]
            rows = rows.iloc[starts[-1] :]
        held, n = [rows], len(rows) if len(starts) > 1 else 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Where each unit begins."""
    key = rows[["bucket", "i", "j"]].to_numpy()
    return np.concatenate([[0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1))]) if len(rows) else np.zeros(0, np.int64)


def _hits(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of left rows, places of right rows, bounds): pairs of a unit, of different components, that may be linked; by left row."""
    node, label, minor, side, rest = (rows[c].to_numpy() for c in ("node", "label", "minor", "side", "rest"))
    points = unpacked(rows["point"].tolist())
    sizes = points.sum(axis=1, dtype=np.int64)
    starts = _starts(rows)
    ends = np.append(starts[1:], len(rows))
    upto = lambda most: starts + np.add.reduceat(side <= most, starts)
    lefts, rights = (upto(BOTH), upto(LEFT)) if len(starts) else (starts, starts)

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where components differ and enough of both sets comes after the shingle that they meet by.  A pair of members outside the main component is met from both sides: once is enough."""
        apart = (label[x] != label[y]) & (~minor[y] | (node[y] < node[x]))
        return apart & ((100 + PERCENT) * np.minimum(rest[x], rest[y]) >= PERCENT * (sizes[x] + sizes[y]))

    found = []
    small = ends - rights <= ONE_LEAF
    for x, y in _products(starts[small], lefts[small], rights[small], ends[small]):
        ok = fits(x, y)
        x, y = x[ok], y[ok]
        found += [_bounded(points, sizes, x[k : k + PAIRS], y[k : k + PAIRS]) for k in range(0, len(x), PAIRS)]
    for start, left, right, end in zip(starts[~small], lefts[~small], rights[~small], ends[~small], strict=True):
        tree = RTree.pack(points[right:end])
        for x in range(start, left):
            at, bound = tree.search(points[x])
            ok = fits(np.full(len(at), x), at + right)
            found.append((np.full(int(ok.sum()), x), at[ok] + right, bound[ok]))
    x, y, bound = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((y, -bound, x))
    return x[order], y[order], bound[order]


def _products(starts: np.ndarray, lefts: np.ndarray, rights: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of left and right rows of all pairs of small units, about ``PAIRS`` at a time."""
    left, right = lefts - starts, np.maximum(1, ends - rights)
    n = left * (ends - rights)
    for units in np.array_split(np.arange(len(starts)), max(1, int(n.sum()) // PAIRS)):
        unit = np.repeat(units, n[units])
        at = np.arange(len(unit)) - np.repeat(np.cumsum(n[units]) - n[units], n[units])
        yield starts[unit] + at // right[unit], rights[unit] + at % right[unit]


def _bounded(points: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these pairs, those that the bound of one leaf lets through."""
    near = (PERCENT * sizes[y] <= 100 * sizes[x]) & (100 * sizes[y] >= PERCENT * sizes[x])
    x, y = x[near], y[near]
    bound = np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64)
    may = (bound > 0) & ((100 + PERCENT) * bound >= PERCENT * (sizes[x] + sizes[y]))
    return x[may], y[may], bound[may]


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v, nearest): for each left member the right one of the highest bound, and a spanning forest of all pairs that survive."""
    for rows in _gathered(batches):
        x, y, _ = _hits(rows)
        node = rows["node"].to_numpy()
        first = np.flatnonzero(np.diff(x, prepend=-1))
        tree = _forest(node[x].tolist(), node[y].tolist())
        yield pd.DataFrame({"u": node[x[first]], "v": node[y[first]], "nearest": True})
        yield pd.DataFrame(tree, columns=["u", "v"], dtype="int64").assign(nearest=False)


def _forest(u: list[int], v: list[int]) -> list[tuple[int, int]]:
    """Of these edges, as many as connect whatever they connect."""
    above: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := above.get(a, a)) != a:
            above[a] = a = above.get(b, b)
        return a

    out = []
    for a, b in zip(u, v, strict=True):
        p, q = root(a), root(b)
        if p != q:
            above[p] = q
            out.append((a, b))
    return out


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) of surviving pairs, one for each left member and component."""
    view = lambda x: np.frombuffer(x, dtype=np.uint64)
    for rows in _gathered(batches):
        node, label, shingles = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["shingles"].tolist()
        links, left, done = [], None, set()
        for x, y, _ in zip(*(v.tolist() for v in _hits(rows)), strict=True):
            if x != left:
                left, done = x, set()
            if label[y] not in done and linked(view(shingles[x]), view(shingles[y])):
                done.add(label[y])
                links.append((int(node[x]), int(node[y])))
        yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")


# ---- Spark


@pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    view = lambda x: np.frombuffer(x, dtype=np.uint64)
    return pd.Series([linked(view(x), view(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


@pandas_udf(BooleanType())
def _may_be_linked(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = unpacked(a.tolist()), unpacked(b.tolist())
    at = np.arange(len(x))
    ok = _bounded(np.concatenate([x, y]), np.concatenate([x, y]).sum(axis=1, dtype=np.int64), at, at + len(x))[0]
    return pd.Series(np.isin(at, ok))


def _beside(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """``pairs`` (u, v), written already, with ``a`` and ``b``: what ``side`` (node, value) has for both; many may share one v."""
    with_u = pairs.join(side.select(F.col("node").alias("u"), F.col(value).alias("a")), "u")
    often = pairs.groupBy("v").agg(F.count("*").alias("copies")).join(side.select(F.col("node").alias("v"), F.col(value).alias("b")), "v")
    return join_hot(with_u, often, ["v"], "copies", pairs.count(), ["u"])


def _sets_of(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of these nodes, written already."""
    few = nodes.count() <= BROADCAST_ROWS
    nodes = nodes.withColumnRenamed("node", "rid")
    chosen = source.join(F.broadcast(nodes) if few else nodes, "rid", "left_semi").select(F.col("rid").alias("node"), "text")
    return materialize(chosen.mapInPandas(_sets, "node long, shingles binary"), "join-sets")


def _verify(pairs: DataFrame, points: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (u, v), written already, whose bound lets them through and whose full sets are linked; written."""
    may = materialize(_beside(pairs, points, "point").where(_may_be_linked("a", "b")).select("u", "v"), "join-may")
    nodes = materialize(may.select(F.col("u").alias("node")).union(may.select("v")).distinct(), "join-nodes")
    sets = _sets_of(source, nodes)
    links = materialize(_beside(may, sets, "shingles").where(_linked("a", "b")).select("u", "v"), "join-links")
    release(may, nodes, sets)
    return links


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "shingles": [s.tobytes() for s in shingle_sets(pdf["text"].tolist(), SHINGLE)]})


def _open(members: DataFrame, labels: DataFrame, name: str, shingles: bool) -> DataFrame:
    """Members (bucket, node, n) of trees that hold several components, with ``label``, ``minor`` (not of the largest one) and the tree's blocks."""
    told = materialize(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), f"{name}-told")
    counts = told.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    weight = lambda c: F.col(c) / BLOCK_SHINGLES if shingles else F.lit(0)
    blocks = lambda rows, most, held: F.greatest(F.lit(1), F.ceil(F.greatest(rows / most, held))).cast("int")
    trees = (
        counts.groupBy("bucket")
        .agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("copies"), F.sum("shingles").alias("shingles"))
        .where("labels > 1")
        .select("bucket", "copies", F.col("top.label").alias("main"), blocks(F.col("copies") - F.col("top.n"), BLOCK_A, weight("shingles")).alias("blocks_a"), blocks(F.col("copies"), BLOCK_B, weight("shingles")).alias("blocks_b"))
    )
    out = materialize(join_hot(told, trees, ["bucket"], "copies", told.count(), ["node"]).withColumn("minor", F.col("label") != F.col("main")), name)
    release(told)
    return out


def _dealt(inside: DataFrame, beside: DataFrame) -> DataFrame:
    """Units of open trees: each block of members outside the main component with each block of all, what is ``beside`` a node joined to it."""
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    plain = ["bucket", "node", "rest", "label", "minor"]
    whole = F.col("blocks_a") * F.col("blocks_b") == 1  # a tree in one block has its members once
    a = inside.where(F.col("minor") & ~whole).select(*plain, F.lit(LEFT).alias("side"), block("blocks_a").alias("i"), every("blocks_b").alias("j"))
    b = inside.select(*plain, F.when(whole & F.col("minor"), BOTH).otherwise(RIGHT).alias("side"), every("blocks_a").alias("i"), block("blocks_b").alias("j"))
    parts = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.union(b).join(beside, "node").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")


def decide(df: DataFrame, id_col: str = "doc_id", text: str = "text", scanned: bool = False) -> DataFrame:
    """One row per row of ``df``: its number ``__tarn_rid``, ``id_col``, ``n_shingles``, ``component_id``, ``kept`` (the first row of its component).

    A row without words has no shingles and is linked with nothing; one with
    fewer than three has its whole sequence as its only shingle.  Rows without
    identifier take part; a component of such rows alone has a null
    ``component_id``.  Repeated rows are of one component.  Texts may be of any
    length.  Other columns are not passed on, so none can clash.  An empty table
    gives none.  ``scanned``: ``df`` is a plain read of files, so rows are told
    by file and place instead of being written once.
    """
    small_batches(df.sparkSession)
    rows = numbered(df if scanned else df.select(id_col, text), "join-rows", scanned)
    source = rows.select(F.col(RID).alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    classes_ = common_classes(source)
    signed = materialize(source.mapInPandas(_sign(classes_), f"rid long, id {id_type}, n long, digest binary, first array<long>, point binary"), "join-signed")

    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best")
    classes = signed.where("n > 0").groupBy("digest").agg(best, F.count("*").alias("copies"))
    classes = materialize(classes.select("digest", "best", F.col("best.rid").alias("node"), "copies"), "join-classes")

    heads = signed.join(classes.select(F.col("node").alias("rid")), "rid")
    # ``rest``: how much of the set comes from this shingle on
    members = materialize(heads.select(F.col("rid").alias("node"), "n", F.posexplode("first").alias("at", "bucket")).select("node", "n", (F.col("n") - F.col("at")).alias("rest"), "bucket"), "join-first")
    trees = members.groupBy("bucket").agg(F.count("*").alias("copies"), F.min("node").alias("pivot")).where("copies > 1")
    trees = materialize(trees, "join-trees")
    spread, members = members, materialize(join_hot(members, trees, ["bucket"], "copies", members.count(), ["node"]), "join-members")
    release(spread, trees)

    nodes = members.select(F.col("node").alias("rid")).distinct()
    points = materialize(signed.join(nodes, "rid").select(F.col("rid").alias("node"), "n", "point"), "join-points")
    pivots = materialize(members.groupBy("node").agg(F.min("pivot").alias("v")).where("v <> node").select(F.col("node").alias("u"), "v"), "join-pivots")
    labels = _relabelled(None, _verify(pivots, points, source))

    inside = _open(members.drop("pivot"), labels, "join-open", False)
    survived = materialize(_dealt(inside, points.select("node", "point")).mapInPandas(_best, "u long, v long, nearest boolean"), "join-survived")
    release(inside, members)
    nearest = materialize(survived.where("nearest").select("u", "v").distinct().join(pivots, ["u", "v"], "left_anti"), "join-nearest")
    labels = _relabelled(labels, _verify(nearest, points, source))
    groups = materialize(components(survived.where("NOT nearest").select("u", "v")), "join-groups")
    release(pivots, nearest, survived)

    again = groups.withColumnRenamed("label", "bucket").join(points.select("node", "n", F.col("n").alias("rest")), "node")
    inside = _open(again, labels, "join-again", True)
    nodes = materialize(inside.select("node").distinct(), "join-nodes")
    sets = _sets_of(source, nodes)
    links = _dealt(inside, points.select("node", "point").join(sets, "node")).mapInPandas(_exact, "u long, v long")
    labels = _relabelled(labels, links)
    release(groups, inside, sets, nodes, points)
    return _assign(signed, classes, labels, id_col)


def op12_count_rtree_join(spark, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents"), scanned=True).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS c, md5(array_to_string(list_sort(s), chr(10))) AS digest, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2
), shingles AS (
  SELECT c, len(s) AS n, unnest(s) AS x FROM classes
), pairs AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.c < b.c AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(a, b) AS (
  SELECT c, c FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.component END AS component_id
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND c.digest = md5(array_to_string(list_sort(s.s), chr(10)))
LEFT JOIN least l ON l.a = c.c
"""
