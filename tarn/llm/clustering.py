"""Centroid clustering by kd-tree filtering, in exact integers.

Each task packs its vectors into kd-trees of a bounded size and writes them once:
a node holds how many vectors are below it, their sum and their box.  In a round
every tree passes its nodes down with the centroids that may still be nearest.
The centroid nearest to a box's middle rules the box; another one goes where the
corner of the box that favours it most is strictly nearer to the ruler.  A node
with one centroid left is assigned whole, by its count and sum; leaves that still
have several are resolved vector by vector.  Only sums leave a task, at most one
row for each centroid, and are added up component by component.

All numbers are integers: boxes and products run in float64 where 53 bits hold
them, else in int64.  Equal distances go to the centroid of the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import read, small_batches
from tarn.session import materialize, release

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors in one tree, and in a leaf.
TREE_ROWS, LEAF_ROWS = 2048, 16
#: Components are held to this size, so that squared distances of 64 components fit 63 bits.
LARGEST = 1 << 27
#: Sums of products up to this size are exact in float64.
_EXACT = 1 << 53
#: Bytes of trees in one Arrow batch.
BATCH_BYTES = 32 << 20
TREES = "ids array<string>, vectors binary, nodes binary"


def integer_vectors(df: DataFrame, id_col: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id as a string, which pandas leaves as it is, vector array<int>): floor(scale * x) of the vectors with exactly ``dims`` components, none null or non-finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), v * F.lit(float(scale))))).cast("int"))
    return df.where(F.coalesce(F.size(x) == dims, F.lit(False))).where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("string").alias("id"), whole.alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose ``1:<id>`` has the smallest sha256; without identifier they come last, equal hashes go by the vector."""
    place = F.sha2(F.concat(F.lit("1:"), F.col("id")).cast("binary"), 256)
    rows = vectors.select(place.alias("place"), "vector").orderBy(F.col("place").asc_nulls_last(), "vector").limit(clusters).collect()  # k rows
    return np.array([r.vector for r in rows], dtype=np.int64)


# ---- one tree


@dataclass
class Tree:
    """Vectors in tree order, and the nodes in preorder."""

    vectors: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray  # the left child's number, -1 in a leaf
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    def dump(self) -> tuple[bytes, bytes]:
        links = np.stack([self.start, self.end, self.left, self.right], axis=1).astype("<i8")
        return self.vectors.astype("<i4").tobytes(), np.concatenate([links, self.low, self.high, self.total], axis=1).astype("<i8").tobytes()

    @staticmethod
    def load(vectors: bytes, nodes: bytes, dims: int) -> Tree:
        table = np.frombuffer(nodes, dtype="<i8").reshape(-1, 4 + 3 * dims)
        links = table[:, :4].T
        parts = (table[:, 4 + k * dims : 4 + (k + 1) * dims] for k in range(3))
        return Tree(np.frombuffer(vectors, dtype="<i4").reshape(-1, dims).astype(np.int64), *links, *parts)


def plant(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
    """A tree over ``vectors``, split at the middle of the widest side; and the vectors' places in tree order."""
    place = np.arange(len(vectors))
    rows: list[list[int]] = []
    low, high, total = [], [], []
    stack = [(0, len(vectors), -1, 0)]
    while stack:
        start, end, parent, side = stack.pop()
        mine = vectors[place[start:end]]
        me = len(rows)
        rows.append([start, end, -1, -1])
        if parent >= 0:
            rows[parent][2 + side] = me
        low.append(mine.min(axis=0))
        high.append(mine.max(axis=0))
        total.append(mine.sum(axis=0))
        width = high[-1] - low[-1]
        wide = int(width.argmax())
        if end - start > leaf_rows and width[wide]:  # equal vectors are one leaf, however many
            half = (end - start) // 2
            place[start:end] = place[start:end][np.argpartition(mine[:, wide], half, kind="introselect")]
            stack += [(start + half, end, me, 1), (start, start + half, me, 0)]
    links = np.array(rows, dtype=np.int64).T
    return Tree(vectors[place], *links, np.array(low), np.array(high), np.array(total)), place


def _exactly(*arrays: np.ndarray) -> type:
    """float64 where eight times any sum of products of such numbers stays exact, else int64."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return np.float64 if 8 * arrays[0].shape[-1] * most * most < _EXACT else np.int64


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less the points' own squares: what differs between centroids."""
    kind = _exactly(points, centroids)
    p, c = points.astype(kind), centroids.astype(kind)
    return (c * c).sum(axis=1)[None, :] - 2 * (p @ c.T)


class Filter:
    """One pass of a tree under given centroids."""

    def __init__(self, tree: Tree, centroids: np.ndarray):
        self.tree, self.centroids = tree, centroids
        #: (node, centroid) of nodes assigned whole; places of vectors resolved alone, and their centroids.
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []
        self.places, self.nearest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._run()

    def _run(self) -> None:
        tree, k = self.tree, len(self.centroids)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), dtype=bool)
        leaves: list[tuple[np.ndarray, np.ndarray]] = []
        while len(nodes):
            open_ = self._narrowed(nodes, open_)
            one = open_.sum(axis=1) == 1
            self.whole.append((nodes[one], open_[one].argmax(axis=1)))
            nodes, open_ = nodes[~one], open_[~one]
            leaf = tree.left[nodes] < 0
            leaves.append((nodes[leaf], open_[leaf]))
            nodes, open_ = nodes[~leaf], open_[~leaf]
            nodes, open_ = np.concatenate([tree.left[nodes], tree.right[nodes]]), np.concatenate([open_, open_])
        nodes, open_ = (np.concatenate(x) for x in zip(*leaves, strict=True))
        if len(nodes):
            size = tree.end[nodes] - tree.start[nodes]
            self.places = np.repeat(tree.start[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            far = distances(tree.vectors[self.places], self.centroids)
            far[~np.repeat(open_, size, axis=0)] = np.iinfo(np.int64).max if far.dtype == np.int64 else np.inf
            self.nearest = far.argmin(axis=1)  # the first of equals

    def _narrowed(self, nodes: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """The centroids of each node but for those strictly dominated over its whole box."""
        low, high, c = self.tree.low[nodes], self.tree.high[nodes], self.centroids
        kind = _exactly(low, high, c)
        low, high, c = low.astype(kind), high.astype(kind), c.astype(kind)
        square = (c * c).sum(axis=1)
        middle = square[None, :] - (low + high) @ c.T  # twice the middle, so no halves
        middle[~open_] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
        ruler = middle.argmin(axis=1)
        out = open_.copy()
        for r in np.unique(ruler):
            mine = ruler == r
            away = c - c[r]  # towards each other centroid
            best = high[mine] @ np.maximum(away, 0).T + low[mine] @ np.minimum(away, 0).T
            out[mine] &= ~((square - square[r])[None, :] - 2 * best > 0)
        return out

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) by centroid."""
        count, total = np.zeros(len(self.centroids), np.int64), np.zeros(self.centroids.shape, np.int64)
        for nodes, near in self.whole:
            np.add.at(count, near, self.tree.end[nodes] - self.tree.start[nodes])
            np.add.at(total, near, self.tree.total[nodes])
        np.add.at(count, self.nearest, 1)
        np.add.at(total, self.nearest, self.tree.vectors[self.places])
        return count, total

    def assigned(self) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance, in tree order."""
        near = np.zeros(len(self.tree.vectors), np.int64)
        for nodes, centroid in self.whole:
            for n, c in zip(nodes.tolist(), centroid.tolist(), strict=True):
                near[self.tree.start[n] : self.tree.end[n]] = c
        near[self.places] = self.nearest
        gap = self.tree.vectors - self.centroids[near]
        return near, (gap * gap).sum(axis=1)


# ---- Spark


def plant_trees(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """Trees of ``TREE_ROWS`` vectors at most, as they lie in the input's tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = [], []

        def grown(n: int) -> pd.DataFrame:
            tree, place = plant(np.array(rows[:n], dtype=np.int64))
            mine = [ids[i] for i in place]
            del ids[:n], rows[:n]
            packed, nodes = tree.dump()
            return pd.DataFrame({"ids": [mine], "vectors": [packed], "nodes": [nodes]})

        for pdf in batches:
            ids += pdf["id"].tolist()
            rows += pdf["vector"].tolist()
            while len(rows) >= TREE_ROWS:
                yield grown(TREE_ROWS)
        if rows:
            yield grown(len(rows))

    small_batches(vectors.sparkSession)
    return vectors.mapInPandas(run, TREES)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of what each got; one that got nothing stays."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for pdf in batches:
            for vectors, nodes in zip(pdf["vectors"], pdf["nodes"], strict=True):
                n, s = Filter(Tree.load(vectors, nodes, dims), centroids).sums()
                count, total = count + n, total + s
        got = np.flatnonzero(count)
        if len(got):
            yield pd.DataFrame({"cluster": got.astype(np.int32), "n": count[got], "total": [total[c] for c in got]})

    parts = trees.select("vectors", "nodes").mapInPandas(run, "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "at").agg(wide("n").alias("n"), wide("part").alias("total")).collect():  # k * dims rows
        out[r.cluster, r["at"]] = int(r.total) // int(r.n)
    return out


def assign(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, vectors, nodes in zip(pdf["ids"], pdf["vectors"], pdf["nodes"], strict=True):
                near, far = Filter(Tree.load(vectors, nodes, dims), centroids).assigned()
                yield pd.DataFrame({"id": pd.Series(list(ids), dtype=object), "cluster": near.astype(np.int32), "distance": far})

    return trees.mapInPandas(run, "id string, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "doc_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector of ``df``: ``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` (array of integers).

    Vectors that are null, of another length, or hold a null or a number that
    is not finite are left out.  Repeated rows count as often as they stand;
    rows without identifier take part, but become first centroids only where
    too few others do.  Fewer vectors than ``clusters`` make fewer centroids; an
    empty table gives no rows.  Other columns are not passed on, so none can
    clash.  Components beyond 2**27 count as 2**27, so that a squared distance
    fits a long; a sum of distances beyond a long is its largest value.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    vectors = integer_vectors(df, id_col, vector, dims, scale)
    trees = materialize(plant_trees(vectors, dims), "kd-trees")
    now = first_centroids(vectors, clusters)
    if not len(now):
        none = vectors.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")))
        return none.withColumn("centroid", F.array().cast("array<long>")).limit(0)
    for _ in range(rounds):
        now = moved(trees, now)
    found = materialize(assign(trees, now), "clustered")
    release(trees)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # k rows
    inertia = {r.cluster: int(r.n) for r in sums}
    held = lambda n: min(n, (1 << 63) - 1)
    told = [(c, held(inertia[c]), held(sum(inertia.values())), now[c].tolist()) for c in sorted(inertia)]
    heads = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(heads), "cluster").select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_sha256(centroid: Column) -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ",").cast("binary"), 256)


def op11_kdtree_clusters(spark, sf_dir: str) -> DataFrame:
    found = cluster(read(spark, sf_dir, "embeddings"), "vec_id")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_sha256(F.col("centroid")).alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    """CTEs ``c0`` to ``c<rounds>`` (number, vector) of centroids, and ``a<i>`` (the nearest of ``c<i>``, squared distance) of all vectors."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (
  SELECT p.row, p.vec_id, p.v, min({{'d': list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, c.v)])::BIGINT, 'c': c.k}}) AS best
  FROM kept p, c{i} c GROUP BY p.row, p.vec_id, p.v
)""")
        if i < rounds:
            out.append(f"""s{i} AS (
  SELECT best.c AS k, j.j, sum(v[j.j]) AS total, count(*) AS n FROM a{i}, range(1, {DIMS + 1}) AS j(j) GROUP BY 1, 2
), m{i} AS (
  SELECT k, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY k
), c{i + 1} AS (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k
)""")
    return ",\n".join(out)


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM kept
  ORDER BY k LIMIT {CLUSTERS}
), {_rounds_sql(ROUNDS)}
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance,
       (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.best.c
"""
