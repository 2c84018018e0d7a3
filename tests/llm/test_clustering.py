"""Kd-tree filtering against plain assignment, on small tables with nulls, ties, repeats and huge numbers."""

import hashlib

import numpy as np
import pytest

from tarn.llm import clustering
from tarn.llm.clustering import Filter, Tree, plant

SCHEMA = "vec_id long, embedding array<float>, cluster string, ids string"


def _plain(rows, clusters, rounds, dims, scale=64):
    """(id, vector) pairs by the definition, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    return sorted(((i, nearest(v)[1], nearest(v)[0], tuple(centroids[nearest(v)[1]])) for i, v in kept), key=repr)


def _rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(c, 0.4, 4).tolist()) for i, c in enumerate(rng.integers(-3, 4, 400))]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(300)]  # one vector that is common
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan"), 0.0, 0.0, 0.0]), (2005, [0.0, float("-inf"), 0.0, 0.0])]
    return rows


@pytest.mark.parametrize(("clusters", "rounds"), [(1, 1), (5, 0), (16, 3), (5000, 2)])
def test_as_by_the_definition(spark, clusters, rounds):
    rows = _rows()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = clustering.cluster(df, "vec_id", "embedding", clusters, rounds, 4).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got), key=repr) == _plain(rows, clusters, rounds, 4)
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    assert all(r.cluster_inertia == sum(s.distance for s in got if s.cluster == r.cluster) for r in got)


def test_odd_tables(spark):
    one = lambda rows: clustering.cluster(spark.createDataFrame(rows, SCHEMA), "vec_id", dims=2)
    assert one([]).collect() == [] and one([]).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert one([(1, None, None, None), (None, [None, None], None, None)]).collect() == []
    huge = one([(1, [3e38, -3e38], None, None), (2, [0.0, 0.0], None, None)]).collect()
    assert sorted((r.vec_id, r.distance) for r in huge) == [(1, 0), (2, 0)] and max(max(r.centroid) for r in huge) == clustering.LARGEST


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 26])
def test_a_tree_decides_like_each_vector_alone(size):
    rng = np.random.default_rng(size)
    vectors = rng.integers(-size, size + 1, (600, 6))
    centroids = np.concatenate([rng.integers(-size, size + 1, (6, 6)), vectors[:3], vectors[:2]])  # the last two tie with others
    tree, place = plant(vectors, 8)
    assert (tree.vectors == vectors[place]).all() and tree.total[0].tolist() == vectors.sum(axis=0).tolist()
    tree = Tree.load(*tree.dump(), 6)
    found = Filter(tree, centroids)
    far = ((tree.vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    near, distance = found.assigned()
    assert (near == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    count, total = found.sums()
    assert count.tolist() == np.bincount(near, minlength=11).tolist()
    assert all((total[c] == tree.vectors[near == c].sum(axis=0)).all() for c in range(11))


def test_far_centroids_are_pruned_and_nodes_assigned_whole():
    rng = np.random.default_rng(1)
    spots = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    vectors = np.concatenate([s + rng.integers(-20, 20, (200, 2)) for s in spots])
    found = Filter(plant(vectors)[0], spots)
    assert not len(found.places)  # nothing was looked at alone
    assert sum(len(n) for n, _ in found.whole) < 20
