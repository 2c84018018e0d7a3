"""The n-gram join against all pairs, on small tables with nulls, ties, repeats and clashing names; its R-tree against plain bounds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import ngram_join
from tarn.llm.ngram_join import RTree, at_least, linked, point, prefix, prefix_length

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, bucket string, node string, Component_ID string"


def _set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}


def _expected(rows):
    sets = [_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 90 * (len(a) + len(b) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((doc, len(sets[i]), known[root(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def _rows():
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(400)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    rows, base, passage = [], text(90), text(25)
    for _ in range(120):  # a loose group: many are close to the base, some to each other only
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(90)] = draw.choice(words)
        rows.append(" ".join(copy))
    chain = text(80)
    for i in range(8):  # neighbours are linked, ends are not
        chain = list(chain)
        chain[4 + 9 * i] = f"new{i}"
        rows.append(" ".join(chain))
    rows += [" ".join([*text(draw.randint(0, 40)), *passage, *text(draw.randint(0, 40))]) for _ in range(60)]
    rows += [" ".join(text(draw.randint(1, 60))) for _ in range(60)]
    rows += ["same text here twice", "Same TEXT here\ttwice", "a b", "A\nb", "one", "one", "", " ", None, "é É", "É É", " ".join(text(20_000))]
    out = [(1000 - i, t) for i, t in enumerate(rows)]
    return [*out, (5, rows[3]), (5, rows[3]), (None, rows[0]), (None, "only without identifier of its kind"), (None, None)]


@pytest.mark.parametrize("blocks", [(1024, 2048, 4_000_000), (7, 11, 900)])
def test_as_by_all_pairs(spark, tmp_path, monkeypatch, blocks):
    for name, size in zip(("BLOCK_A", "BLOCK_B", "BLOCK_SHINGLES"), blocks, strict=True):
        monkeypatch.setattr(ngram_join, name, size)
    rows = _rows()
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/d")
    got = ngram_join.decide(spark.read.parquet(f"{tmp_path}/d"), scanned=True).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == _expected(rows)
    for c in {r.component_id for r in got if r.component_id is not None}:
        assert sum(r.kept for r in got if r.component_id == c and r.n_shingles) <= 1
    empty = spark.read.parquet(f"{tmp_path}/d").where(F.lit(False))
    assert ngram_join.decide(empty).collect() == []


@pytest.mark.parametrize("n", [1, 15, 16, 17, 500])
def test_a_search_finds_what_bounds_allow(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 6, 32)
    points = np.maximum(0, base + rng.integers(-1, 2, (n, 32)) * (rng.random((n, 32)) < rng.random((n, 1)))).astype("<u4")
    tree = RTree.pack(points)
    for q in points[:40]:
        at, bound = tree.search(q)
        plain = np.minimum(points, q).sum(axis=1)
        sizes, mine = points.sum(axis=1), int(q.sum())
        may = [i for i in range(n) if 190 * plain[i] >= 90 * (mine + sizes[i]) and plain[i] and 90 * sizes[i] <= 100 * mine and 100 * sizes[i] >= 90 * mine]
        assert sorted(at.tolist()) == may and (bound == plain[at]).all()


def test_linked_sets_meet_and_pass_the_bound():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 3, 1 << 10).astype(np.uint8)
    met = 0
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 5), dtype=np.uint64)])) for _ in range(2))
        if linked(a, b):
            met += 1
            assert len(np.intersect1d(prefix(a, classes), prefix(b, classes)))
            assert len(RTree.pack(point(a)[None]).search(point(b))[0]) == 1
    assert met > 200
    assert [prefix_length(n) for n in (0, 1, 9, 10, 11, 20)] == [0, 1, 1, 2, 2, 3] and at_least(11) == 10


def test_what_is_common_comes_last(spark):
    rows = [(i, f"common words that all texts have in them {i} x{i} y{i} z{i}") for i in range(3000)]
    source = spark.createDataFrame(rows, "id long, text string")
    classes = ngram_join.common_classes(source, 12)
    s = next(ngram_join.shingle_sets([rows[0][1]], 3))
    shared = np.intersect1d(s, next(ngram_join.shingle_sets([rows[1][1]], 3)))
    assert not len(np.intersect1d(prefix(s, classes), shared)) and len(shared) == 6
