"""Results stay the same when the splits of a scan change between an operator's steps, as they do when executors come and go."""

from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import tarn.session
from tarn.llm import exact_dedup, mixing, near_dedup, sharding

SPLITS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    text = lambda i: " ".join(f"w{(i * k) % 91}" for k in range(1, 60))
    rows = [(i if i % 11 else None, text(i % 150), ["a", "b", None][i % 3]) for i in range(500)]
    rows += [(7, text(7) + " more", "a"), (7, text(7) + " more", "a")]
    path = str(tmp_path_factory.mktemp("splits") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.option("parquet.block.size", "8192").parquet(path)
    return path


@contextmanager
def changing(spark, monkeypatch):
    """Other splits for every scan that follows a write."""
    turn = [0]
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    write = tarn.session.materialize

    def turned(df, name, path=None):
        out = write(df, name, path)
        turn[0] += 1
        size = ["8k", "128m", "24k"][turn[0] % 3]
        for key, value in zip(SPLITS, (size, "1k", str([2, 16, 5][turn[0] % 3])), strict=True):
            spark.conf.set(key, value)
        return out

    with monkeypatch.context() as patched:
        for module in (tarn.session, exact_dedup, near_dedup, mixing, sharding, tarn.llm._common, tarn.llm.components):
            patched.setattr(module, "materialize", turned)
        yield turn
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _rows(df, *cols):
    return Counter(map(tuple, df.select(*cols).collect()))


def test_dedup_whatever_the_splits(spark, docs, monkeypatch):
    read = lambda: spark.read.parquet(docs)
    joined = lambda: read().join(spark.range(1).withColumnRenamed("id", "one"), F.lit(True)).drop("one")
    jobs = {
        "op2": lambda: _rows(exact_dedup.decide(read()), "doc_id", "keep_id", "group_size", "kept"),
        "op5": lambda: _rows(near_dedup.decide(read()), "doc_id", "n_shingles", "component_id", "kept"),
        "exact": lambda: _rows(exact_dedup.drop_copies(joined()), "text"),
        "exact, scanned": lambda: _rows(exact_dedup.drop_copies(read(), scanned=True), "text"),
        "near, scanned": lambda: _rows(near_dedup.drop_near_copies(read(), scanned=True), "text"),
    }
    for name, job in jobs.items():
        want = job()
        with changing(spark, monkeypatch) as turn:
            assert job() == want, name
            assert turn[0] > 1


@pytest.mark.parametrize("scanned", [False, True])
def test_mix_and_shards_whatever_the_splits(spark, docs, monkeypatch, scanned):
    read = lambda: spark.read.parquet(docs)
    known = F.col("doc_id").isNotNull()
    mix, place = lambda: mixing.mix_sources(read(), scanned=scanned), lambda: sharding.histogram_shards(read(), 7, scanned=scanned)
    want, sizes = _rows(mix().where(known), "doc_id", "text"), mix().count()
    shards = _rows(place().where("doc_id IS NOT NULL AND doc_id <> 7"), "doc_id", "shard")
    with changing(spark, monkeypatch):
        mixed = mix()
        assert mixed.count() == sizes and _rows(mixed.where(known), "doc_id", "text") == want
        placed = place().select("doc_id", "shard", "slot").collect()
    assert len(placed) == 502
    for shard in range(7):
        mine = sorted(r.slot for r in placed if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert Counter((r.doc_id, r.shard) for r in placed if r.doc_id not in (None, 7)) == shards
