"""Stored chunks, retention, rolling counts and crawls beyond what the registered queries cover."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.operators import crawl, logs, unanswered
from tarn.operators.ball_index import BallIndex
from tarn.operators import chunk_store
from tarn.operators.chunk_store import ChunkStore
from tarn.streaming import events

CHUNKS = "organization_id string, knowledge_base_id string, document_id string, chunk_id string, content string"


def _chunk(doc, n, text, org="o", kb="k"):
    return (org, kb, doc, f"chunk_{n:04d}", text)


def _rows(store):
    return sorted(map(tuple, store.read().collect()), key=repr)


def test_changes_touch_their_buckets_only(spark, tmp_path):
    rows = [_chunk(f"d{d}", n, f"{d} {n}") for d in range(60) for n in range(3)] + [_chunk("d1", 0, "other", kb=None)]
    make = lambda x: spark.createDataFrame(x, CHUNKS)
    store = ChunkStore(spark, str(tmp_path / "s")).create(make(rows), 12)
    assert _rows(store) == sorted(rows, key=repr)

    before = store.files()
    touched = store.replace_documents(make([_chunk("d5", 0, "five"), _chunk("new", 0, "new")]))
    rows = [r for r in rows if r[2] != "d5"] + [_chunk("d5", 0, "five"), _chunk("new", 0, "new")]
    assert _rows(store) == sorted(rows, key=repr) and len(touched) <= 2
    changed = before ^ store.files()
    assert changed and {f.split("/")[0] for f in changed} <= {f"bucket={b}" for b in touched}

    before = store.files()
    touched = store.upsert(make([_chunk("d7", 1, "seven"), _chunk("d7", 9, "nine"), _chunk("d8", 0, "x", org=""), _chunk("d1", 0, "null", kb=None)]))
    rows = [r for r in rows if r[:4] not in (("o", "k", "d7", "chunk_0001"), ("o", None, "d1", "chunk_0000"))] + [_chunk("d7", 1, "seven"), _chunk("d7", 9, "nine"), _chunk("d1", 0, "null", kb=None)]
    assert _rows(store) == sorted(rows, key=repr)
    assert {f.split("/")[0] for f in before ^ store.files()} == {f"bucket={b}" for b in touched}

    store.delete_documents(make([_chunk("absent", 0, "")]))
    assert _rows(store) == sorted(rows, key=repr)
    assert store.delete_documents(make([])) == [] and store.upsert(make([])) == []
    store.delete_documents(make(rows))
    assert _rows(store) == [] and store.files() == set()
    store.upsert(make([_chunk("d", 0, "again")]))
    assert _rows(store) == [_chunk("d", 0, "again")]


def test_purge_keeps_the_newest(spark):
    draw, start = random.Random(3), datetime(2024, 1, 1)
    at = [start + timedelta(seconds=draw.choice([5, 5, draw.randint(0, 100_000)])) for _ in range(3000)]
    rows = [(f"o{min(2, i % 9)}", "k", f"q{i:05d}", t, i) for i, t in enumerate(at)] + [("small", "k", "q", start, 0)]
    table = spark.createDataFrame(rows, "organization_id string, knowledge_base_id string, query_key string, last_seen timestamp, count long")
    since = start + timedelta(seconds=2)
    for newest in (1, 100, 5000):
        got = unanswered.purge(table, since, newest)
        assert got.columns == table.columns
        want = []
        for org in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == org and r[3] >= since), key=lambda r: (-r[3].timestamp(), r[1], r[2]))
            want += mine[:newest]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert unanswered.purge(table.limit(0), since, 3).count() == 0


def test_counts_of_the_last_minute(spark):
    draw, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, draw.choice("aab"), start + timedelta(milliseconds=draw.choice([0, 60_000, 120_000, draw.randint(0, 600_000)]))) for i in range(800)]
    log = spark.createDataFrame(rows, "id long, client_ip string, ts timestamp")
    got = {r.id: r.n for r in logs.in_last(log, "client_ip", 60, "n").collect()}
    assert got == {i: sum(c == c2 and timedelta(0) <= t - t2 <= timedelta(seconds=60) for _, c2, t2 in rows) for i, c, t in rows}


def test_crawls_go_as_deep_as_asked(spark):
    links = spark.createDataFrame([(f"http://h/{i}", f"http://h/{i + 1}") for i in range(10)], "src string, dst string")
    starts = spark.createDataFrame([("http://h/0",)], "url string")
    depth = lambda *a: {r.url: r.depth for r in crawl.reach(links, starts, *a).collect()}
    assert max(depth(8).values()) == 8 and max(depth().values()) == crawl.MAX_DEPTH and max(depth(50).values()) == 10


def test_a_search_looks_at_fourteen_columns(spark):
    names = [*logs.SEARCHED, "credential", "method", "country"]
    log = spark.createDataFrame([(i, *["needle_1" if n == name else "x" for n in names]) for i, name in enumerate(names)], "id long, " + ", ".join(f"{n} string" for n in names))
    assert len(logs.SEARCHED) == 14
    assert {r.id for r in logs.filtered(log, search="NEEDLE_").collect()} == set(range(14))
    assert logs.filtered(log, search="needleX1").count() == 0 and logs.filtered(log.where(F.lit(False)), search="x").count() == 0


def test_balls_skip_cells_and_lose_nothing(spark):
    rng = np.random.default_rng(8)
    spots = rng.normal(0, 10, (12, 6))
    vectors = [(i, (spots[i % 12] + rng.normal(0, 0.3, 6)).tolist()) for i in range(1200)] + [(5000, None), (5001, [0.0] * 6), (5002, [0.0] * 6)]
    table = spark.createDataFrame(vectors, "k long, v array<double>")
    asked = table.where("k % 40 = 0 AND v IS NOT NULL").toDF("query_id", "query_vector")
    stats = {}
    got = BallIndex(spark).build(table, "k", "v", 24).search_many(asked, 7, stats)
    kept = [(k, np.array(v)) for k, v in vectors if v is not None]
    want = []
    for q, x in kept:
        if q % 40 == 0:
            order = sorted((-float(v @ x), k) for k, v in kept if k != q)[:7]
            want += [(q, k, n) for n, (_, k) in enumerate(order, 1)]
    assert sorted((r.query_id, r.key, r["rank"]) for r in got.collect()) == sorted(want)
    assert stats["read"] < 0.5 * stats["all"]
    few = BallIndex(spark).build(table.where("k < 3"), "k", "v")
    assert few.search_many(asked.where("query_id = 0"), 7).count() == 2
    assert BallIndex(spark).build(table.limit(0), "k", "v").search_many(asked, 7).count() == 0


def test_a_writer_counts_what_it_drops(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[(1, 0), (2, 30), (-3, 20)], [(4, 5), (5, 19), (6, 21), (7, None)], [(8, 22), (-9, None), (10, 60)], [(11, 40), (12, 55)]]
    schema = "id long, ts timestamp"

    def run():
        stream = events.read_stream(spark, str(tmp_path / "in"), StructType.fromDDL(schema), 1)
        events.write_counted(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), F.col("id") > 0).awaitTermination()

    for rows in batches:
        made = spark.createDataFrame([(i, None if m is None else start + timedelta(minutes=m)) for i, m in rows], schema)
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()  # goes on where the last run ended
    counts = spark.read.schema(events.COUNTS).parquet(str(tmp_path / "out-counts")).orderBy("batch").collect()
    assert [(r.came, r.written, r.late, r.refused) for r in counts] == [(3, 2, 0, 1), (4, 1, 2, 1), (3, 2, 0, 1), (2, 1, 1, 0)]
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 6, 8, 10, 12]


def test_a_change_writes_stored_chunks_once(spark, tmp_path, monkeypatch):
    """Only what is new is kept beside the store; a bucket that ends empty goes, and null keys are keys."""
    beside, write = [], chunk_store.materialize
    monkeypatch.setattr(chunk_store, "materialize", lambda df, name: beside.append((name, df.count())) or write(df, name))
    make = lambda rows: spark.createDataFrame(rows, "organization_id string, knowledge_base_id string, document_id string, chunk_id string, content string")
    rows = [("o", None if i % 3 else "k", f"d{i}", f"c{j}", f"{i} {j}") for i in range(40) for j in range(3)]
    store = ChunkStore(spark, str(tmp_path / "s")).create(make(rows), 16)
    store.replace_documents(make([("o", None, "d1", "c9", "new"), ("o", None, "d1", "c9", "new")]))
    store.upsert(make([("o", "k", "d3", "c0", "first"), ("o", None, "d3", "c0", "of another base")]))
    store.delete_documents(make([(*r[:3], "", "") for r in rows if r[2] not in ("d1", "d3")]))
    expected = [("o", None, "d1", "c9", "new")] * 2 + [("o", "k", "d3", "c0", "first"), ("o", "k", "d3", "c1", "3 1"), ("o", "k", "d3", "c2", "3 2"), ("o", None, "d3", "c0", "of another base")]
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted(expected, key=repr)
    assert beside == [("new-chunks", 2), ("new-chunks", 2), ("doomed-documents", 38)]
    assert len({f.split("/")[0] for f in store.files()}) <= 3
