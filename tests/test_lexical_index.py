"""The stored index: the same scores as a scan, whatever happened to it before."""

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.operators import lexical_index, rerank, search
from tarn.operators.lexical_index import LexicalIndex, StaleIndex, bucket_of

TERMS = ["cuti", "gaji", "w3", "absent"]


def _docs(spark, rows):
    return spark.createDataFrame([(k, f, t.split() if t is not None else None) for k, f, t in rows], "k long, f string, t array<string>")


def _text(i, draw):
    return " ".join(draw.choice(["cuti", "cuti", "gaji", *[f"w{n}" for n in range(9)]]) for _ in range(draw.randint(0, 12)))


def _same(index, spark, rows, within=None):
    alive = _docs(spark, [r for r in rows.values()])
    scan = search.bm25_scan(alive.withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), "k", "t", TERMS, within=F.col("f") == "a" if within else None)
    want = {r.k: round(r.score, 9) for r in scan.collect()}
    got = {r.key: round(r.score, 9) for r in index.search(TERMS, within=F.col("f") == "a" if within else None).collect()}
    assert got == want
    many = index.search_many(spark.createDataFrame([(q, t) for q in (1, 2) for t in TERMS], "query_id int, term string"), 5)
    top = sorted(((-s, k) for k, s in want.items()))[:5] if not within else None
    best = index.search_best(spark.createDataFrame([(q, t) for q in (1, 2) for t in TERMS], "query_id int, term string"), 5)
    assert sorted((r.query_id, r.key, r.rank) for r in best.collect()) == sorted((r.query_id, r.key, r.rank) for r in many.collect())
    for q in (1, 2) if top is not None else ():
        assert sorted((-round(r.score, 9), r.key) for r in many.where(F.col("query_id") == q).collect()) == top


def test_changes_and_compaction(spark, tmp_path):
    draw = random.Random(5)
    rows = {i: (i, "ab"[i % 2], _text(i, draw)) for i in range(60)}
    rows[60], rows[61] = (60, "a", None), (61, "b", "")
    index = LexicalIndex(spark, str(tmp_path / "index")).build(_docs(spark, list(rows.values())), "k", "t", ["f"])
    _same(index, spark, rows)
    _same(index, spark, rows, within=True)
    new = {i: (i, "a", _text(i, draw) + " cuti") for i in [*range(0, 20, 3), 60, *range(100, 105)]}
    index.upsert(_docs(spark, list(new.values())), "k", "t", ["f"])
    rows |= new
    _same(index, spark, rows)
    gone = [0, 3, 5, 61, 101, 999]
    index.remove(spark.createDataFrame([(k,) for k in gone], "k long"), "k")
    rows = {k: r for k, r in rows.items() if k not in gone}
    _same(index, spark, rows, within=True)
    index.upsert(_docs(spark, [(3, "b", "gaji gaji w3")]), "k", "t", ["f"])
    rows[3] = (3, "b", "gaji gaji w3")
    _same(index, spark, rows)
    assert len(index.state().journal) == 3
    index.compact()
    assert index.state().journal == []
    _same(index, spark, rows)
    # another reader of the same folder sees the same
    assert {r.key for r in LexicalIndex(spark, str(tmp_path / "index")).search(["gaji"]).collect()} == {r.key for r in index.search(["gaji"]).collect()}


def test_of_two_writers_one_starts_again(spark, tmp_path):
    first = LexicalIndex(spark, str(tmp_path / "index")).build(_docs(spark, [(1, "a", "cuti"), (2, "a", "gaji")]), "k", "t", ["f"])
    seen = first.state()
    second = LexicalIndex(spark, first.root)
    second.remove(spark.createDataFrame([(1,)], "k long"), "k")
    first.state = lambda: seen  # what the first writer saw before
    with pytest.raises(StaleIndex):
        first.compact()
    assert [r.key for r in second.search(TERMS).collect()] == [2]


def test_hot_terms_and_no_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("k"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7)).alias("t"))
    index = LexicalIndex(spark).build(docs, "k", "t")
    got = index.search_many(spark.createDataFrame([(1, "the"), (1, "w3"), (2, "the")], "query_id int, term string"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.key) for r in got] == [(1, 3), (1, 10), (1, 17), (2, 0), (2, 1), (2, 2)]
    none = LexicalIndex(spark).build(docs.limit(0), "k", "t")
    assert none.search(["the"]).count() == 0 and none.lengths().first().n == 0
    import zlib

    assert bucket_of("é", 16) == zlib.crc32("é".encode()) % 16


def _formed(spark, rows):
    return spark.createDataFrame([(k, t.split()) for k, t in rows], "k long, t array<string>")


def test_forms_and_places(spark):
    """Words are found by any of their forms, and reranked by places as they are from the texts."""
    texts = {1: "pengajuan cuti tahunan pegawai", 2: "diajukan kemarin cuti besar kantor tahunan", 3: "gaji pokok", 4: "cuti cuti cuti", 5: "mengajukan lembur"}
    index = LexicalIndex(spark).build(_formed(spark, texts.items()), "k", "t", forms=True)
    questions = _formed(spark, [(1, "mengajukan cuti tahunan"), (2, "gaji"), (3, "absen")]).toDF("query_id", "words")
    pool = spark.createDataFrame([(q, k) for q in (1, 2, 3) for k in texts], "query_id long, key long")
    n, df = 5, {r.term: r.df for r in index.frequencies().collect()}
    idf = lambda t: math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))
    got = {(r.query_id, r.key): r.score for r in rerank.rerank_from_index(index, questions, pool).collect()}
    for q, asked in ((1, "mengajukan cuti tahunan"), (2, "gaji"), (3, "absen")):
        assert [got[q, k] for k in texts] == rerank.lexical_scores(asked, list(texts.values()), idf)
    assert got[1, 1] > got[1, 4] > 0 and got[3, 1] == 0
    index.upsert(_formed(spark, [(3, "pengajuan gaji")]), "k", "t")
    assert {r.key for r in index.search(["aju"]).collect()} == {1, 2, 3, 5}
    assert rerank.rerank_from_index(index, questions.limit(0), pool.limit(0)).count() == 0


def test_blocks_that_cannot_matter_are_not_scored(spark):
    """Equal rows, and most postings are never scored."""
    docs = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.array(F.lit("the")), F.array_repeat(F.lit("of"), (F.col("id") % 5).cast("int")), F.when(F.col("id") % 997 == 5, F.array(F.lit("rare"))).otherwise(F.array(F.lit("plain")))).alias("t"))
    index = LexicalIndex(spark).build(docs, "k", "t")
    asked = spark.createDataFrame([(1, "the"), (1, "rare"), (2, "rare"), (2, "of"), (3, "absent")], "query_id int, term string")
    seen = index.state()
    read = []
    whole = index._scored
    index._scored = lambda asked, needed, *rest: read.append(index.live(seen).join(asked.join(needed, "query_id").select("term", "block").distinct(), ["term", "block"], "left_semi").count()) or whole(asked, needed, *rest)
    best = sorted(map(tuple, index.search_best(asked, 4).select("query_id", "key", "rank").collect()))
    assert best == sorted(map(tuple, index.search_many(asked, 4).select("query_id", "key", "rank").collect())) and len(best) == 8
    assert sum(read) < 0.2 * index.live(seen).where("term IN ('the', 'of', 'rare')").count()


def test_entries_are_compacted_and_old_files_go(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "index"), most_entries=3).build(_docs(spark, [(i, "a", "cuti") for i in range(4)]), "k", "t", ["f"])
    for i in range(3):
        index.remove(spark.createDataFrame([(i,)], "k long"), "k")
    assert index.state().journal == [] and [r.key for r in index.search(["cuti"]).collect()] == [3]
    gone = index.vacuum()
    assert len(gone) == 4 and not any(os.path.exists(p) for p in gone)
    assert [r.key for r in index.search(["cuti"]).collect()] == [3] and index.state().number == 5
    index.upsert(_docs(spark, [(9, "a", "cuti")]), "k", "t", ["f"])
    assert {r.key for r in index.search(["cuti"]).collect()} == {3, 9}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    """Only postings of asked terms are dealt, and pairs of a query and a document not before each task has kept its best."""
    docs = spark.range(2000).select(F.col("id").alias("k"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id"))).alias("t"))
    index = LexicalIndex(spark).build(docs, "k", "t")
    found = index.search_many(spark.createDataFrame([(q, t) for q in range(20) for t in ("the", f"w{q}")], "query_id int, term string"), 3)
    got = sorted((r.query_id, r.rank, r.key) for r in found.collect())
    assert got == sorted((q, i + 1, (q + 7 * i) if q < 7 else i) for q in range(20) for i in range(3))
    lines = _plan(found).split("== Initial Plan ==")[0].splitlines()
    dealt = [line for line in lines if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(key#" in line for line in dealt) and not any("hashpartitioning(query_id#" in line and ", key#" in line for line in dealt)
    assert not any("hashpartitioning(term#" in line and "salt" in line for line in dealt) and any("WindowGroupLimit" in line and "Partial" in line for line in lines)


def test_a_pool_is_searched_once(spark):
    """The pool to rerank is a search over the whole index: it runs once."""
    index = LexicalIndex(spark).build(_formed(spark, [(1, "cuti tahunan"), (2, "gaji pokok")]), "k", "t", forms=True)
    questions = _formed(spark, [(1, "cuti tahunan"), (2, "gaji")]).toDF("query_id", "words")
    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    pool = spark.createDataFrame([(q, k) for q in (1, 2) for k in (1, 2)], "query_id long, key long").coalesce(1).mapInArrow(counted, "query_id long, key long")
    assert rerank.rerank_from_index(index, questions, pool).where("score > 0").count() == 2
    assert ran.value == 4


def test_keys_that_are_gone_are_broadcast(spark, tmp_path):
    """Postings are not shuffled to meet the keys that are gone, whatever Spark thinks of their size."""
    index = LexicalIndex(spark, str(tmp_path / "index")).build(_docs(spark, [(i, "a", "cuti") for i in range(6)]), "k", "t", ["f"])
    index.remove(spark.createDataFrame([(i,) for i in range(3)], "k long"), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alive = index.live()
        assert sorted(r.key for r in alive.collect()) == [3, 4, 5]
        assert "BroadcastHashJoin" in _plan(alive) and "SortMergeJoin" not in _plan(alive)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffled(spark, run):
    """(bytes, rows) that what ``run`` does writes to shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = gateway.jvm.java.util.ArrayList()
        found = sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i) for i in range(found.size())}

    before = stages()
    run()
    new = [s for k, s in stages().items() if k not in before]
    return sum(s.shuffleWriteBytes() for s in new), sum(s.shuffleWriteRecords() for s in new)


def test_postings_are_shuffled_and_stored_packed(spark, tmp_path):
    """A build shuffles far fewer rows than it has postings, a few bytes for each, and stores each once."""
    words = [F.concat(F.lit("menguji" if i % 3 else "kata"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(4000))) for i in range(60)]
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("k"), (F.col("id") % 5 == 4).alias("f"), F.array(words).alias("t"))
    index = LexicalIndex(spark, str(tmp_path / "index"))
    size, rows = _shuffled(spark, lambda: index.build(docs, "k", "t", ["f"], forms=True))
    postings = index.live().count()
    assert postings > 150_000 and rows < postings / 4 and size < 14 * postings
    assert sorted(f for f in os.listdir(index.state().base)) == ["lengths", "postings", "terms"]


@pytest.mark.parametrize("spread", [1, 3])
def test_packs_hold_every_posting(spread, monkeypatch):
    """What is packed, dealt and unpacked is what was there: documents without terms, null fields, places, and one bucket in a few parts at most."""
    monkeypatch.setattr(lexical_index, "SLICE_POSTINGS", 70)
    monkeypatch.setattr(lexical_index, "PACK_BYTES", 4000)
    batches = [pa.RecordBatch.from_pydict({"key": [f"k{b}-{i}" for i in range(9)], "f": [None, b, 2] * 3, "tokens": pa.array([[], *[[f"w{i * b % 7}", "é", "mengajukan", f"x{i}"] * b for i in range(8)]], pa.list_(pa.string()))}) for b in range(6)]
    made = [p for b in batches for p in lexical_index._counted(b, True)]
    packs = [lexical_index._packed(held, 8, spread, 5) for held in lexical_index._gathered(iter(made))]
    assert len(packs) > 1 and {p for b in packs for p in b["part"].to_pylist()} <= set(range(5))
    got = list(lexical_index._unpacked(iter(packs)))
    assert max(b.num_rows for b in got) <= 70 and got[0].schema.equals(made[0].schema)
    rows = lambda found: sorted((r["key"], str(r["term"]), str(r)) for b in found for r in b.to_pylist())
    assert rows(got) == rows(made)
    where = {}
    for part, pack in ((p, k) for b in packs for p, k in zip(b["part"].to_pylist(), b["postings"], strict=True)):
        for term in pa.ipc.open_stream(pack.as_buffer()).read_all()["term"].to_pylist():
            where.setdefault(-1 if term is None else bucket_of(term, 8), set()).add(part)
    assert len(where) > 5 and max(map(len, where.values())) == spread
    assert list(lexical_index._gathered(iter([]))) == [] and list(lexical_index._unpacked(iter([]))) == []


def test_only_needed_blocks_are_shuffled(spark, tmp_path, monkeypatch):
    """Scoring deals the postings of blocks that a query needs; bounds know what is shown and what is gone."""
    docs = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("f"), F.array_repeat(F.lit("cuti"), 1 + (F.col("id") % 4).cast("int")).alias("t"))
    index = LexicalIndex(spark, str(tmp_path / "index")).build(docs, "k", "t", ["f"])
    seen = index.state()
    asked = index._weighted(spark.createDataFrame([(1, "cuti"), (2, "cuti")], "query_id int, term string"), seen)
    needed = spark.createDataFrame([(1, 0), (2, 3)], "query_id int, block int")
    held = {r.block: r["count"] for r in index.live(seen).groupBy("block").count().collect()}
    scored = index._scored(asked, needed, seen, None)
    assert scored.groupBy("query_id").count().orderBy("query_id").collect() == [(1, held[0]), (2, held[3])]
    assert _shuffled(spark, scored.collect)[1] < 0.2 * 3000
    monkeypatch.setattr(lexical_index, "TASK_POSTINGS", 100)
    every = index._scored(asked, index.live(seen).selectExpr("1 AS query_id", "block").distinct(), seen, None)
    assert "Exchange hashpartitioning(block#" in _plan(every) and f", {3000 // 100}), REPARTITION_BY_NUM" in _plan(every)
    bound = lambda within=None: index._bounds(asked, index.state(), within).agg(F.max("bound")).first()[0]
    whole = bound()
    assert bound(F.col("f") == "a") < whole  # k % 4 = 3 is not shown
    index.remove(docs.where("k % 4 = 3").select("k"), "k")
    assert bound() < whole
