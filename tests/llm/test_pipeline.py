"""The pipeline and the registered queries against brute force, on the smallest tables."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tarn.llm import language

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[k : k + 4]) for k in range(len(words) - 3)) if len(words) > 3 else frozenset([tuple(words)] if words else [])


def _fit_targets(sizes, weights, most=3):
    """Water filling, source by source."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            targets[i] = most * sizes[i] if over else left * weights[i] / weight
        left -= sum(targets[i] for i in over)
        free = [i for i in free if over and i not in over]
    return targets


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            s, t = sets[a], sets[b]
            if s and 100 * len(s & t) >= 80 * len(s | t):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return {i: find(i) for i in ids}, sets


def exact_groups(texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    return [(min(g, key=lambda i: (-len(texts[i] or ""), i)), g) for g in groups.values()]


def test_pipeline_equals_brute_force(spark, docs):
    kept = language.keep_known(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
    texts = {i: texts[i] for i, _ in exact_groups(texts)}
    labels, _ = components(texts)
    texts = {i: t for i, t in texts.items() if labels[i] == i}

    sizes = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    sources = sorted({docs[i].source for i in texts}, key=lambda s: (s is None, (s or "").encode()))
    whole = [sum(n for i, n in sizes.items() if docs[i].source == s) for s in sources]
    targets = dict(zip(sources, _fit_targets(whole, [(5, 2, 1)[k % 3] for k in range(len(sources))]), strict=True))

    got = corpus_pipeline.run(spark, SMALL).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    for source in sources:
        taken = sum(n * sizes[i] for i, n in copies.items() if docs[i].source == source)
        assert abs(taken - targets[source]) <= max([sizes[i] for i in texts if docs[i].source == source])
    encode = encoding().encode_ordinary
    for r in got:
        ids = encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_write_and_reread(spark, tmp_path):
    found = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, found, SMALL).write.parquet(str(tmp_path / str(i)))
        found = spark.read.parquet(str(tmp_path / str(i)))
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"] and found.count()


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ops_on_the_smallest_tables(spark, docs):
    run = lambda name: __spark_entry__.queries()[name](spark, SMALL).toPandas()
    texts = {i: r.text for i, r in docs.items()}

    shards = run("op1_histogram_shards")
    assert sorted(shards.doc_id) == sorted(docs) and set(shards.law) == {"bytes"} and set(shards.shard) <= set(range(40))
    import zlib

    assert all(zlib.crc32((texts[r.doc_id] or "").encode()) == r.text_crc32 for r in shards.itertuples())

    exact = run("op2_exact_dedup").set_index("doc_id")
    for best, members in exact_groups(texts):
        for i in members:
            assert (exact.keep_id[i], exact.group_size[i], exact.kept[i]) == (best, len(members), i == best)

    coded, encode = run("op4_byte_bpe").set_index("doc_id"), encoding().encode_ordinary
    assert all(coded.n_tokens[i] == len(encode(t or "")) for i, t in texts.items())

    near = run("op5_near_dedup").set_index("doc_id")
    labels, sets = components(texts)
    assert all((near.component_id[i], near.n_shingles[i], near.kept[i]) == (labels[i], len(sets[i]), labels[i] == i) for i in texts)

    tagged = run("op9_language_spans").set_index("doc_id")
    assert all(tagged.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in texts)
    assert np.mean([tagged.lang_pred[i] == docs[i].lang for i in texts if tagged.held_out[i]]) > 0.95

    assert len(run("op3_mix_sources")) == len(run("op6_importance_resampling")) == len(run("op8_secret_scan")) == len(run("op10_quality_rules")) == len(docs)
