"""Every corpus operator against a brute-force version, on small tables with nulls, ties, repeats and clashing names."""

import base64
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import bpe, exact_dedup, html_main, importance, language, mixing, near_dedup, quality, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators make themselves
        *[T.StructField(n, T.StringType()) for n in ("Shard", "slot", "size", "kept", "ids", "score", "secrets", "target")],
    ]
)
EXTRA = ["x"] * 8


def _texts():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(60)]
    near = [b.replace(" a", " b", 1) + " end" for b in base[:20]]
    one = " ".join(rng.choice(vocabulary, 60))
    chain = [one]
    for i in range(6):  # neighbours are linked, ends are not
        words = chain[-1].split()
        words[5 + 8 * i] = f"new{i}"
        chain.append(" ".join(words))
    long = " ".join(rng.choice(vocabulary, 30_000))
    return [*base, *near, *chain, base[0], base[0].replace(" ", "\n"), base[1] + "  ", None, "", "   ", "é" * 50, long, "A b\tc", "a B C", "word"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "en", [None, "b", "a", "Z"][min(3, i % 7)], 0, *EXTRA) for i, t in enumerate(_texts())]
    rows += [(None, "without id", None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA), (5, _texts()[5], "en", "a", 0, *EXTRA), (5, _texts()[5], "en", "a", 0, *EXTRA)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")


def test_shards_hold_equal_bytes_and_gapless_slots(docs, empty):
    out = sharding.histogram_shards(docs, 5, ["doc_id"], tolerance=0.001).toPandas()
    assert len(out) == docs.count() and "Shard" not in out.columns
    assert (out["size"] == [len((t or "").encode()) + 16 for t in out["text"]]).all()
    groups = out.groupby("shard")
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in groups)
    # one text is far above a shard's share, so shards are only as equal as whole rows allow
    assert groups["size"].sum().max() <= out["size"].max() + out["size"].sum() / 5
    assert sharding.histogram_shards(empty, 5).count() == 0


def test_splitters_are_exact_and_split_one_hot_key(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.histogram_shards(rows, 4, ["doc_id"]).groupBy("shard").count().collect()
    assert len(out) == 4 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 20


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_compares_bytes(docs, weak):
    digest = (lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)).cast("string")) if weak else exact_dedup.sha256_hex
    got = exact_dedup.decide(docs, digest=digest, memtables=3).toPandas()
    groups = {}
    for r in docs.select("doc_id", "text").collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = Counter()
    for members in groups.values():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        want.update((None if m[1] else m[2], best, len(members)) for m in members)
    nul = lambda x: None if x != x or x is None else int(x)
    assert Counter((nul(a), nul(b), int(c)) for a, b, c in zip(got.doc_id, got.keep_id, got.group_size, strict=True)) == want
    assert got.kept.sum() == len(groups)
    if not weak:
        assert set(got.digest) == {hashlib.sha256(k.encode()).hexdigest() for k in groups}


def test_exact_dedup_salts_hot_groups_and_takes_nothing(spark, empty):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.decide(rows)
    assert got.count() == 5000 and got.where("kept").count() == 5000 - 1667 + 1
    assert got.where("group_size > 1").select("keep_id").distinct().collect()[0][0] == 0
    assert exact_dedup.decide(empty).count() == 0
    assert exact_dedup.drop_copies(empty).columns == empty.columns


def test_filters_find_hits_and_lookups(spark):
    """Digests that several rows share are hits, wherever their runs are; nearly all others are final without a merge."""
    cols = [F.col("id").alias("__tarn_id"), F.md5((F.col("id") % 4000).cast("string")).alias(exact_dedup.DIGEST), F.lit("").alias(exact_dedup.VARIANT), F.lit(1).alias(exact_dedup.POINTS)]
    rows = spark.range(0, 4400, 1, 6).select(F.monotonically_increasing_id().alias(exact_dedup.RID), *cols)
    index = exact_dedup.DigestIndex(rows, 3)
    assert index.entries().select("run").distinct().count() == 3
    assert 800 <= index.hits().count() < 1200
    shared = index.compact().collect()
    assert len(shared) == 400 and all(r.n == 2 and r.best.id < 400 for r in shared)
    assert index.lookup([hashlib.md5(b"3999").hexdigest(), "absent"]).count() == 1
    assert index.lookup([hashlib.md5(b"7").hexdigest()]).count() == 2


def test_mix_meets_targets(docs, empty):
    got = mixing.decide(docs).toPandas()
    assert len(got) == docs.count()
    assert (got["taken"] <= 3 * got["size"]).all() and (got.loc[got["size"] > 0, "taken"] % got.loc[got["size"] > 0, "size"] == 0).all()
    for target, g in got.groupby("target"):
        assert abs(g["taken"].sum() - target) <= max(1, 0.001 * target) or g["size"].max() > target
    again = mixing.decide(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert mixing.decide(empty).count() == 0
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.words(F.col("text")))).first()[0] == got["taken"].sum()


def _fit_targets(sizes, weights, share, most):
    """Water filling, source by source."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        for i in over or free:
            targets[i] = most * sizes[i] if over else left * weights[i] / weight
        left -= sum(targets[i] for i in over)
        free = [i for i in free if over and i not in over]
    return targets


def test_targets_of_any_number_of_sources(spark):
    rng = np.random.default_rng(1)
    names = ["é", "z", "\U0001F600", "\uffee", "a", "B", *[f"host-{i}.example" for i in range(500)]]
    for sizes in ([10, 10, 10], [1, 10, 0], [1, 1, 100], [0, 0], [int(x) for x in rng.pareto(0.7, 506) * 50], []):
        rows = [(False, n, s) for n, s in zip(names, sizes)]
        rows = [*rows[1:], (True, "", rows[0][2])] if rows else []  # the null source is last
        got = {(r[0], r[1]): r.target for r in mixing.fit_targets(spark.createDataFrame(rows, f"{mixing.NO} boolean, {mixing.NAME} string, source_size long").repartition(5)).collect()}
        order = sorted(rows)  # Python compares code points
        want = _fit_targets([r[2] for r in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 1.0, 3)
        assert [got[r[:2]] for r in order] == pytest.approx(want)


def test_budgets():
    for budget in (0, 1, 7, 50, 123, 999):
        taken = mixing.fit_budget({3: 20, 7: 10, 50: 3, 1: 2}, budget)
        assert sum(n * c for n, c in taken.items()) == min(budget, 282)
    big = mixing.fit_budget({n: 50 for n in range(100, 900, 7)}, 1_234_567)
    assert sum(n * c for n, c in big.items()) == 1_234_567 and all(c <= 50 for c in big.values())


def _tiktoken():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.load_ranks(path).splitlines())}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, empty):
    path, pattern, encoding = _tiktoken()
    coded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    for r in coded.select("text", "ids", "decoded").collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    once = bpe.round_trip(docs, path, pattern)
    assert once.columns == coded.columns and sorted(map(repr, once.collect())) == sorted(map(repr, coded.collect()))
    assert bpe.encode(empty, path, pattern).count() == bpe.round_trip(empty, path, pattern).count() == 0


def test_bpe_tree_joins_any_text():
    import random

    path, pattern, encoding = _tiktoken()
    codec = bpe.TreeCodec(bpe.load_ranks(path), pattern, leaf=3)
    draw = random.Random(1)
    signs = " \n\t\r\x0b\x1c\x85  '''rstvemlldDab12é中!<>"
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == encoding.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()
    for text in ("a" * 5000, "ab1 " * 3000, "\n" * 999, "<|endoftext|>" * 50):
        assert codec.encode(text) == encoding.encode_ordinary(text)
    with pytest.raises(ValueError):
        bpe.TreeCodec(bpe.load_ranks(path), pattern + "|x")


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_windows_grow_where_nothing_parts_words(name):
    """Texts without spaces: windows settle after a few tokens, so little is encoded twice."""
    import random

    import public_tokenizers as P

    codec = bpe.TreeCodec(bpe.load_ranks(P.path(name)), P.PATTERN)
    encode, draw, used = codec._leaf_encode, random.Random(2), []
    codec._leaf_encode = lambda text: used.append(len(text)) or encode(text)
    base64_signs = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(48, 58)])) + "+/"
    long = lambda signs, n=30_000: "".join(draw.choice(signs) for _ in range(n))
    for text in (long(base64_signs), long("中文字符没有空格"), long("กขคงจฉชซ์ิี"), long("0123456789"), long("ab"), "theandofwith" * 3000, "😀👍🏽" * 5000, "it'svery'll" * 3000):
        used.clear()
        assert codec.encode(text) == encode(text)
        assert sum(used) < 1.3 * len(text)
    for _ in range(1500):
        signs = draw.choice(["ab", "abc中é", "a1!", "ab'", "st're!'", "\u0e01\u0e34", "a\xa0b", "é́"])
        text = long(signs, draw.randint(513, 1200))
        assert codec.encode(text) == encode(text), repr(text)


def _brute_components(rows):
    sets = []
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append((i, frozenset(tuple(words[k : k + 4]) for k in range(len(words) - 3)) if len(words) > 3 else frozenset([tuple(words)] if words else [])))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and 100 * len(s & t) >= 80 * len(s | t):
                label[find(a)] = find(b)
    return sets, [find(x) for x in range(len(sets))]


def test_near_dedup_finds_all_components(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, labels = _brute_components(rows)
    least = {}
    for (i, _), label in zip(sets, labels, strict=True):
        least[label] = min((x for x in (least.get(label), i) if x is not None), default=None)
    want = Counter((i, len(s), least[label]) for (i, s), label in zip(sets, labels, strict=True))
    got = near_dedup.decide(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(set(labels))
    assert near_dedup.decide(empty).count() == 0
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(labels))


def test_near_dedup_of_a_large_group(spark):
    """Hundreds of variants that link in chains, with a band shared by all."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(i % 9):
            words[(13 * k + 7 * i) % 120] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    _, labels = _brute_components(rows)
    got = near_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: label for (i, _), label in zip(rows, labels, strict=True)}
    first = {}
    for i, label in want.items():
        first.setdefault(label, i)
    assert {r.doc_id: r.component_id for r in got} == {i: first[label] for i, label in want.items()}


_MASK = (1 << 64) - 1


def _scatter(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _buckets(text):
    """Buckets of the tokens and token pairs of a text, one by one."""
    odd, raw = 0x9E3779B97F4A7C15, (text or "").encode()
    tokens = []
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|([^0-9A-Za-z\x80-\xff\x20\x09-\x0d])\1*", raw):
        one = m.group().lower() if not m.group(1) else m.group(1)
        total = sum(_scatter((b + 1) * odd & _MASK) * pow(odd, i, 1 << 64) for i, b in enumerate(one)) & _MASK
        tokens.append(total if m.group(1) else _scatter(total))
    pairs = [_scatter((a * odd + b) & _MASK) for a, b in zip(tokens, tokens[1:], strict=False)]
    return [t >> 47 for t in tokens] + [(1 << 17) + (p >> 47) for p in pairs]


def _brute_scores(rows, trusted):
    """(sum of log ratios, n-grams) of each text: two smoothed models counted with dictionaries."""
    import math

    grams = [_buckets(text) for _, text in rows]
    models = []
    for half in (0, 1):
        mine = lambda g: [b for b in g if (b >> 17) == half]  # noqa: B023, E731
        raw = Counter(b for g in grams for b in mine(g))
        target = Counter(b for (i, _), g in zip(rows, grams, strict=True) if i in trusted for b in mine(g))
        scale = sum(target.values()) / max(1, sum(raw.values()))
        models.append({b: math.log((target[b] + 32) / (n * scale + 32)) if target else 0.0 for b, n in raw.items()})
    return [(sum(models[b >> 17][b] for b in g), len(g)) for g in grams]


def test_resampling_equals_brute_force(docs, labels, empty):
    got = importance.resample(docs, labels, k=30).toPandas()
    assert len(got) == docs.count() and got.kept.sum() == 30
    assert got.loc[got.kept, "gumbel_key"].min() >= got.loc[~got.kept, "gumbel_key"].max()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = _brute_scores(rows, {i for i in range(40) if i % 4})
    key = lambda x: (x[0] if x[0] == x[0] and x[0] is not None else -1, x[1], x[2])
    brute = sorted(((i, n, s) for (i, _), (s, n) in zip(rows, want, strict=True)), key=key)
    mine = sorted(zip(got.doc_id, got.n_ngrams, got.log_weight, strict=True), key=key)
    assert [key(x)[:2] for x in mine] == [key(x)[:2] for x in brute]
    assert [x[2] for x in mine] == pytest.approx([x[2] for x in brute], rel=1e-4, abs=1e-3)
    share = importance.resample(docs, labels).toPandas()  # 30 of 40 labelled rows are good
    assert share.kept.sum() == round(0.75 * len(share))
    assert sorted(map(key, zip(share.doc_id, share.n_ngrams, share.gumbel_key, strict=True))) == sorted(map(key, zip(got.doc_id, got.n_ngrams, got.gumbel_key, strict=True)))
    odd = labels.union(labels.select(F.lit(None).cast("long"), "quality", "toxic")).union(labels.select("doc_id", F.lit(None).cast("int"), F.lit(None).cast("int"))).union(labels)
    assert importance.resample(docs, odd).toPandas().kept.sum() == round(0.75 * len(share))
    assert importance.resample(docs, labels.limit(0)).toPandas().kept.all()
    assert importance.resample(docs, labels.limit(0)).toPandas().log_weight.eq(0).all()
    assert importance.resample(empty, labels).count() == 0


def test_resampling_noise_is_gumbel(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"))
    keys = importance.resample(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"), share=0.5).toPandas()
    noise = np.sort(keys.gumbel_key - keys.log_weight)
    assert keys.kept.sum() == 10_000
    assert np.abs(np.exp(-np.exp(-noise)) - np.arange(1, 20_001) / 20_000).max() < 0.015


def test_quality_counts_and_base(docs, labels, empty):
    got = quality.judge(docs, labels).toPandas()
    want = []
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        words = WORD.findall(text)
        wide = Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {k + j for k in range(len(words) - 2) if wide[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)))
    assert Counter(map(tuple, got[quality.COUNTS].astype(int).values.tolist())) == Counter(want)
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    scores = _brute_scores(rows, {i for i in range(40) if i % 4})
    nul = lambda x: -1 if x is None or x != x else int(x)
    brute = sorted((nul(i), n[0], s / max(1, g)) for (i, _), n, (s, g) in zip(rows, want, scores, strict=True))
    mine = sorted(zip(map(nul, got.doc_id), got.n_words, got.mean_ratio, strict=True))
    assert [x[:2] for x in mine] == [x[:2] for x in brute] and [x[2] for x in mine] == pytest.approx([x[2] for x in brute], rel=1e-4, abs=1e-5)
    assert (got.kept == (~got.base_failed & (got.mean_ratio >= quality.LEAST_MEAN_RATIO))).all()
    assert quality.judge(empty, labels).count() == 0


def test_quality_tells_junk(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = [(i, " ".join(w + ("###" if i % 4 == 0 else "") for w in rng.choice(words, 80)), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q int")
    labels = docs.where("doc_id < 200").select("doc_id", F.col("q").alias("quality"), F.lit(0).alias("toxic"))
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels, least=-0.2).collect()}
    assert all(got[i] == bool(q) or not q for i, _, q in rows) and sum(got[i] for i, _, q in rows if not q) == 0


def test_language_and_spans(spark, empty):
    rng = np.random.default_rng(2)
    words = {"aa": ["kato", "meno", "tika", "loma"], "bb": ["schtr", "pflug", "krumm", "stuhl"], "ru": ["привет", "слово", "дома"]}
    rows = [(i, " ".join(rng.choice(words[k], 40)), k) for i, k in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.langs == ["aa", "bb", "ru"]
    got = language.identify(docs, model).where(language.held_out(F.col("doc_id"))).collect()
    assert got and all(r.lang == r.lang_pred and 0.9 < r.score <= 1 for r in got)
    mixed = " ".join([" ".join(rng.choice(words["aa"], 30)), " ".join(rng.choice(words["bb"], 50)), " ".join(rng.choice(words["ru"], 10))])
    odd = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !!"), (4, "日本語"), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [s.lang for s in found[1].spans] == ["aa", "bb", "ru"] and found[1].lang_pred == "bb"
    assert "".join(mixed[s.start : s.end].strip() + " " for s in found[1].spans).split() == mixed.split()
    assert [found[i].lang_pred for i in (2, 3, 5)] == ["und"] * 3 and found[4].lang_pred in model.langs and found[4].score == 0
    assert language.train(empty) is None and language.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language.keep_known(docs).columns == docs.columns


def test_language_of_odd_rows(spark):
    long = "kato meno tika loma " * 60_000
    rows = [(1, long, "aa", "x", "y"), (1, long, "aa", "x", "y"), (2, "schtr pflug", "bb", "x", "y"), (None, "stuhl krumm", "bb", "x", "y"), (3, None, None, "x", "y"), *[(10 + i, w * 20, k, "x", "y") for i in range(30) for w, k in (("kato meno ", "aa"), ("schtr pflug ", "bb"))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string, Spans string")
    model = language.train(docs)
    found = language.identify(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"]
    got = found.collect()
    assert len(got) == len(rows) and all(r.lang_pred == (r.lang or "und") for r in got)
    assert [(s.start, s.end) for r in got if r.doc_id == 1 for s in r.spans] == [(0, len(long) - 1)] * 2
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang"))
    more = many.union(many.where("doc_id < 900").withColumn("doc_id", F.col("doc_id") + 5000))
    assert language.train(more, most_langs=4).langs == sorted(language.train(more, most_langs=4).langs)
    often = {r.lang for r in more.where(~language.held_out(F.col("doc_id"))).groupBy("lang").count().where("count > 1").collect()}
    assert len(language.train(more, most_langs=40).langs) == 40 and set(language.train(more, most_langs=40).langs) <= often


@pytest.mark.parametrize("files", [1, 30])
def test_memtables_of_a_plain_read_are_all_filled(spark, tmp_path, files):
    """The pipeline's stage numbers rows by file and place; hits are found by the filters of other runs."""
    rows = [(i, f"text {i % 2700}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    told = exact_dedup.numbered(read, "rows", True)
    log = exact_dedup._write_log(told, "doc_id", "text", exact_dedup.sha256_hex, exact_dedup.RID)
    index = exact_dedup.DigestIndex(log, 6)
    runs = {r["run"]: r["count"] for r in index.entries().groupBy("run").count().collect()}
    assert set(runs) == set(range(6)) and min(runs.values()) > 300
    assert index.hits().where("n = 1").count() >= 400  # most of the 300 pairs lie in two runs
    kept = exact_dedup.drop_copies(read, scanned=True, memtables=6)
    assert kept.count() == 2700 and kept.select("text").distinct().count() == 2700


def test_keeping_known_languages_takes_odd_rows(docs):
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert kept.count() == docs.where(r"text RLIKE '\\p{L}'").count()


def test_viterbi_equals_search():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(50):
        scores = -rng.random((6, 3)) * 3
        cost = lambda p, s=scores: sum(s[i, k] for i, k in enumerate(p)) - 1.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=6), key=cost)
        assert cost(language.viterbi(scores, 1.0)) == pytest.approx(cost(best))
        model = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), 1.0)
        assert cost(model.path(scores)) == pytest.approx(cost(best))


def test_secrets(spark):
    key, hexa = "AKIA" + "ABCDEFGHIJKLMN12", "0123456789abcdef0123"
    texts = [f'say PassWord: "abcDEF123456_x" and {key} or {hexa} done', "token=short secret =  'abcdefghijkl'", None, "", "é token = abcdefghijklm", "Kq9vXz2LpW7rTn4BsYd1Gh and plainordinaryword here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = "ordinary words of plain writing going into training, with names like keyword_list, parseInputLine and max-queue-size beside quick brown foxes jumping over lazy dogs"
    train = spark.createDataFrame([(i, plain) for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(rows, secrets.train(train)).withColumn("s", secrets.spelled(F.col("secrets"))).collect()}
    assert got[0].s == "assign:4:29,access:35:55,hex:59:79"
    assert got[1].s == "assign:12:35" and got[2].s == got[3].s == "" and got[4].s == "assign:2:23"
    assert got[5].s == "markov:0:22"
    assert secrets.scan(rows.limit(0), secrets.train(train)).count() == 0
    odd = spark.createDataFrame([(1, "x", texts[0]), (1, "x", texts[0]), (2, "y", " ".join([texts[5]] * 20_000))], "doc_id long, SECRETS string, text string")
    assert secrets.scan(rows, secrets.train(rows.limit(0))).count() == 6
    seen = secrets.scan(odd, secrets.train(train)).withColumn("n", F.size("secrets"))
    assert seen.columns == ["doc_id", "text", "secrets", "n"] and sorted((r.doc_id, r.n) for r in seen.collect()) == [(1, 3), (1, 3), (2, 20_000)]


DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="the tables are not here")
def test_secrets_of_the_whole_table(spark):
    """Base spans by the contract's own words; added spans by recall on hidden keys and precision on ordinary texts."""
    table = spark.read.parquet(DOCUMENTS)
    ratios = secrets.train(table)
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, lambda m: m.end(1) - m.start(1) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: m.end() - m.start() >= 16)]
    added, hidden, values = [], [], []
    for r in secrets.scan(table, ratios).select("text", secrets.spelled(F.col("secrets")).alias("s")).collect():
        text = r.text or ""
        base = sorted((m.start(), k, m.end(), kind) for k, (kind, pattern, fits) in enumerate(kinds) for m in pattern.finditer(text) if fits(m))
        spans = r.s.split(",") if r.s else []
        assert [x for x in spans if not x.startswith("markov")] == [f"{kind}:{a}:{b}" for a, _, b, kind in base]
        added += [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in spans if x.startswith("markov")]
        values += [m.group(1) for m in assign.finditer(text) if len(m.group(1)) >= 16]
    # keys that no pattern tells: the values of assignments, and generated ones, on their own
    hidden = [v for v in {*values, *secrets.generated_keys(300, seed=77)} if not secrets.base_spans(v)]
    assert len(hidden) > 150 and np.mean([bool(secrets.all_spans(f"see {v} there", ratios)) for v in hidden]) >= 0.9
    # ordinary names, made of the table's words
    words = re.findall(r"[A-Za-z]{3,12}", " ".join(r.text or "" for r in table.select("text").limit(100).collect()))
    names = [join.join(words[i : i + 4]) for i in range(0, 2000, 4) for join in ("_", "-")] + ["".join(w.capitalize() for w in words[i : i + 4]) for i in range(0, 2000, 4)]
    names = [x for x in names if len(x) >= 16]
    assert len(names) > 1000 and np.mean([bool(secrets.all_spans(x, ratios)) for x in names]) <= 0.01


def test_secret_spans_are_swept_in_linear_time():
    import time

    text = " ".join("0123456789abcdef0123 Kq9vXz2LpW7rTn4BsYd1Gh" for _ in range(40_000))
    ratios = np.ones(secrets._SIGNS**2)
    began = time.monotonic()
    assert len(secrets.all_spans(text, ratios)) == 80_000 and time.monotonic() - began < 10


def test_main_text(spark):
    page = "<html><head><title>t</title><script>'<p>'</script></head><body><nav><a>x</a></nav><article><h1>T%d</h1><p>One &amp; two<br>three %d<p>Four\n five<div class='comments'>no</div></article><footer>f</footer>"
    plain = "<html><body><div class='top'>Site</div><div id='c' class='content'><p>Body %d is here and long enough</p><p>More of %d</p></div><div class='sidebar'>s</div></body></html>"
    rows = [(i, "http://a.example/1", page % (i, i)) for i in range(5)] + [(10 + i, "http://b.example/1", plain % (i, i)) for i in range(5)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://c.example", "only text &lt;b&gt;"), (23, "http://a.example/2", plain % (7, 7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    assert got[1] == "T1\nOne & two\nthree 1\nFour five"
    assert got[12] == "Body 2 is here and long enough\nMore of 2"
    assert got[20] == got[21] == "" and got[22] == "only text <b>" and got[23] == "Body 7 is here and long enough\nMore of 7"
    assert html_main.main_text(pages.limit(0)).count() == 0
