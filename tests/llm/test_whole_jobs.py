"""Corpus operators do their whole job; each case here lies outside of what a cut would leave."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.llm import _ngrams, html_main, importance, mixing, secrets
from tarn.llm.sharding import K1, K2


def _read(spark, pages, parts=40):
    rows = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_main.main_text(rows.repartition(parts, "page_id")).collect()}


def test_wrappers_are_learnt_from_all_pages(spark):
    body = "<html><body><div class='content'><article><p>Text %d</p></article></div>%s</body></html>"
    # one page in two hundred has a second article, at a place of its own
    got = _read(spark, [body % (i, "<div class='feature'><article><p>Second</p></article></div>" if i == 137 else "") for i in range(200)])
    assert got[137] == "Text 137\nSecond" and all(got[i] == f"Text {i}" for i in got if i != 137)
    # a text that one page in two hundred varies is no furniture
    plain = "<html><body><div class='x'><p>%s</p><p>Long text number %d of this page</p></div></body></html>"
    got = _read(spark, [plain % ("Breaking" if i == 61 else "Daily", i) for i in range(200)])
    assert got[61].startswith("Breaking") and got[60].startswith("Daily")


def test_numbered_classes_are_one_place():
    found = html_main.infer([f"<body><article class='post-{i}'><p>{i}</p></article></body>" for i in range(300)])
    assert found.main_paths() == [["body", "article.post-#"]]


def test_nothing_goes_from_an_article_for_being_constant(spark):
    page = "<body><article><h1>T %d</h1><div class='x'>Sign <b>up</b> now</div><p>Price: <b>%d</b></p></article></body>"
    for n in (3, 11, 12, 30):
        assert _read(spark, [page % (i, i) for i in range(n)], 5) == {i: f"T {i}\nSign up now\nPrice: {i}" for i in range(n)}
    # articles that are copies of each other
    assert _read(spark, [f"<body><nav>{i}</nav><p>{i}</p>" + page % (1, 1) for i in range(30)])[9] == "T 1\nSign up now\nPrice: 1"


def test_without_an_article_what_all_pages_say_goes(spark):
    page = "<body><div><h1>T %d</h1><div class='x'>Sign <b>up</b> now</div><p>The price of this thing here is %d</p></div></body>"
    assert set(_read(spark, [page % (i, i) for i in range(30)], 5).values()) == {f"T {i}\nThe price of this thing here is {i}" for i in range(30)}
    assert _read(spark, [page % (i, i) for i in range(2)])[1] == "T 1\nSign up now\nThe price of this thing here is 1"  # too few to tell


def test_weights_are_whole_sums(spark):
    good = [(i, f"good words of kind {i % 7} " * 30) for i in range(60)]
    docs = spark.createDataFrame([*good, *[(100 + i, "junk ### line *** " * (5 + 400 * i)) for i in range(3)]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    ratios = _ngrams.log_ratios(*_ngrams.count_ngrams(docs, labels.select("doc_id"), "doc_id", "text"))
    rows = importance.resample(docs, labels, share=0.5).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id")["text"]
    sums, n = _ngrams.text_scores([texts[i] for i in rows.index], ratios)
    assert rows.log_weight.tolist() == pytest.approx(sums.tolist(), rel=1e-6) and rows.n_ngrams.tolist() == n.tolist()
    assert rows.log_weight[102] < 1.9 * rows.log_weight[101] < 0
    assert rows.kept.sum() == 32


def test_keys_are_ordered_however_far(spark):
    keys = [3.2, 3.2 + 1e-12, -1e-15, 0.0, -5e6, -4e6, -4e6 - 1e-6, 12.0, -2e9]
    placed = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key double, rid long").select("key", *[c.alias(n) for n, c in importance._place(F.col("key"), F.col("rid")).items()])
    rows = placed.orderBy(K1, K2).collect()
    assert all(0 <= x < 1 << 60 for r in rows for x in r[1:])
    assert [r.key for r in rows] == pytest.approx(sorted(keys, reverse=True), abs=1e-15)


def test_budgets_take_documents_of_any_length():
    assert mixing.fit_budget({90_000: 3}, 100_000) == {90_000: 1}
    assert mixing.fit_budget({90_000: 100}, 4_500_000) == {90_000: 50}
    for counts, budget in (({200_000: 5, 70_001: 3, 11: 2}, 600_000), ({150_000: 2, 99_999: 4, 80_001: 3}, 333_333), ({10: 1, 10**9: 1}, 5 * 10**8)):
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.fit_budget(counts, budget)
        assert sum(n * c for n, c in taken.items()) == max(s for s in sums if s <= budget)
        assert all(taken[n] <= c for n, c in counts.items())


def test_identifiers_are_learnt_from_whole_texts():
    text = "abcd " * 5000 + "wxyz " * 5000
    (found,) = secrets._count_pairs(iter([pd.DataFrame({"text": [text, None, ""]})]))
    met = {(r.side, r.pair): r.n for r in found.itertuples()}
    pair = lambda a, b: met[1, int(secrets._steps(a + b)[0])]
    assert pair("d", "_") == pair("d", "-") == pair("_", "a") + 1 == 5000 and pair("z", "_") == pair("z", "W") == 4999
    assert pair("w", "x") == 15_000 and pair("W", "x") == 5000 and len(met) == 19
