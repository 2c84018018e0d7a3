"""Wrappers: their expressions, what they decide, and that any page can be read."""

import html
import os
import random
import re
import time

import pytest

from tarn.llm import html_main
from tarn.llm.html_main import Part, Wrapper, extract, infer

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_expressions_have_no_unions():
    page = lambda n: f"<body><ul>{''.join(f'<li>{n} {k}</li>' for k in range(n))}</ul>{'<hr>' * (n % 2)}<article><p>{n}</p></article><p>end</p></body>"
    found = infer([page(n) for n in (1, 2, 3)])
    assert html_main.expression(found.top) == "<body><ul>(<li>#PCDATA</li>)+</ul> (<hr></hr>)? <article><p>#PCDATA</p></article> <p>end</p></body>"
    assert found.main_paths() == [["body", "article"]]


def _read(spark, pages, parts=5, **options):
    rows = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_main.main_text(rows.repartition(parts, "page_id"), **options).collect()}


def test_the_wrapper_decides_without_names(spark):
    """No class, id or telling tag: only what other pages of the host say tells the text from the rest."""
    draw = random.Random(4)
    words = lambda n: " ".join(draw.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(draw.randint(0, 99)) for _ in range(n))
    bodies = [[words(30) for _ in range(draw.randint(1, 6))] for _ in range(40)]
    page = lambda b: f"<body><div>Our site <b>of</b> news</div><div><div>Choose your cookies here</div>{''.join(f'<p>{t}</p>' for t in b)}<div>Tell a friend</div></div><div>All rights kept</div></body>"
    pages = [page(b) for b in bodies]
    got = _read(spark, pages)
    assert all(got[i] == "\n".join(b) for i, b in enumerate(bodies))
    alone = [extract(p, None) for p in pages]
    assert all(a != "\n".join(b) for a, b in zip(alone, bodies, strict=True))


def test_main_text_in_a_badly_named_place(spark):
    """A name tells of furniture only where enough text is left without it."""
    page = "<body><div class='sidebar-layout'><p>Long text number %d that this page is about</p><p>and more of %d</p></div><div class='sidebar'>%d small things</div></body>"
    assert _read(spark, [page % (i, i, i) for i in range(20)])[7] == "Long text number 7 that this page is about\nand more of 7"


def test_teasers_and_nested_articles():
    teasers = "<article class='card'>see %d</article>"
    page = lambda i: "<body><div id='x'>" + "".join(f"<p>Paragraph {k} of page {i} with many words in it</p>" for k in range(5 + i % 3)) + "</div>" + teasers * (2 + i % 3) % ((i,) * (2 + i % 3)) + "</body>"
    found = infer([page(i) for i in range(30)])
    assert extract(page(3), found) == "\n".join(f"Paragraph {k} of page 3 with many words in it" for k in range(5))
    page = lambda i: f"<body><article><h1>{i}</h1><p>The text of page {i}, which is long enough to be one.</p><article>first {i}</article><article>x</article></article></body>"
    assert extract(page(3), infer([page(i) for i in range(30)])) == "3\nThe text of page 3, which is long enough to be one."


def _recipe(i, quote=""):
    return f"<body><nav>n</nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Take {i} eggs and stir them for a while.</p>{quote}<h2>Method</h2><p>Cook it {i} times, then eat.</p></article><footer>f</footer></body>"


def _recipe_text(i, quote=""):
    return "\n".join(x for x in (f"Dish {i}", "Ingredients", f"Take {i} eggs and stir them for a while.", quote, "Method", f"Cook it {i} times, then eat.") if x)


@pytest.mark.parametrize("n", [1, 2, 11, 12, 20, 500])
def test_constant_text_of_an_article_stays(n):
    found = infer([_recipe(i) for i in range(n)])
    assert all(extract(_recipe(i), found) == _recipe_text(i) for i in range(0, n, 7))


def test_what_few_articles_have_stays():
    pages = [_recipe(i, "<blockquote>As my aunt used to say.</blockquote>" * (i % 16 == 0)) for i in range(200)]
    found = infer(pages)
    assert all(extract(p, found) == _recipe_text(i, "As my aunt used to say." * (i % 16 == 0)) for i, p in enumerate(pages))


def test_a_repeated_page_reads_as_if_it_stood_once(spark):
    odd = "<body><div><h1>Title A</h1><p>Words A of the first part, which are many.</p><blockquote>Quoted words of A.</blockquote><p>Words A of the last part, which are many.</p></div><div>All rights kept</div></body>"
    other = lambda i: f"<body><div><h1>Title {i}</h1><p>Words {i} of the first part, which are many.</p></div><div>All rights kept</div></body>"
    once = _read(spark, [odd, *map(other, range(12))])
    assert once[0] == "Title A\nWords A of the first part, which are many.\nQuoted words of A.\nWords A of the last part, which are many."
    for parts in (1, 6):
        often = _read(spark, [odd] * 12 + [other(i) for i in range(12)], parts)
        assert all(often[k] == once[0] for k in range(12)) and all(often[12 + i] == once[1 + i] for i in range(12))


def test_all_blocks_with_sentences_stay_without_an_article():
    page = lambda i: f"<body><div>Our site of news</div><div><div><h2>Part one</h2><p>First sentence of page {i}, long enough.</p></div><div><h2>Part two</h2><p>Second block of page {i}, quite as long as the first.</p></div><div>Tell a friend</div></div><div>All rights kept</div></body>"
    found = infer([page(i) for i in range(20)])
    assert extract(page(4), found) == "Part one\nFirst sentence of page 4, long enough.\nPart two\nSecond block of page 4, quite as long as the first."


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[j], row[j + 1]))
    return out


@pytest.mark.parametrize("bits", [html_main.ALIGN_BITS, 64])
def test_alignments_are_longest(monkeypatch, bits):
    monkeypatch.setattr(html_main, "ALIGN_BITS", bits)
    draw = random.Random(9)
    for _ in range(150):
        a, b = ([draw.choice("pqrs") for _ in range(draw.randint(0, 40))] for _ in range(2))
        found = html_main.pairs(a, b)
        assert found == sorted(found) and all(a[i] == b[j] for i, j in found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found) == _longest(a, b)


def test_hot_and_many_hosts_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(html_main, "OPEN_HOSTS", 3)
    monkeypatch.setattr(html_main, "FAN_IN", 2)
    hosts = ["hot"] * 40 + [f"h{i}" for i in range(30)]
    rows = [(k, f"http://{h}.example/{k}", _recipe(k)) for k, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    wrappers = {r.host: r.pages for r in html_main.learn_wrappers(pages).collect()}
    assert wrappers.pop("hot.example") == 40 and set(wrappers.values()) == {1} and len(wrappers) == 30
    assert all(r.text == _recipe_text(r.page_id) for r in html_main.main_text(pages).collect())


def test_any_depth_and_length(spark):
    text = lambda i: f"Words at the bottom of page {i}"
    deep = lambda i, tag="div": f"<body><nav>n</nav>{f'<{tag}>' * 5000}{text(i)}{f'</{tag}>' * 5000}<footer>f</footer></body>"
    pairs = "<body><article>" + "".join(f"<p>p {k}</p><b>b {k}</b>" for k in range(2000)) + "</article></body>"
    broad = "<body><article>" + "".join(f"<p>{'word ' * 20}{k}</p>" + ("<hr>" if k % 7 == 0 else "<ul><li>x</ul>" if k % 5 == 0 else "") for k in range(12_000)) + "</article></body>"
    spans = "<body><article>" + "<span>" * 5000 + "<p>a</p></i>" * 2000
    quotes = "<body><article>" + "<a title=\"'\"'\"'" * 3000 + "x"
    assert len(broad) > 1 << 20
    pages = [deep(1), deep(2), deep(3, "span"), pairs, pairs.replace("p 7", "q 7"), broad, broad.replace("<hr>", "<hr><hr>"), spans, quotes, "<div>" * 200_000]
    began = time.monotonic()
    got = _read(spark, pages, 2)
    assert time.monotonic() - began < 60
    assert [got[i] for i in range(3)] == [text(1), text(2), text(3)]
    assert got[3] == "\n".join(f"p {k}\nb {k}" for k in range(2000)) and got[4] == got[3].replace("p 7", "q 7")
    assert len(got[5].split("\n")) == 12_000 + sum(k % 7 != 0 and k % 5 == 0 for k in range(12_000)) and got[6] == got[5]
    assert got[7] == "\n".join(["a"] * 2000)


def test_partial_wrappers_pack_and_meet():
    pages = [f"<body><div class=a><p>{i}</p>{'<p>same</p>' * (i % 3)}</div>{'<hr>' * (i % 2)}</body>" for i in range(24)]
    whole = infer(pages)
    parts = [Wrapper() for _ in range(4)]
    for i, page in enumerate(pages):
        parts[i % 4].add(page)
    met = Wrapper()
    for p in parts:
        met.merge(Wrapper.load(p.dump()))
    assert met.top.count == 24 and html_main.expression(met.top) == html_main.expression(whole.top)
    assert Wrapper.load(Wrapper().dump()).top is None and isinstance(Wrapper.load(whole.dump()).top, Part)


def test_odd_rows(spark):
    page = "<body><article><p>Text of %d</p></article></body>"
    rows = [(1, "http://a.example/1", page % 1, "old", "x"), (1, "http://a.example/1", page % 1, "old", "x"), (2, None, None, None, None), (3, "odd", "", "", ""), (4, "http://A.example", page % 4, None, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, host string")
    for limit in (html_main.BROADCAST_BYTES, 0):
        out = html_main.main_text(pages, broadcast_bytes=limit)
        assert out.columns == ["page_id", "url", "html", "host", "text"]
        got = sorted((r.page_id, r.text, r.host or "") for r in out.collect())
        assert got == [(1, "Text of 1", "x"), (1, "Text of 1", "x"), (2, "", ""), (3, "", ""), (4, "Text of 4", "h")]
        assert html_main.main_text(pages.limit(0), broadcast_bytes=limit).count() == 0


def _article(page):
    """Text between the article's tags, blocks parted where tags of blocks stand."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    lines = re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", inside)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?\w[^>]*>", "", line)).split()) for line in lines) if x)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the tables are not here")
@pytest.mark.parametrize("limit", [html_main.BROADCAST_BYTES, 0])
def test_every_page_of_the_table(spark, limit):
    got = html_main.main_text(spark.read.parquet(PAGES).repartition(7), broadcast_bytes=limit).collect()
    assert len(got) == spark.read.parquet(PAGES).count()
    assert [r.page_id for r in got if r.text != _article(r.html)] == []
