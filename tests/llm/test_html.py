import pytest

from quillspark.llm import html_extract as H

PAGES = [
    ("", ""),
    ("<p>hi there this is text", "hi there this is text"),
    ("<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><article><header><h1>Title</h1></header><p>One <i>t</i>wo &amp; three&nbsp;x</p><aside>side</aside><div class='comment-list'>c1 c2</div><div class=share-bar>share</div><p>Last<br>line</p></article></main><footer>f</footer></body></html>", "Title One two & three x Last line"),
    ("<div><p>plain words here only and many more</p><p>second paragraph of words</p></div><div class='sidebar'>x y z</div>", "plain words here only and many more second paragraph of words"),
    ("a < b and c > d <p", "a < b and c > d"),
    ("<article><p title=\"x>y\">text</p><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --></article>", "text"),
    ("<article><h1>A</h1><form><p>subscribe now</p></form><ul><li>one</li><li>two</li></ul><p>cut off in the mid", "A one two cut off in the mid"),
    ("<nav>a b c</nav><footer>d e f</footer>", ""),
    ('<div class="content has-sidebar"><article><p>all of this is kept</p></article></div>', "all of this is kept"),
    ('<article><p>one two three</p><p class="warning">hot water here</p><div class="search-and-rescue"><p>they went out</p></div></article>', "one two three hot water here they went out"),
    ("<form action=x><nav>a b</nav><article><p>server pages are forms</p></article><footer>f</footer></form>", "server pages are forms"),
    ('<div class="comment-less"><p>nobody said a word</p></div>', "nobody said a word"),
    ("<article></article><div><p>real text stands here</p></div>", "real text stands here"),
    ("<article><p>first part of it</p></article><div>and then</div><article><p>second part of it</p></article>", "first part of it and then second part of it"),
    ("<article><p>first part of it</p></article><div class=ad-slot>buy</div><article><p>second part of it</p></article>", "first part of it second part of it"),
    ("<div><p>" + "body words here " * 20 + "</p></div><div class=comments><article><p>I like it a lot</p></article><article>me too</article></div>", ("body words here " * 20).strip()),
    ("<script>var a='<article>';</script><!-- <article> --><div><p>the body is a div</p></div>", "the body is a div"),
    ("<div><p>" + "long body of text " * 20 + "</p></div><article><h2>Teaser</h2></article>", ("long body of text " * 20).strip()),
    ("<div class=sidebar><article><p>a wrapper by a wrong name</p></article></div>", "a wrapper by a wrong name"),
    ("<article><p class=ad>buy now<p>text of it<div class='cookie-notice'>we use them</div><p>more</article>", "text of it more"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert H.main_text(page, H.Weights({})) == text


def test_whole_column(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = H.extract(pages, H.fit(pages)).collect()
    assert len(got) == pages.count()
    for r, p in zip(sorted(got), sorted(pages.collect()), strict=True):
        assert r.text and "track(" not in r.text and "&amp;" not in r.text
        nav = p.html.split("<nav>")[1].split("</nav>")[0]
        assert not r.text.startswith(nav)


def test_nulls_empty_tables_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (2, "", "old")], "page_id long, html string, text string")
    assert [tuple(r) for r in H.extract(df, H.fit(df)).select("page_id", "text").orderBy("page_id").collect()] == [(1, ""), (2, ""), (2, "")]
    assert H.extract(df.limit(0), H.fit(df.limit(0))).count() == 0


def test_very_long_page():
    page = "<article>" + "<p>word and word</p>" * 50_000 + "</article>"
    assert len(H.main_text(page, H.Weights({})).split()) == 150_000


@pytest.mark.parametrize("part", ["<p></q>", "<b>", "</b>", "<p><b>", "<div></p>", "<a href='", "<table><tr><td>", "<li><p>x</li>"])
def test_broken_markup_takes_linear_time(part):
    import time

    def took(n):
        began = time.perf_counter()
        H.main_text("<p>some words</p>" + part * n, H.Weights({}))
        return time.perf_counter() - began

    took(100)
    assert took(16_000) < 12 * took(4_000) + 0.5


def test_stretch_equals_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2, -1, -0.5, 0, 0.5, 1, 3]) for _ in range(rng.randint(0, 15))]
        first, stop = H.best_stretch(scores)
        sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        assert sum(scores[first:stop]) == max([0, *sums]) and (stop > first) == (max([0, *sums]) > 0)


def test_whole_table_against_a_plain_reading(spark, sf):
    """The synthetic pages hold their text in one article of h1, p, b and br."""
    import html
    import re

    from quillspark.llm.queries import op6_html

    want = {}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = (p.html or "").partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:h1|p|br)>", inner)
        want[p.page_id] = " ".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks) if x)
    got = {r.page_id: r for r in op6_html(spark, sf).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
