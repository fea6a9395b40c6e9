import random

from pyspark.sql import functions as F

from quillspark.sources import readers as S


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿é plain".encode())
    (tmp_path / "b.txt").write_bytes("wide".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "d.txt").write_bytes(b" \n")
    files, rejects = S.read_raw(spark, f"file://{tmp_path}", "*.txt")
    got = {r.path[-5:]: r.text for r in files.collect()}
    assert got == {"a.txt": "é plain", "b.txt": "wide", "c.txt": "café"}
    assert [(r.path[-5:], r.reason) for r in rejects.collect()] == [("d.txt", "empty")]


def test_html_blocks(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><main><h1>Top</h1><p>One &amp; <b>two</b></p><ul><li>item a</li></ul><pre>x = 1\n  y</pre><p>...</p></main><footer>end</footer></body></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "k long, html string")
    rows = S.html_to_blocks(df, "k", "html").orderBy("k", "block_no").collect()
    assert [(r.block_type, r.level, r.text) for r in rows] == [("heading", 1, "Top"), ("paragraph", None, "One & two"), ("list", None, "- item a"), ("code", None, "x = 1\n  y")]


def test_html_roots_are_elements(spark):
    pages = [
        (1, "<body><!-- <main><p>no</p></main> --><script>var a = '<main>';</script><p>one word here</p></body>", ["one word here"]),
        (2, "<p>outside it</p><article><p>first part</p><article><p>nested part</p></article></article><article><p>second one</p></article>", ["first part", "nested part"]),
        (3, "<article><p>in the article</p></article><main><p>in the main</p></main>", ["in the main"]),
        (4, "<main><p>never closed", ["never closed"]),
        (5, "<nav><main><p>menu item</p></main></nav><p>body text</p>", ["body text"]),
    ]
    got = {}
    for r in S.html_to_blocks(spark.createDataFrame([p[:2] for p in pages], "k long, html string"), "k", "html").orderBy("k", "block_no").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {k: want for k, _, want in pages}


def test_html_tables_are_grids(spark):
    page = "<p>before it</p><table><tr><th>Name<th>Size</tr><tr><td>a | b</td><td><p>1</p><p>2</p></td></tr><tr></tr><tr><td>c</td></tr><tr><td>d<table><tr><td>inner</td></tr></table></td><td>4</td></tr></table><p>after it</p><table><tr><td>open"
    rows = S.html_to_blocks(spark.createDataFrame([(1, page)], "k long, html string"), "k", "html").orderBy("block_no").collect()
    assert [(r.block_type, r.text) for r in rows] == [
        ("paragraph", "before it"),
        ("table", "| Name | Size |\n| --- | --- |\n| a \\| b | 1 2 |\n| c |  |\n| d inner | 4 |"),
        ("paragraph", "after it"),
        ("table", "| open |\n| --- |"),
    ]


def test_text_blocks(spark):
    text = "2.1 Scope\nfirst line\nsecond line\n\n```\ncode\n\nmore\n```\nlast"
    rows = S.text_to_blocks(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("block_no").collect()
    assert [(r.block_type, r.text, r.start) for r in rows] == [("heading", "2.1 Scope", 0), ("paragraph", "first line\nsecond line", 10), ("code", "```\ncode\n\nmore\n```", 34), ("paragraph", "last", 53)]


def test_front_matter(spark):
    df = spark.createDataFrame([("---\ntitle: A b\ntags: [x]\n---\n# body",), ("no head",)], "t string")
    got = [r[0] for r in df.select(S.front_matter(F.col("t"))).collect()]
    assert got == [{"title": "A b", "tags": "[x]"}, {}]


def test_words_to_lines(spark):
    words = [(1, 0, 10.0, 5.0, "b", 10.0), (1, 0, 11.0, 0.0, "a", 12.0), (1, 0, 13.0, 0.0, "c", 10.0), (1, 0, 30.0, 0.0, "d", 10.0)]
    rows = S.words_to_lines(spark.createDataFrame(words, "doc long, page long, top double, x0 double, text string, size double")).orderBy("line_no").collect()
    assert [(r.top, r.text, r["size"]) for r in rows] == [(10.0, "a b", 12.0), (13.0, "c", 10.0), (30.0, "d", 10.0)]
    assert S.body_size(spark.createDataFrame([(1, 10.0, "abc"), (1, 14.0, "ab"), (1, 14.0, "a")], "doc long, size double, text string")).first().body_size == 10.0


def test_overwritten_partitions_keep_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    S.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "a")], "v int, x string"), path, "v")
    for _ in range(2):
        S.overwrite_partitions(spark.createDataFrame([(2, "b")], "v int, x string"), path, "v")
    assert sorted((r.v, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_lines_of_words_stream_by_page(spark):
    rng = random.Random(5)
    words = [(rng.choice([1, 2, None]), rng.randrange(2), rng.choice([None, *(1.5 * i for i in range(60))]), rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([None, "é", "z", "𝄞", "ﬀ"]), rng.choice([None, 9.0, 12.0])) for _ in range(900)]
    first = lambda v: (v is not None, 0 if v is None else v)
    want, pages = [], {}
    for w in words:
        pages.setdefault(w[:2], []).append(w[2:])
    for page, own in pages.items():
        lines = []
        for w in sorted(own, key=lambda w: [first(v) for v in w]):
            if lines and (w[0] is None or lines[-1][0] is None or abs(w[0] - lines[-1][0]) <= 2.5):
                lines[-1][1].append(w[1:])
            else:
                lines.append((w[0], [w[1:]]))
        for i, (top, ws) in enumerate(lines):
            want.append((*page, i, top, " ".join(w[1] for w in sorted(ws, key=lambda w: [first(v) for v in w]) if w[1] is not None), max((w[2] for w in ws if w[2] is not None), default=None)))
    df = S.words_to_lines(spark.createDataFrame(words, "doc long, page long, top double, x0 double, text string, size double"))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
