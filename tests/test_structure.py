"""Structure and typed queries on small inputs: odd rows and what SQL compares on no given table."""

import json

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import analytics as A
from quillspark.operators import evidence as E
from quillspark.operators import retrieval as R
from quillspark.operators import structure as S


def test_headings_end_sections_of_their_level_and_deeper(spark):
    levels = [None, 1, 3, None, 2, 2, None, 1, 9]
    df = spark.createDataFrame([("d", i, lv, f"t{i}") for i, lv in enumerate(levels)], "doc string, n int, level int, text string")
    got = [r.heading_path for r in S.heading_paths(df, "doc", "n", "level", "text").orderBy("n").collect()]
    assert got == [[], ["t1"], ["t1", "t2"], ["t1", "t2"], ["t1", "t4"], ["t1", "t5"], ["t1", "t5"], ["t7"], ["t7", "t8"]]


def test_titles(spark):
    rows = [("a", 0, False, "short"), ("a", 5, True, " The name "), ("b", 0, False, "a long first line\nand more"), ("c", 0, False, "no"), ("c", 13, True, "too late a heading")]
    df = spark.createDataFrame(rows, "doc string, n int, head boolean, text string")
    got = dict(map(tuple, S.document_title(df, "doc", "n", F.col("head"), "text", "none").collect()))
    assert got == {"a": "The name", "b": "a long first line", "c": "none"}


def test_size_decides_after_labels_and_numbers(spark):
    rows = [("Plain words", 14.0, False, 1), ("Plain words", 12.0, False, 2), ("Plain words", 10.6, True, 3), ("ALL CAPS", 10.0, True, None), ("ALL CAPS", None, False, 2), ("Bold words", None, True, 3), ("2.1 Numbered", 10.0, False, 2), ("It ends.", 14.0, True, None), ("", 14.0, True, None), (None, 14.0, True, None)]
    df = spark.createDataFrame(rows, "line string, size double, bold boolean, want int")
    got = df.select(S.heading_by_font(F.col("line"), F.col("size"), F.lit(10.0), F.col("bold"))["level"].alias("level"), "want").collect()
    assert [r.level for r in got] == [r.want for r in got]


def test_json_keeps_order_and_says_what_it_leaves_out(spark):
    deep = 1
    for _ in range(9):
        deep = {"k": deep}
    values = [{"z": 1, "a": [None, {"b": "x"}], "e": {}, "f": []}, list(range(203)), deep, "s"]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(8, "{broken"), (9, None)], "id long, j string")
    got = {}
    for r in S.json_to_lines(df, "id", "j").orderBy("id", "line_no").collect():
        got.setdefault(r.id, []).append(r.line)
        assert r.block_no == r.line_no // 40
    assert got[0] == ["z: 1", "a[0]: None", "a[1].b: x"]
    assert got[1] == [*(f"[{i}]: {i}" for i in range(200)), ": (3 more items omitted)"]
    assert got[2] == ["k.k.k.k.k.k.k.k.k: (nested content omitted)"] and got[3] == ["value: s"] and set(got) == {0, 1, 2, 3}


def test_markdown_odd_texts(spark):
    texts = ["| a |\n| b |", "```\nopen\n\n# code", "x\n# H\ny\n\n| a |\n|---|\nafter", "", None, "```\na\n```\n```\nb\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in S.markdown_to_blocks(df, "id", "t").orderBy("id", "block_no").collect():
        got.setdefault(r.id, []).append((r.block_type, r.text))
    assert got == {
        0: [("paragraph", "| a |\n| b |")],
        1: [("code", "open\n\n# code")],
        2: [("paragraph", "x"), ("heading", "H"), ("paragraph", "y"), ("table", "| a |\n|---|"), ("paragraph", "after")],
        5: [("code", "a"), ("code", "b")],
    }


def test_delimited_odd_texts(spark):
    texts = ['n,"a ""b"", c"\n1,x\n,\n2,', "1,2\n3,4", " \n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, r.block_no): r.text for r in S.delimited_blocks(df, "id", "t").collect()}
    assert got == {(0, 0): 'Columns (2): n, a "b", c\nRows: 3', (0, 1): 'n: 1 | a "b", c: x\nn: 2', (1, 0): "Columns (2): column_1, column_2\nRows: 2", (1, 1): "column_1: 1 | column_2: 2\ncolumn_1: 3 | column_2: 4"}


def test_web_queries(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "fox red runs"), (3, "blue whale"), (4, "red deer blue"), (5, None)], "chunk_id long, text string")
    asked = {1: '"red fox"', 2: "red fox", 3: '"red fox" or whale', 4: "red -fox", 5: '-"fox red" fox', 6: "", 7: "-red", 8: '"unclosed red', 9: None}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    got = {}
    for r in R.web_search(queries, docs).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {1}, 2: {1, 2}, 3: {1, 3}, 4: {4}, 5: {1}}, got


def test_lists_of_empty_collections_add_nothing(spark):
    points = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(6)], "chunk_id long, collection int, embedding array<double>")
    variants = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "query_id long, variant int, embedding array<double>")
    a = R.fused_lists(variants, points, [0, 1, 5], 3).select("chunk_id", "rank").collect()
    assert sorted(r.chunk_id for r in a) == list(range(6)) and a and sorted(r.rank for r in a) == [1, 2, 3, 4, 5, 6]


def test_quotes_stand_in_their_source_in_any_case_and_spacing(spark):
    offered = spark.createDataFrame([(1, 1, 10, "The  red\nFox runs"), (1, 2, 11, None)], "query_id long, rank int, chunk_id long, content string")
    expected = spark.createDataFrame([(1, 10)], "query_id long, chunk_id long")
    cited = spark.createDataFrame([(1, 1, "RED fox"), (1, 1, "red dog"), (1, 2, "red"), (1, 9, "red"), (1, 1, " "), (1, 1, None)], "query_id long, marker int, quote string")
    got = sorted(tuple(r)[1:] for r in E.citation_correctness(cited, offered, expected).collect())
    assert got == sorted([(1, True, True, True, True), *[(1, True, False, True, False)] * 3, (2, True, False, False, False), (9, False, False, False, False)])


def test_queue_age_names_only_late_states(spark):
    jobs = spark.createDataFrame([("pending", "2025-01-01 00:00:00"), ("pending", "2025-01-01 00:19:00"), ("processing", "2025-01-01 00:10:00"), ("done", "2024-01-01 00:00:00"), (None, None)], "status string, at string")
    got = A.alert_queue_age(jobs, "at", "status", ("pending", "processing"), F.lit("2025-01-01 00:20:00")).collect()
    assert [tuple(r) for r in got] == [("pending", 20.0, 2)]


def test_quoted_line_ends_stay_in_their_cell(spark):
    texts = [(1, 'name,note\r\na,"one\ntwo, three"\r\n"b ""x""",plain\r\n'), (2, 'k,v\n1,"never closed\n2,b\n'), (3, 'k,v\n1,"' + "long " * 20_000 + '\nend"\n2,z')]
    got = {(r.id, r.block_no): r.text for r in S.delimited_blocks(spark.createDataFrame(texts, "id int, t string"), "id", "t").collect()}
    assert got[1, 1] == 'name: a | note: one\ntwo, three\nname: b "x" | note: plain'
    assert got[2, 1] == 'k: 1 | v: "never closed\nk: 2 | v: b'
    assert got[3, 0].endswith("Rows: 2") and got[3, 1].endswith("end\nk: 2 | v: z")


def test_numbering_and_titles_of_headings(spark):
    lines = {"2.1 Scope of work": (2, "2.1", "Scope of work"), "IV. Termination": (1, "IV", "Termination"), "Appendix B: Rates": (1, "B", "Rates"), "Chapter 3": (1, "3", "Chapter 3"), "GENERAL TERMS": (2, None, "GENERAL TERMS"), "1) First": (1, "1", "First")}
    df = spark.createDataFrame([(k,) for k in [*lines, "A sentence that ends.", ""]], "t string")
    got = {r.t: r.h and (r.h.level, r.h.numbering, r.h.title) for r in df.select("t", X.heading_parts(F.col("t")).alias("h")).collect()}
    assert got == {**lines, "A sentence that ends.": None, "": None}


def test_delimited_texts_are_taken_apart_once(spark):
    df = S.delimited_blocks(spark.createDataFrame([(1, "a,b\n1,2")], "id int, t string"), "id", "t")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
