"""Queries and rules that differed from their SQL on larger tables."""

import datetime as dt
import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import evidence as E
from quillspark.operators import lexical as L
from quillspark.operators import retrieval as S
from quillspark.plans import registered
from quillspark.plans.streams import _files, _path
from quillspark.streaming import rollups as R

from .compare import same

QUERIES, ORACLES = registered()


def over(tmp_path, spark, **tables):
    """(folder, DuckDB connection) of given tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def test_a_quote_cut_before_a_line_end(spark, tmp_path):
    rows = [(1, 1, 0, "x" * 390 + " endofit\n" + "y" * 50, 1.0), (1, 2, 0, "x" * 390 + " end" + "y" * 50, 1.0)]
    got = {r.chunk_id: r.quote for r in E.best_quote(spark.createDataFrame(rows, "query_id int, chunk_id int, sent_no int, text string, score double")).collect()}
    cut = lambda q: duckdb.execute(r"SELECT regexp_replace(?[1:400], ' \S*$', '') || '…'", [q]).fetchall()[0][0]
    assert got == {r[1]: cut(r[3]) for r in rows}
    ends = "x" * 394 + " abcd\n" + "y" * 50
    got = E.best_quote(spark.createDataFrame([(1, 1, 0, ends, 1.0)], "query_id int, chunk_id int, sent_no int, text string, score double")).first().quote
    assert ends[399] == "\n" and got == cut(ends) == ends[:400] + "…"


def test_injected_instructions_behind_long_and_null_texts_are_flagged(spark, tmp_path):
    docs = spark.createDataFrame([(0, "word " * 20_000), (10, None), (1, None), (2, "a")], "doc_id long, text string")
    d, con = over(tmp_path, spark, documents=docs)
    same(spark, con, d, QUERIES["grd2_flags"], ORACLES["grd2_flags"])


def test_secrets_by_shape(spark, tmp_path):
    block = "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    docs = spark.createDataFrame(list(enumerate(['api_key = "abcdefgh1234"', "AKIA" + "A1B2" * 4, block, "none", None])), "doc_id long, text string")
    d, con = over(tmp_path, spark, documents=docs)
    got = {r.doc_id: r.found for r in QUERIES["grd4_secrets"](spark, d).collect()}
    assert got[0] == got[3] == "" and got[1] == "aws_access_key_id" and got[2] == "private_key"
    same(spark, con, d, QUERIES["grd4_secrets"], ORACLES["grd4_secrets"].replace(" AS t FROM documents)", " AS t FROM documents WHERE text IS NOT NULL)") + " UNION ALL SELECT doc_id, '', NULL FROM documents WHERE text IS NULL")
    # the operators take assignments and whole blocks away as before
    both = docs.select("doc_id", X.secret_scan(F.col("text")).alias("s"), X.redact(F.col("text")).alias("r"))
    assert {r.doc_id: (r.s, r.r) for r in both.filter("doc_id IN (0, 2)").collect()} == {0: (["assigned_secret"], 'api_key = "[redacted]"'), 2: (["private_key"], "[redacted]")}


def test_stages_of_queries_with_many_hits(spark):
    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    same(spark, con, d, QUERIES["lst7_stages"], ORACLES["lst7_stages"])


@pytest.mark.parametrize("name", ["str3_coarser", "str3_percentiles", "alr6_live"])
def test_quantiles_of_windows_with_more_values_than_a_sketch_holds(spark, tmp_path, name):
    rng, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i * 86_400 // 30_000), i % 50, "view", rng.choice([None, round(rng.lognormvariate(5, 1), 2)]), "{}") for i in range(30_000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    d, con = over(tmp_path, spark, events=events)
    same(spark, con, d, QUERIES[name], ORACLES[name])


def test_exact_quantiles_of_a_rollup(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 5, 1, 12)
    values = [rng.choice([None, math.nan, -1.0, 0.5, 2.0]) if i % 3 else float(i) for i in range(999)]
    rows = spark.createDataFrame([(t0 + dt.timedelta(minutes=i % 90), "view", v, i % 3) for i, v in enumerate(values)], "ts timestamp, event_type string, value double, file int")
    path, keys = _path(spark), ["event_type"]
    R.rollup_stream(_files(spark, rows, F.col("file"), 3), path, late="1 day", k=8, exact=True).awaitTermination()
    got = R.exact_quantiles(R.coarser_values(R.values(spark, path, keys), 1440, keys), keys, {"low": 0.01, "p50": 0.5, "p95": 0.95, "all": 1.0}).first()
    own = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    for name, q in {"low": 1, "p50": 50, "p95": 95, "all": 100}.items():
        want = own[max(1, -(-len(own) * q // 100)) - 1]
        assert got[name] == want or (want != want and got[name] != got[name])


def test_a_batch_of_a_stream_is_written_by_several_tasks(spark):
    rows = spark.range(0, 4000, 1, 5).withColumn("file", F.when(F.col("id") < 10, 1).otherwise(F.col("id") % 2 * 2))
    stream, seen = _files(spark, rows, F.col("file"), 4), []

    def put(batch, number):
        files = batch.select(F.input_file_name().alias("f")).distinct().count()
        seen.append((number, files, sorted(r.file for r in batch.select("file").distinct().collect()), batch.count()))

    stream.writeStream.option("checkpointLocation", _path(spark)).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    # the rows of part 1 are in one partition, part 3 has none
    assert seen == [(0, 5, [0], 1995), (1, 1, [1], 10), (2, 5, [2], 1995), (3, 0, [], 0)]


@pytest.mark.parametrize("name", ["chk10_semantic", "chk18_keywords", "chk2_paragraphs"])
def test_what_depends_on_one_document_shuffles_nothing(spark, tmp_path, name):
    odd = "Ünder cat\n \ncat dog dog\ncat\n\nrocket ½ 12 dog\x85x\n" * 3
    docs = spark.createDataFrame([(1, odd), (2, None), (3, ""), (4, "one two"), (5, "the and\nof\nto\nfor"), (6, "ab\nab\nab\ncd")], "doc_id long, text string")
    d, con = over(tmp_path, spark, documents=docs)
    same(spark, con, d, QUERIES[name], ORACLES[name])
    assert "Exchange" not in QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_cited_chunks_are_joined_once(spark, sf, duck):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    cited = rows([(1, 1, " A  b"), (1, 2, "no"), (1, 9, "a b"), (2, 1, None), (2, 2, "c")], "query_id long, marker int, quote string")
    offered = rows([(1, 1, 5, "x a B y"), (1, 2, 6, "z"), (2, 1, 5, "x a B y"), (2, 2, 7, None)], "query_id long, rank int, chunk_id long, content string")
    wanted, texts = offered.filter("chunk_id <> 6"), offered.filter("query_id = 1 OR chunk_id = 7").select("chunk_id", "content")
    for fuzzy in (False, True):
        want = sorted(map(tuple, E.citation_correctness(cited, offered, wanted, fuzzy).collect()))
        assert sorted(map(tuple, E.citation_correctness(cited, offered.drop("content"), wanted, fuzzy, texts).collect())) == want
    same(spark, duck, sf, QUERIES["evl4_quotes"], ORACLES["evl4_quotes"])
    # no text passes the ranking
    for name in ("evl4_quotes", "ctx5_assemble"):
        plan = QUERIES[name](spark, sf)._sc._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, sf)._jdf.queryExecution(), "formatted")
        inputs = re.findall(r"\) Window\n(?:Input.*: \[(.*)\])", plan)
        assert inputs and not any("content#" in i or "text#" in i for i in inputs)


@pytest.mark.parametrize("name", ["ret3_sparse", "ret4_keyword"])
def test_tasks_of_a_sparse_search_hold_few_texts(spark, duck, sf, monkeypatch, name):
    monkeypatch.setattr(L, "TEXTS", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert L.by_text(docs, "doc_id", "text").rdd.getNumPartitions() == -(-docs.count() // 7) > 4
    same(spark, duck, sf, QUERIES[name], ORACLES[name])


def test_excluded_terms_are_looked_up_for_hits_only(spark):
    hits = spark.createDataFrame([(1, 5, 1.0), (1, 6, 3.0), (2, 5, 1.0)], "query_id long, chunk_id long, score double")
    terms = spark.createDataFrame([("a", 5), ("a", 7), ("b", 6), ("b", 5)], "term string, chunk_id long")
    bad = spark.createDataFrame([(1, "a"), (2, "c"), (3, "a")], "query_id long, term string")
    assert sorted(map(tuple, S.keyword_search(hits, terms, bad).collect())) == [(1, 6, 0.75), (2, 5, 0.5)]


def test_texts_are_cut_before_they_meet_queries(spark, sf):
    for name in ("ctx1_sentences", "ctx2_compress", "ctx2_rules", "ctx3_stats"):
        plan = registered()[0][name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        # a plan is printed from its top: what stands below the join runs once a text
        assert "split(" in plan and plan.index("Join Inner") < plan.index("split("), name


ODD_TEXTS = [None, "", "a the of", "Istanbul İstanbul 5K ΣΑΣ", "node-7.example_x/y--z. A-B a-b a", "über straße 12.5% x\u0000y   z", "w " * 300 + "en de en", "中文 ୲௰ ½ café"]


def test_bags_count_what_the_index_counts(spark):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")
    want = {i: list(t) for i, t in df.select("id", X.index_terms(F.col("text"))).collect()}
    wanted = frozenset(["en", "z", "stanbul", "5k", "never"])
    for only in (None, wanted):
        for r in L.bags(df, "id", "text", only).collect():
            words = want[r.id]
            assert r.bag == {"": len(words)} | {w: words.count(w) for w in words if only is None or w in only}
    posts = sorted((i, w, t.count(w), len(t)) for i, t in want.items() for w in set(t))
    assert sorted(map(tuple, L.postings(df, "id", "text").select("id", "term", "tf", "length").collect())) == posts
    assert tuple(L.corpus_stats(df, "text").first()) == (len(ODD_TEXTS), sum(map(len, want.values())) / len(ODD_TEXTS))
    assert tuple(L.corpus_stats(df.limit(0), "text").first()) == (0, L.DEFAULT_LENGTH)


def test_hashed_vectors_do_not_depend_on_what_a_task_remembers(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")

    def plain(text, dim=16):
        v = [0.0] * dim
        for term in L.TERM.findall((text or "").lower()):
            if term not in L.STOP:
                h = hashlib.md5(term.encode()).hexdigest()
                v[int(h[:8], 16) % dim] += 1 if int(h[8], 16) % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else [1.0] + v[1:]

    for most in (200_000, 2):
        monkeypatch.setattr(L, "KNOWN_TERMS", most)
        for r in L.hash_embed(df, "id", "text", 16).collect():
            assert r.vector == pytest.approx(plain(ODD_TEXTS[r.id]), abs=1e-12)


def test_a_sparse_search_cuts_texts_once(spark, duck, sf, tmp_path):
    df = QUERIES["ret3_sparse"](spark, sf)
    df.collect()
    cut = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    cut = cut[: cut.index("Initial Plan")] if "Initial Plan" in cut else cut
    # one pass reads texts; its counts are shuffled, and no text is
    assert cut.count("MapInArrow") == 1 and "ReusedExchange" in cut
    assert not re.search(r"Exchange hashpartitioning\(.*text", cut)
    # rows of one id count as one text's, as in the SQL
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    twice = docs.unionByName(docs.filter("doc_id % 9 = 0"))
    folder, con = over(tmp_path, spark, documents=twice, benchmark=spark.read.parquet(f"{sf}/benchmark.parquet"))
    same(spark, con, folder, QUERIES["ret3_sparse"], ORACLES["ret3_sparse"])


@pytest.mark.parametrize("name", ["ret3_sparse", "ret6_hybrid"])
def test_many_queries_pick_their_terms_by_a_join(spark, duck, sf, monkeypatch, name):
    monkeypatch.setattr(L, "SENT_QUERIES", 0)
    same(spark, duck, sf, QUERIES[name], ORACLES[name])
