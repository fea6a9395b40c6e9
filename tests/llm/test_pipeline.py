import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quillspark.llm.queries import tokenizer_path

from .test_suffix import brute


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, top = [docs], tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"file://{top}/{i}")
        out.append(spark.read.parquet(f"file://{top}/{i}"))
    return sf, out


def test_stages_keep_the_columns(staged):
    _, out = staged
    assert all(d.columns == out[0].columns for d in out[1:-1])


def test_the_classifier_keeps_good_documents(spark, staged):
    sf, out = staged
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rate = lambda q: out[1].join(labels, "doc_id").filter(F.col("quality") == q).count() / out[0].join(labels, "doc_id").filter(F.col("quality") == q).count()
    assert rate(1) >= 0.97 and rate(0) <= 0.3


def test_no_copy_is_left(staged):
    _, out = staged
    assert out[2].count() == out[2].select("doc_id").distinct().count() == out[2].select("text").distinct().count()
    assert out[2].join(out[1], "doc_id", "left_anti").count() == 0


def test_repeats_are_gone(staged):
    _, out = staged
    want = brute([(r.doc_id, r.text) for r in out[2].select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in out[3].collect()}
    assert set(got) == set(want)
    for k, (size, gone, _, _) in want.items():
        assert size - gone - 6 * len(got[k].text) <= len(got[k].text.encode()) <= size - gone
        assert got[k].n_chars == len(got[k].text)


def test_the_mix_repeats_and_the_encoding_is_the_library_s(staged):
    from tokenizers import Tokenizer

    _, out = staged
    kept = {r.doc_id: r.text for r in out[3].collect()}
    assert {r.doc_id for r in out[4].collect()} <= set(kept)
    assert max(r["count"] for r in out[4].groupBy("doc_id").count().collect()) <= 3
    t = Tokenizer.from_file(tokenizer_path())
    rows = out[5].collect()
    assert len(rows) == out[4].count()
    for r in rows:
        assert r.n_tokens == len(r.ids)
    for r in {r.doc_id: r for r in rows}.values():
        assert r.ids == t.encode(kept[r.doc_id], add_special_tokens=False).ids


def test_run_gives_what_the_stages_give(spark, staged):
    sf, out = staged
    plain = lambda df: sorted((r.doc_id, r.source or "", r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert plain(C.run(spark, sf)) == plain(out[-1])


def test_odd_rows(spark, tmp_path):
    long = "some words that stand here and there in a row of words for this test of ours " * 3
    rows = [(None, long, "en", None, 1), (1, long + "x", "en", "a", 2), (1, None, None, "a", 3), (1, None, None, "a", 3), (2, "", "en", "b", 0), (3, "\ufffd" + long, "en", "b", 5)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _score int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rest in (docs, docs.limit(0)):
        now = rest
        for _, stage in C.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        got = C.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert (len(got) > 0) == (rest is docs)
