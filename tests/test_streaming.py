import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.plans.streams import _files, _path
from quillspark.streaming import ingest as I
from quillspark.streaming import jobs as J
from quillspark.streaming import rollups as R

T0 = dt.datetime(2024, 5, 1, 12, 0)
EVENTS = "ts timestamp, event_type string, value double, file int"


def stream_of(spark, rows, files):
    return _files(spark, spark.createDataFrame(rows, EVENTS), F.col("file"), files)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_late_rows_inside_and_outside_the_watermark(spark):
    rows = [(at(1), "view", 1.0, 0), (at(30), "view", 5.0, 0)]
    # the watermark of the second batch is 12:20; the window from 12:15 ended there, that from 12:20 is open
    rows += [(at(22), "view", 7.0, 1), (at(19), "view", 9.0, 1), (at(31), "view", None, 1), (None, "view", 1.0, 1)]
    path = _path(spark)
    R.rollup_stream(stream_of(spark, rows, 2), path).awaitTermination()
    got = {r.start: (r.n, r.total) for r in R.rollups(spark, path, ["event_type"]).collect()}
    assert got == {at(0): (1, 1.0), at(20): (1, 7.0), at(30): (2, 5.0)}
    assert [(r.start, r.late) for r in R.late_rows(spark, path, ["event_type"]).collect()] == [(at(15), 1)]
    p = {r.start: r.p for r in R.rollups(spark, path, ["event_type"]).select("start", R.quantile(F.col("sketch"), 0.5).alias("p")).collect()}
    assert p[at(30)] == 5.0


def test_a_repeated_batch_changes_nothing(spark):
    rows = [(at(i), "view", float(i), i % 3) for i in range(300)]
    path = _path(spark)
    source = spark.createDataFrame(rows, EVENTS)
    take = lambda n: R.rollup_batch(source.filter(F.col("file") == n), n, path, "ts", ["event_type"], "value", 60, "1 hour", 256)
    for n in (0, 1, 2):
        take(n)
    read = lambda: sorted((r.start, r.n, r.total) for r in R.rollups(spark, path, ["event_type"]).collect())
    before, late = read(), sorted(map(tuple, R.late_rows(spark, path, ["event_type"]).collect()))
    take(1)
    assert read() == before and sorted(map(tuple, R.late_rows(spark, path, ["event_type"]).collect())) == late


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_rank_error_of_merged_sketches(spark, duck, q):
    rng = random.Random(3)
    values = [rng.lognormvariate(3, 1) for _ in range(20_000)]
    rows = [(at(i % 50), "view", v, i % 4) for i, v in enumerate(values)]
    path = _path(spark)
    R.rollup_stream(stream_of(spark, rows, 4), path, late="1 day", k=200).awaitTermination()
    hour = R.coarser(R.rollups(spark, path, ["event_type"]), 60, ["event_type"])
    got = hour.select("n", R.quantile(F.col("sketch"), q).alias("p")).first()
    assert got.n == len(values)
    exact = duck.execute("SELECT quantile_disc(v, ?) FROM (SELECT unnest(?) AS v)", [q, values]).fetchone()[0]
    rank = sum(v <= got.p for v in values) / len(values)
    assert abs(rank - q) <= 0.03 and abs(sum(v <= exact for v in values) / len(values) - rank) <= 0.03


def test_each_text_is_embedded_once_over_batches(spark):
    rows = [(i, f"text {i % 10}" if i % 4 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls = []

    def embed(df):
        calls.append(df.count())
        return df.select("key", F.array(F.length("text")).alias("vector"))

    path = _path(spark)
    I.embed_stream(_files(spark, docs, F.col("doc_id") % 3, 3), path, "m", 1, embed).awaitTermination()
    made = spark.read.parquet(f"{path}/vectors")
    assert len(calls) == 3 and sum(calls) == made.count() == len({t for _, t in rows if t})
    before = sorted((r.key, r.batch) for r in made.collect())
    I.embed_batch(docs.filter("doc_id % 3 = 1"), 1, path, "m", 1, embed)
    assert sorted((r.key, r.batch) for r in spark.read.parquet(f"{path}/vectors").collect()) == before
    I.embed_batch(docs.limit(0), 3, path, "m", 1, embed)
    assert spark.read.parquet(f"{path}/vectors").count() == len(before)


def test_the_last_change_wins_inside_and_across_batches(spark):
    points = spark.createDataFrame([(1, 10, "internal", 0, "a"), (2, 10, "internal", 0, "a"), (3, 11, "internal", 0, "a"), (4, 12, "customer", 3, None)], "chunk_id long, document_id long, mode string, visibility_level long, department_path string")
    change = lambda doc, m, seq, level: (doc, at(m), seq, "customer", level, None)
    schema = "document_id long, changed_at timestamp, seq long, mode string, visibility_level long, department_path string"
    path = _path(spark)
    batches = [[change(10, 5, 1, 1), change(10, 5, 2, 2)], [change(10, 4, 3, 3), change(11, 9, 4, 4), change(None, 9, 5, 4)], [change(11, 9, 4, 4), change(99, 1, 6, 1)]]
    for _ in range(2):  # all batches again: nothing changes
        for n, rows in enumerate(batches):
            I.patch_batch(spark.createDataFrame(rows, schema), n, points, path)
        got = {r.chunk_id: (r.mode, r.visibility_level, r.department_path) for r in I.access_now(points, path).collect()}
        assert got == {1: ("customer", 2, None), 2: ("customer", 2, None), 3: ("customer", 4, None), 4: ("customer", 3, None)}
        assert spark.read.parquet(f"{path}/patched").count() == 3


def test_event_order(spark):
    kinds = {1: ["meta", "token", "token", "usage", "done"], 2: ["meta", "citations", "error"], 3: ["token", "done"], 4: ["meta", "token"], 5: ["meta", "done", "token"], 6: ["meta", "usage", "token", "done"], 7: ["meta", None, "done"], 8: ["meta"], 9: ["meta", "citations", "citations", "done"]}
    rows = [(s, i, k) for s, own in kinds.items() for i, k in enumerate(own)]
    got = {r.s: (r.n, r.ok) for r in J.check_event_order(spark.createDataFrame(rows, "s int, i int, k string"), "s", "i", "k").collect()}
    assert {s for s, (_, ok) in got.items() if ok} == {1, 2} and got[1] == (5, True) and got[7] == (3, False)


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError):
        _path(Session)


def test_ingest_cleans_once(spark, tmp_path, monkeypatch):
    calls, clean = [], I.X.clean_text
    monkeypatch.setattr(I.X, "clean_text", lambda c, *a: calls.append(1) or clean(c, *a))
    spark.createDataFrame([(1, " One  sentence of enough length. "), (2, "short"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    source = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/docs")
    I.ingest_stream(source, f"{tmp_path}/out").awaitTermination()
    assert len(calls) == 1
    assert {(r.doc_id, r.status) for r in spark.read.parquet(f"{tmp_path}/out/status/*").collect()} == {(1, "indexed"), (2, "rejected"), (3, "rejected")}
    assert [r.content for r in spark.read.parquet(f"{tmp_path}/out/chunks/*").collect()] == ["One sentence of enough length."]
