import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import plugins as P
from quillspark.operators import approximate as A
from quillspark.operators import maintenance as M
from quillspark.operators import retrieval as R


def test_an_embedder_of_wrong_dimension_fails(spark):
    P.register_embedder("bad", lambda texts: np.zeros((len(texts), 3)), 2)
    with pytest.raises(Exception, match="wrong number or dimension"):
        spark.createDataFrame([("a",)], "t string").select(P.embed("bad", F.col("t"))).collect()


def test_knn_refuses_other_dimensions(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimension"):
        R.knn(q, p, 1).collect()


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_knn_equals_brute_force_over_blocks(spark, monkeypatch, metric):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    asked = v[:40]
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "POINT_BLOCK", 16)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, embedding array<double>")
    p = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(v)], (999, None)], "chunk_id long, embedding array<double>")
    got = {}
    for r in R.knn(q, p, 10, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    norm = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
    s = {"dot": 1 + asked @ v.T, "euclid": 1 - np.linalg.norm(asked[:, None] - v[None], axis=2), "cosine": np.where(norm > 0, asked @ v.T / np.where(norm > 0, norm, 1), 0)}[metric]
    for i in range(40):
        best = sorted(range(300), key=lambda j: (-round(s[i, j], 9), j))[:10]
        assert got[i] == [(j, pytest.approx(s[i, j], abs=2e-6)) for j in best]
    assert R.knn(q.limit(0), p, 3).count() == R.knn(q, p.limit(0), 3).count() == 0


def test_cells_and_codes_find_the_near_ones(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.filter("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    exact = R.knn(q, e, 10)
    assert A.recall(A.knn_quantized(q, e, 10, 64), exact).first().recall >= 0.95
    assert A.recall(A.approx_knn(q, e, 10, A.fit_cells(e, 8), nprobe=8), exact).first().recall == 1.0


def test_mmr_prefers_difference(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0])]
    got = A.mmr(spark.createDataFrame(rows, "query_id long, chunk_id long, score double, embedding array<double>"), 2)
    assert [r.chunk_id for r in got.orderBy("place").collect()] == [1, 3]


def test_upsert_rejects_a_wrong_dimension(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "k int, embedding array<double>")
    good = spark.createDataFrame([(2, [3.0, 4.0], 1), (2, [5.0, 6.0], 2), (3, [0.0, 0.0], 1)], "k int, embedding array<double>, seq int")
    assert sorted((r.k, r.embedding[0]) for r in M.upsert(t, good, "k", "seq", 2).collect()) == [(1, 1.0), (2, 5.0), (3, 0.0)]
    with pytest.raises(Exception, match="wrong dimension"):
        M.upsert(t, good.withColumn("embedding", F.array(F.lit(1.0))), "k", "seq", 2).collect()


def test_cells_score_no_pair_as_a_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i == 7 else [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 6)))]
    e = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q, model = e.filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id"), A.fit_cells(e.filter("embedding IS NOT NULL"), 4)
    found = A.approx_knn(q, e, 3, model, nprobe=2)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()}
    v, centres = np.array([r[1] or [np.nan] * 6 for r in rows]), np.array(model.clusterCenters())
    near = np.argsort(((v[:, None] - centres) ** 2).sum(-1), axis=1, kind="stable")
    s = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    for i in range(0, 600, 5):
        own = [j for j in range(600) if j != 7 and near[j, 0] in near[i, :2]]
        best = sorted(own, key=lambda j: (-round(s[i, j], 9), j))[:3]
        assert [got[i, r + 1][0] for r in range(3)] == best and got[i, 1][1] == pytest.approx(1.0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
