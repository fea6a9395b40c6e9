import numpy as np
import pytest

from quillspark.llm import ann
from quillspark.llm.queries import op7_ann


def brute(rows, k, step=20):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % step == 0:
            out[i] = sorted(((-float((w * v).sum()), j) for j, w in ok if j != i))[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, best in want.items():
        own = sorted(found.get(q, []))
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
        assert all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
        hits += len({j for _, j in best} & {x[1] for x in own})
        total += len(best)
    return hits / total


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(op7_ann(spark, sf).collect(), brute(rows, 20)) >= 0.9


def test_recall_over_many_blocks(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(ann.search(df, df.filter("vec_id % 100 = 0"), 20, block_rows=150).collect(), brute(rows, 20, 100)) >= 0.9


def test_queries_go_only_where_candidates_can_be(spark, monkeypatch):
    """Vectors that gather: a query is sent to few of the blocks, and finds its neighbours."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((16, 32))[rng.integers(0, 16, 6400)] + 0.05 * rng.standard_normal((6400, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    searched = ann._searched

    def counted(filed, asked, n, *rest):
        sent.append((asked.count(), n))
        return searched(filed, asked, n, *rest)

    monkeypatch.setattr(ann, "_searched", counted)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 20, block_rows=100).collect()
    assert recall(got, brute(rows, 20)) >= 0.9
    (first, n), (second, _) = sent
    assert first == 320 and n >= 64 and second < 320 * n / 5


@pytest.mark.parametrize("kind", ["clusters", "norms", "copies"])
def test_recall_on_other_shapes(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((2000, 16))
    if kind == "clusters":
        v = rng.standard_normal((40, 16))[rng.integers(0, 40, 2000)] + 0.2 * v
    elif kind == "norms":
        v *= rng.uniform(0.2, 4, (2000, 1))
    else:
        v = np.repeat(v[:100], 20, axis=0)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(ann.search(df, df.filter("vec_id % 20 = 0"), 20, block_rows=700).collect(), brute(rows, 20)) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (None, [1.0, 1.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
