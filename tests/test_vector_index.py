import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import vector_index as V


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "chunk_id long, embedding array<double>")


def exact(v, q, k):
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    score = unit @ (v[q] / np.linalg.norm(v[q]))
    return set(np.lexsort((np.arange(len(v)), -np.round(score, 9)))[:k].tolist())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16)) * 3
    return np.concatenate([c + rng.normal(size=(60, 16)) for c in centres]) * np.linspace(0.01, 4, 16)


def test_recall_and_files_read(spark, tmp_path, clustered):
    points = frame(spark, clustered)
    index = V.build(points, f"file://{tmp_path}/index")
    queries = points.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in V.search(queries, index, 10, 8).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    shares = [len(got[q] & exact(clustered, q, 10)) / 10 for q in got]
    assert len(got) == 36 and np.mean(shares) >= 0.9
    stored = spark.read.parquet(index.path)
    assert stored.count() == len(clustered) and len(index.centres) == 60
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    cells = [r.cell for r in V.probes(queries.limit(1), index, 8).collect()]
    assert len(cells) == 8 and files(V.read_cells(spark, index, cells)) <= files(stored) / 4
    plan = V.read_cells(spark, index, cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("#", " ").replace("  ", " ") or "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_cells_grow_with_the_table(spark, tmp_path, clustered):
    assert [len(V.build(frame(spark, clustered[:n]), f"file://{tmp_path}/i{n}").centres) for n in (100, 900)] == [10, 30]


def test_bounds_are_each_dimensions_own(spark, tmp_path, clustered):
    index = V.build(frame(spark, clustered), f"file://{tmp_path}/index")
    assert index.bounds[0] * 50 < index.bounds[-1]
    code = np.array([r.code for r in spark.read.parquet(index.path).select("code").limit(500).collect()])
    assert all(np.abs(code).max(0) > 60) and code.min() >= -127


def test_odd_vectors_repeats_and_ties(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 0.0]), (101, None), (102, []), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (105, [None, 1.0]), (106, [0.0, 2.0]), (106, [0.0, 2.0])]
    points = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id long, embedding array<double>, code int")
    index = V.build(points, f"file://{tmp_path}/index", cells=3)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    got = sorted(tuple(r) for r in V.search(asked, index, 3, 3).collect())
    assert [r[:2] for r in got if r[0] == 1] == [(1, 0), (1, 1), (1, 2)] and [r[1] for r in got if r[0] == 2][1:] == [106, 106]
    assert V.search(asked.limit(0), index, 3, 3).count() == 0
