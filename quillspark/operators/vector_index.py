"""A stored, pruned index of vectors: points in folders by cell, codes of a byte a component, exact rescoring.

Building assigns every point to the nearest of about sqrt(n) centres, so cells stay about as large as there are cells, and
writes points by cell with a byte code scaled by each dimension's own quantile. A search picks each query's nearest cells
and reads only their folders; codes choose a short list of each query and cell, whole vectors decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import top

#: Most points to fit centres on for each cell, and most cells: centres and bounds are sent to every task.
PER_CELL, MOST_CELLS = 64, 16_384
SHARE = 0.99
#: Files and tasks over which a cell's points are dealt.
PARTS = 4
#: Points scored at once.
BLOCK = 4096


@dataclass(frozen=True)
class Index:
    path: str
    centres: np.ndarray
    bounds: np.ndarray


def _vectors(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).cast(pa.float64()))
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first, the lower number on ties."""
    far = (centres**2).sum(1)[None, :] - 2 * vectors @ centres.T
    return np.argsort(np.round(far, 9), axis=1, kind="stable")[:, :n]


def _whole(points: DataFrame) -> DataFrame:
    """Points with a vector of finite components."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.filter(ok).withColumn("embedding", F.col("embedding").cast("array<double>"))


def build(points: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> Index:
    """Write points(chunk_id, embedding, ...) to path by cell. Centres are fitted on at most PER_CELL points a cell, each
    dimension's bound is the SHARE quantile of all points. Vectors that are null or not finite are left out."""
    rows = _whole(points)
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
    some = rows.orderBy(F.xxhash64("chunk_id")).limit(cells * PER_CELL).select(array_to_vector("embedding").alias("features"))
    centres = np.array(KMeans(k=max(2, cells), seed=seed, maxIter=10).fit(some).clusterCenters()) if n > 1 else np.zeros((1, 1))
    each = rows.select(F.posexplode("embedding").alias("axis", "x")).groupBy("axis").agg(F.percentile_approx(F.abs("x"), SHARE, 10_000).alias("b"))
    bounds = np.array([r["b"] for r in each.orderBy("axis").collect()] or [1.0])
    bounds = np.where(bounds > 0, bounds, 1.0)
    names = [c for c in rows.columns if c not in ("cell", "code")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(names.index("embedding")))
            if not len(v):
                continue
            code = np.clip(np.round(v / bounds * 127), -127, 127).astype(np.int8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(code.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_cells(v, centres, 1)[:, 0], pa.int32()), lists], [*names, "cell", "code"])

    filed = rows.select(*names).mapInArrow(work, f"{schema}, cell int, code array<tinyint>")
    # a cell that holds more than others is written by several tasks
    filed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS))).write.mode("overwrite").partitionBy("cell").parquet(path)
    return Index(path, centres, bounds)


def probes(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """(query_id, q, cell): each query's nprobe nearest cells."""
    asked = _whole(queries).select("query_id", F.col("embedding").alias("q"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(1))
            if not len(v):
                continue
            near = nearest_cells(v, index.centres, nprobe)
            row = pa.array(np.repeat(np.arange(len(v)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(near.reshape(-1), pa.int32())], ["query_id", "q", "cell"])

    return asked.mapInArrow(work, f"query_id {asked.schema['query_id'].dataType.simpleString()}, q array<double>, cell int")


def read_cells(spark: SparkSession, index: Index, cells: list[int]) -> DataFrame:
    """The stored points of some cells; only their folders are listed as partitions to read."""
    return spark.read.parquet(index.path).filter(F.col("cell").isin(cells))


def search(queries: DataFrame, index: Index, k: int, nprobe: int, oversample: float = 2.0) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k most alike (cosine) of the points in each query's nprobe nearest cells.

    Queries and points of a cell meet in one group of tasks, points as a stream of blocks behind the cell's queries; codes
    keep the oversample * k best of each block, whole vectors score those. A cell's points are dealt over PARTS tasks, so
    a hot cell is not one task's; its queries go to each.
    """
    spark = queries.sparkSession
    asked = probes(queries, index, nprobe)
    # at most as many numbers as the index has cells
    cells = sorted(r["cell"] for r in asked.select("cell").distinct().collect())
    stored = read_cells(spark, index, cells)
    kind, chunk = asked.schema["query_id"].dataType.simpleString(), stored.schema["chunk_id"].dataType.simpleString()
    sides = asked.select("cell", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(chunk).alias("chunk_id"), F.col("q").alias("v"), F.lit(None).cast("array<tinyint>").alias("code"))
    sides = sides.unionByName(stored.select("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("query_id"), "chunk_id", F.col("embedding").alias("v"), "code"))
    take, scale = int(k * oversample), index.bounds / 127

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, q, unit = None, [], [], None
        for f in frames:
            for (cell, part), g in f.groupby(["cell", "part"], sort=False):
                if (cell, part) != now:
                    now, ids, q = (cell, part), [], []
                own = g[g["kind"] == 0]
                if len(own):
                    ids += own["query_id"].tolist()
                    q += [np.asarray(x, float) for x in own["v"]]
                    unit = np.stack(q) / np.maximum(np.linalg.norm(np.stack(q), axis=1, keepdims=True), 1e-300)
                rows = g[g["kind"] == 1]
                for a in range(0, len(rows) if ids else 0, BLOCK):
                    some = rows.iloc[a : a + BLOCK]
                    v = np.stack([np.asarray(x, float) for x in some["v"]])
                    norm = np.linalg.norm(v, axis=1)
                    rough = unit @ (np.stack([np.asarray(x, float) for x in some["code"]]) * scale).T / np.maximum(norm, 1e-300)
                    best = np.argsort(-rough, axis=1, kind="stable")[:, :take]
                    exact = np.einsum("qd,qkd->qk", unit, v[best]) / np.maximum(norm[best], 1e-300)
                    yield pd.DataFrame({"query_id": np.repeat(np.array(ids, object), best.shape[1]), "chunk_id": some["chunk_id"].to_numpy()[best.reshape(-1)], "score": np.where(norm[best] > 0, exact, 0.0).reshape(-1)})

    met = sides.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "chunk_id").mapInPandas(work, f"query_id {kind}, chunk_id {chunk}, score double")
    return top(met, "query_id", "score", "chunk_id", k)
