"""Approximate search and clustering of vectors: inverted cells, int8 codes, diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import knn, nearest, top
from .vector_index import nearest_cells


def fit_cells(points: DataFrame, cells: int, sample: float = 1.0, seed: int = 7) -> KMeansModel:
    """Centres of `cells` cells, fitted on a share of the points."""
    data = points if sample >= 1 else points.sample(sample, seed)
    return KMeans(k=cells, seed=seed, featuresCol="features", maxIter=10).fit(data.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))


def _filed(df: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    """(cell, id, v): vectors with each of their n nearest cells; null ones have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            if (np.diff(np.asarray(lists.offsets)) != centres.shape[1]).any():
                raise ValueError("a vector's dimension differs from the centres'")
            near = nearest_cells(np.asarray(lists.flatten()).reshape(-1, centres.shape[1]), centres, n)
            row = pa.array(np.repeat(np.arange(len(lists)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1), pa.int32()), batch.column(0).take(row), lists.take(row)], ["cell", "id", "v"])

    return df.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL").mapInArrow(work, "cell int, id long, v array<double>")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def approx_knn(queries: DataFrame, points: DataFrame, k: int, model: KMeansModel, nprobe: int = 4) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query meets the points of its nprobe nearest cells, and these are scored
    exactly, as knn scores them: no pair is a row, but the k best of a task."""
    centres = np.array(model.clusterCenters())
    return nearest(_filed(queries, "query_id", centres, nprobe), _filed(points, "chunk_id", centres, 1), k, len(centres))


def quantize(points: DataFrame, dim: int, share: float = 0.99) -> DataFrame:
    """points with code (array of tinyint): components scaled by the share quantile of their size, over all dimensions."""
    bound = points.select(F.explode("embedding").alias("x")).agg(F.percentile_approx(F.abs("x"), share, 10_000).alias("bound"))
    code = F.transform("embedding", lambda x: F.least(F.greatest(F.round(x / F.col("bound") * 127), F.lit(-127)), F.lit(127)).cast("tinyint"))
    return points.join(F.broadcast(bound), how="cross").withColumn("code", code).drop("bound")


def knn_quantized(queries: DataFrame, points: DataFrame, k: int, dim: int, oversample: float = 2.0) -> DataFrame:
    """Search on codes to k * oversample, then exact scores of these."""
    coarse = knn(queries, quantize(points, dim).select("chunk_id", F.col("code").cast("array<double>").alias("embedding")), int(k * oversample)).select("query_id", "chunk_id")
    exact = coarse.join(points.select("chunk_id", F.col("embedding").cast("array<double>").alias("v")), "chunk_id").join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "query_id")
    return top(exact.select("query_id", "chunk_id", cosine(F.col("q"), F.col("v")).alias("score")), "query_id", "score", "chunk_id", k)


def mmr(hits: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, chunk_id, place): hits re-chosen one by one for score and difference from those chosen. hits holds a
    query's short list only (query_id, chunk_id, score, embedding)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(rows["embedding"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, chosen = v @ v.T, []
        while len(chosen) < min(k, len(rows)):
            worst = like[:, chosen].max(1) if chosen else np.zeros(len(rows))
            value = weight * rows["score"].to_numpy() - (1 - weight) * worst
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[chosen], "chunk_id": rows["chunk_id"].iloc[chosen], "place": range(1, len(chosen) + 1)})

    return hits.groupBy("query_id").applyInPandas(work, "query_id long, chunk_id long, place int")


def cluster_questions(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """(key, cluster) by k-means."""
    model = fit_cells(vectors, k)
    return model.transform(vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))).select(key, F.col("prediction").alias("cluster"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact (query_id, chunk_id) that was found."""
    return exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


