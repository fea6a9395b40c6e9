"""Pluggable embedders, rerankers, token counters and chunkers, and what SQL can call."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunking as C
from . import text as X

_INDEX_TERM, _INDEX_STOP = regex.compile(X.INDEX_TERM), frozenset(X.INDEX_STOPWORDS)
MOST_CHARS = 32_000
_EMBEDDERS: dict[str, tuple[Callable[[list[str]], np.ndarray], int]] = {}
_RERANKERS: dict[str, Callable[[list[str], list[str]], list[float]]] = {}
_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}
_CHUNKERS: dict[str, Callable[[str], list[str]]] = {}


def register_embedder(name: str, fn: Callable[[list[str]], np.ndarray], dim: int) -> None:
    """fn: a batch of texts to as many vectors of dim components."""
    _EMBEDDERS[name] = fn, dim


def register_reranker(name: str, fn: Callable[[list[str], list[str]], list[float]]) -> None:
    _RERANKERS[name] = fn


def register_token_counter(name: str, fn: Callable[[list[str]], list[int]]) -> None:
    _COUNTERS[name] = fn


def register_chunker(name: str, fn: Callable[[str], list[str]]) -> None:
    _CHUNKERS[name] = fn


def embed(name: str, text: Column, batch: int = 64) -> Column:
    """Vectors by a registered embedder, texts cut to MOST_CHARS; a wrong count or dimension fails the task."""
    fn, dim = _EMBEDDERS[name]

    def work(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            rows = texts.fillna("").str.slice(0, MOST_CHARS).tolist()
            out: list[np.ndarray] = []
            for i in range(0, len(rows), batch):
                vectors = np.asarray(fn(rows[i : i + batch]), float)
                if vectors.shape != (len(rows[i : i + batch]), dim):
                    raise ValueError("an embedder gave vectors of a wrong number or dimension")
                out += list(vectors)
            yield pd.Series(out)

    work.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(work, T.ArrayType(T.DoubleType()))(text)


def rerank_score(name: str, query: Column, passage: Column) -> Column:
    fn = _RERANKERS[name]

    def work(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(fn(q.fillna("").tolist(), p.fillna("").tolist()), dtype=float)

    work.__annotations__ = {"q": pd.Series, "p": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, T.DoubleType())(query, passage)


def count_tokens(name: str, text: Column) -> Column:
    fn = _COUNTERS[name]

    def work(t: pd.Series) -> pd.Series:
        return pd.Series(fn(t.fillna("").tolist()), dtype="int64")

    work.__annotations__ = {"t": pd.Series, "return": pd.Series}
    return F.pandas_udf(work, T.LongType())(text)


def chunk_with(name: str, df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, content) by a registered chunker."""
    fn = _CHUNKERS[name]
    schema = T.StructType([df.schema[key], T.StructField("ordinal", T.LongType()), T.StructField("content", T.StringType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f[key], f[text].fillna(""), strict=True) for i, c in enumerate(fn(t))]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(work, schema)


class _Chunk:
    def eval(self, text: str, target: int):
        text = text or ""
        spans = C.sentence_spans(text)
        segments = [(text[a:b], a, b, False, False) for a, b in spans]
        for i, (p, q, n) in enumerate(C.pack_one(segments, C.Config(target, max(1, target // 8), target * 3 // 2))):
            yield i, text[segments[p][1] : segments[q][2]], n


class _CorpusStats:
    """Running figures of one collection: texts, terms, and a sketch of the distinct ones (4,096 registers)."""

    BITS = 12

    def __init__(self) -> None:
        self.key, self.n, self.length, self.registers = None, 0, 0, bytearray(1 << self.BITS)

    def eval(self, row) -> None:
        self.key = row[0]
        self.n += 1
        terms = [t for t in _INDEX_TERM.findall((row[1] or "").lower()) if t not in _INDEX_STOP]
        self.length += len(terms)
        for t in set(terms):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            place, rest = h & ((1 << self.BITS) - 1), h >> self.BITS
            rank = 64 - self.BITS - rest.bit_length() + 1
            if rank > self.registers[place]:
                self.registers[place] = rank

    def distinct(self) -> int:
        m = 1 << self.BITS
        raw = 0.7213 / (1 + 1.079 / m) * m * m / sum(2.0**-r for r in self.registers)
        empty = self.registers.count(0)
        return round(m * math.log(m / empty) if raw <= 2.5 * m and empty else raw)

    def terminate(self):
        if self.n:
            yield str(self.key) if self.key is not None else None, self.n, self.length / self.n, self.distinct()


def register_corpus_stats(spark: SparkSession) -> None:
    """corpus_stats(TABLE(SELECT collection, text ...) PARTITION BY collection) -> collection, n, mean_length, terms.

    The number of texts, their mean number of index terms and how many distinct ones there are, per collection. SQL's built-in aggregates can't be wrapped under one name, so this is a table function that reads each
    collection as a stream; what it holds is a few kilobytes whatever the collection's size. terms is an estimate, 1.6 %
    off on average. A null collection is one.
    """
    spark.udtf.register("corpus_stats", F.udtf(_CorpusStats, returnType="collection string, n bigint, mean_length double, terms bigint"))


def register_sql_functions(spark: SparkSession) -> None:
    """Scalar helpers as SQL functions, which Catalyst inlines, and chunk(text, target) as a table function."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_ws(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '\\\\s+', ' '))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_in_subtree(p STRING, r STRING) RETURNS BOOLEAN RETURN coalesce(p = r OR startswith(p, r || '.'), false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rrf_score(r INT, k INT) RETURNS DOUBLE RETURN 1.0D / (k + r)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS BIGINT RETURN aggregate(regexp_extract_all(coalesce(t, ''), '[\\\\p{L}\\\\p{N}]+', 0), 0L, (a, w) -> a + 1 + floor((length(w) - 1) / 6)) + regexp_count(coalesce(t, ''), '[^\\\\p{L}\\\\p{N}_\\\\s]')")
    spark.udtf.register("chunk", F.udtf(_Chunk, returnType="ordinal bigint, content string, tokens bigint"))
