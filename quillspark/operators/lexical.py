"""Sparse and hashed features of text: corpus statistics, BM25 weights, signed feature hashing."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import bounded_batches

K1, B, DEFAULT_LENGTH = 1.5, 0.75, 220.0
TERM, STOP = regex.compile(X.TERM), frozenset(X.STOPWORDS)
#: TERM in lower case, for texts without other letters.
ASCII_TERM = re.compile(r"[a-z0-9]{2,}")
INDEX_TERM, INDEX_STOP = re.compile(X.INDEX_TERM), tuple(X.INDEX_STOPWORDS)
#: Texts whose postings and scores one task holds, and queries whose terms are sent to every task.
TEXTS, SENT_QUERIES = 4_000, 10_000
#: Terms whose place a task remembers.
KNOWN_TERMS = 200_000


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """The distinct index terms (term) of all queries."""
    return queries.select(F.explode(X.index_terms(F.col(text))).alias("term")).distinct()


def by_text(df: DataFrame, key: str, text: str, texts: int | None = None) -> DataFrame:
    """(key, text) dealt by key to tasks of about TEXTS texts, however many there are. What is then grouped by key and
    other columns stays where it is, and no task's share grows with the table. texts: their number, where known."""
    n = df.count() if texts is None else texts
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TEXTS))
    return df.select(key, text).repartition(parts, key)


def bags(df: DataFrame, key: str, text: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """(key, bag): the counts of a text's index terms, and under "" its number of terms. wanted: only these are counted.

    A text is cut in one Python pass over Arrow batches; what follows reads counts, not texts.
    """
    schema = T.StructType([df.schema[key], T.StructField("bag", T.MapType(T.StringType(), T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, terms, counts = [0], [], []
            for t in batch.column(1).to_pylist():
                found = Counter(INDEX_TERM.findall((t or "").lower()))
                for word in INDEX_STOP:
                    found.pop(word, None)
                terms.append("")
                counts.append(found.total())
                own = found if wanted is None else [term for term in found if term in wanted]
                terms.extend(own)
                counts.extend(map(found.__getitem__, own))
                ends.append(len(terms))
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.string()), pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), maps], schema.names)

    return bounded_batches(df).select(key, text).mapInArrow(work, schema)


def bag_postings(df: DataFrame, key: str, terms: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """postings() of bags; unique: each has a key of its own. No bag is empty; explode would filter bags first, and what
    else reads them would not share their shuffle."""
    each = df.select(key, F.col("bag")[""].alias("length"), F.explode_outer("bag").alias("term", "n")).filter("term <> ''")
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    if unique:
        return each.select(key, "term", F.col("n").alias("tf"), "length")
    return each.groupBy(key, "term").agg(F.sum("n").alias("tf"), F.first("length").alias("length"))


def bag_stats(df: DataFrame) -> DataFrame:
    """corpus_stats() of bags. Both columns read them, so that they share a shuffle."""
    return df.agg(F.count("bag").alias("n"), F.coalesce(F.avg(F.col("bag")[""]), F.lit(DEFAULT_LENGTH)).alias("avg_length"))


def postings(df: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length): counts of index terms, and each text's number of terms. terms (term, distinct): only these
    are counted; they are picked out before the aggregation, lengths are of whole texts all the same."""
    return bag_postings(bags(df, key, text), key, terms)


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """One row: n texts and their mean number of terms (DEFAULT_LENGTH when there is none)."""
    return bag_stats(bags(df.select(F.lit(0).alias("key"), text), "key", text, frozenset()))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_documents(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """posts with weight tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)); stats has one row."""
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    return posts.join(F.broadcast(stats), how="cross").withColumn("weight", F.col("tf") * (K1 + 1) / norm).drop("n", "avg_length")


def bm25_queries(queries: DataFrame, key: str, text: str, df: DataFrame, stats: DataFrame) -> DataFrame:
    """(key, term, weight): inverse document frequency, at least 0; all 1 where no term of the query has any."""
    own = queries.select(key, F.explode(F.array_distinct(X.index_terms(F.col(text)))).alias("term"))
    idf = F.greatest(F.log(1 + (F.col("n") - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5)), F.lit(0.0))
    rows = own.join(df, "term", "left").join(F.broadcast(stats), how="cross").withColumn("w", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(idf))
    best = rows.groupBy(key).agg(F.max("w").alias("best"))
    return rows.join(best, key).select(key, "term", F.when(F.col("best") > 0, F.col("w")).otherwise(1.0).alias("weight"))


def term_index(term: Column) -> Column:
    """A stable bucket below 2**32."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, vector): terms hashed to signed buckets, unit length; the first axis for a text without terms.

    A fold over each text's terms in Arrow batches: nothing is shuffled, and a term is hashed once a task.
    """
    schema = T.StructType([df.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType()))])
    # buckets of terms that add, of those that subtract, and one for stop words
    width = 2 * dim + 1

    class Places(dict):
        def __missing__(self, term: str) -> int:
            h = hashlib.md5(term.encode()).digest()
            at = 2 * dim if term in STOP else int.from_bytes(h[:4]) % dim + dim * (h[4] >> 4 & 1)
            # once full, it knows the frequent terms
            if len(self) < KNOWN_TERMS:
                self[term] = at
            return at

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            sums = np.zeros((batch.num_rows, width))
            for i, t in enumerate(batch.column(1).to_pylist()):
                t = (t or "").lower()
                found = Counter((ASCII_TERM if t.isascii() else TERM).findall(t))
                at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
                sums[i] = np.bincount(at, np.fromiter(found.values(), float, len(found)), width)
            out = sums[:, :dim] - sums[:, dim : 2 * dim]
            norm = np.sqrt((out * out).sum(1))
            out[norm == 0, 0] = 1.0
            out /= np.where(norm == 0, 1.0, norm)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * dim, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema.names)

    return bounded_batches(df).select(key, text).mapInArrow(work, schema)


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def valid_vector(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def cache_key(model: str, dim: int, kind: str, text: Column) -> Column:
    """Key of a stored vector; documents and queries never share one."""
    return F.concat_ws(":", F.lit(model), F.lit(dim), F.lit(kind), F.substring(F.sha2(text, 256), 1, 32))


def missing(df: DataFrame, cache: DataFrame, key: Column, text: str) -> DataFrame:
    """The distinct texts whose key the cache lacks, with their key."""
    return df.select(key.alias("key"), F.col(text)).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
