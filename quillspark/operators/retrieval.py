"""Search over points and postings: exact neighbours, sparse scores, fusion, hydration, reranking, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import lexical as L

#: Queries that a task holds, and points that it scores at once.
QUERY_BLOCK, POINT_BLOCK = 2048, 1024


def top(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, ranked; scores are compared at 9 digits, ties by the tie column."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round(score, 9)), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, points: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, query_id: str = "query_id", point_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, point_id, score, rank): exact search. Scores: cosine; 1 + inner product (dot); 1 - distance (euclid).

    Queries are rows, dealt over blocks of about QUERY_BLOCK. Points are dealt over parts by id, one copy for each block of
    queries. A task holds one block of queries and its k best so far, and reads one part of the points as a stream; only
    k rows a query and part are shuffled for the answer. Scores count at 9 digits, ties go to the smaller id. Null vectors
    take no part; vectors of another dimension than the queries of their block raise.
    """
    vectors = lambda df, key: df.select(F.lit(0).alias("cell"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return nearest(vectors(queries, query_id), vectors(points, point_id), k, 1, metric, threshold, query_id, point_id)


def nearest(asked: DataFrame, given: DataFrame, k: int, cells: int, metric: str = "cosine", threshold: float | None = None, query_id: str = "query_id", point_id: str = "chunk_id") -> DataFrame:
    """knn of asked(cell, id, v) among the points given(cell, id, v) of the same of `cells` cells: ids are long, v
    array<double> without nulls. A query may ask several cells, a point stands in one."""
    spark = asked.sparkSession
    parts = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // cells), 1)
    most = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // QUERY_BLOCK))
    first = F.col("cell").cast("long") * blocks
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), (first + F.pmod(F.xxhash64("id"), F.lit(blocks))).alias("block"), F.lit(0).alias("point"), "id", "v")
    given = given.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(first, first + F.lit(blocks - 1))).alias("block"), F.lit(1).alias("point"), "id", "v")
    rows = asked.unionByName(given).repartition("part", "block").sortWithinPartitions("part", "block", "point", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for batch in batches:
            part, block, point, ids = (np.asarray(batch.column(i)) for i in range(4))
            lists = batch.column(4)
            ends = np.asarray(lists.offsets).astype(np.int64)
            flat = np.asarray(lists.flatten()).astype(float)
            cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (point[1:] != point[:-1])]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
                if (part[a], block[a]) != now:
                    if best is not None:
                        yield best.rows(query_id, point_id)
                    now, held, best = (part[a], block[a]), [], None
                v = flat[ends[a] - ends[0] : ends[b] - ends[0]]
                if point[a] == 0:
                    held.append((ids[a:b], v, np.diff(ends[a : b + 1])))
                    continue
                if not held:
                    continue
                if best is None:
                    best = _Best(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), k, metric, threshold)
                best.add(ids[a:b], v, np.diff(ends[a : b + 1]))
        if best is not None:
            yield best.rows(query_id, point_id)

    near = rows.mapInArrow(work, f"{query_id} long, {point_id} long, score double")
    return top(near, query_id, "score", point_id, k)


class _Best:
    """The k best points so far of a block of queries."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, k: int, metric: str, threshold: float | None):
        self.ids, self.k, self.metric = ids, k, metric
        self.q = self._matrix(flat, sizes, int(sizes[0]))
        self.floor = np.full(ids.size, -np.inf if threshold is None else round(threshold, 9))
        self.of, self.score, self.point = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    @staticmethod
    def _matrix(flat: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
        if (sizes != dim).any():
            raise ValueError("a vector's dimension differs from the queries'")
        return flat.reshape(sizes.size, dim)

    def add(self, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        v = self._matrix(flat, sizes, self.q.shape[1])
        for a in range(0, ids.size, POINT_BLOCK):
            own, x = ids[a : a + POINT_BLOCK], v[a : a + POINT_BLOCK]
            if self.metric == "euclid":
                s = 1 - np.sqrt(np.maximum((self.q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * self.q @ x.T, 0))
            elif self.metric == "dot":
                s = 1 + self.q @ x.T
            else:
                norm = np.sqrt((self.q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
                s = np.where(norm > 0, self.q @ x.T / np.where(norm > 0, norm, 1), 0.0)
            # what reaches the k-th best so far, ties included; then the k best of these
            of, at = np.nonzero(s >= self.floor[:, None] - 2e-9)
            of, score, point = np.concatenate([self.of, of]), np.concatenate([self.score, s[of, at]]), np.concatenate([self.point, own[at]])
            order = np.lexsort((point, -np.round(score, 9), of))
            of, score, point = of[order], score[order], point[order]
            first = np.searchsorted(of, np.arange(self.ids.size))
            rank = np.arange(of.size) - first[of]
            full = np.flatnonzero(rank == self.k - 1)
            self.floor[of[full]] = np.maximum(self.floor[of[full]], np.round(score[full], 9))
            kept = rank < self.k
            self.of, self.score, self.point = of[kept], score[kept], point[kept]

    def rows(self, query_id: str, point_id: str) -> pa.RecordBatch:
        fine = np.round(self.score, 9) >= self.floor[self.of] if self.of.size else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.of[fine]]), pa.array(self.point[fine]), pa.array(self.score[fine])], [query_id, point_id, "score"])


def sparse_search(query_terms: DataFrame, doc_terms: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "chunk_id", queries: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): sums of query weight times document weight over shared terms, above 0 only.
    queries: their number, where known."""
    # the weights of few queries go to the postings, which stay with their text
    if queries is not None and queries <= L.SENT_QUERIES:
        query_terms = F.broadcast(query_terms)
    both = doc_terms.select("term", doc_id, F.col("weight").alias("dw")).join(query_terms.select("term", query_id, F.col("weight").alias("qw")), "term")
    scores = both.groupBy(query_id, doc_id).agg(F.sum(F.col("dw") * F.col("qw")).alias("score")).filter("score > 0")
    return top(scores, query_id, "score", doc_id, k)


def keyword_search(hits: DataFrame, doc_terms: DataFrame, excluded: DataFrame) -> DataFrame:
    """Ranked hits without the documents that hold a term the query excludes; the score damped to s / (s + 1)."""
    # of the hits alone: a frequent term stands in most documents
    asked = hits.select("query_id", "chunk_id").join(excluded, "query_id")
    bad = asked.join(doc_terms.select("chunk_id", "term"), ["chunk_id", "term"], "left_semi").select("query_id", "chunk_id").distinct()
    return hits.join(bad, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.col("score") / (F.col("score") + 1))


def rrf(rankings: DataFrame, k: int = 60, limit: int = 60) -> DataFrame:
    """rankings(query_id, arm, chunk_id, rank) fused: score is the sum of 1 / (k + rank) over arms."""
    sums = rankings.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("arms"))
    return top(sums, "query_id", "score", "chunk_id", limit)


def depth(limit: int) -> int:
    """How deep each arm is read before fusion."""
    return max(2 * limit, limit + 10)


def hydrate(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """hits with the text columns of their chunk; orphan marks those that have none. Text joins after the top k only."""
    return hits.join(chunks.select("chunk_id", F.lit(True).alias("_there"), *columns), "chunk_id", "left").withColumn("orphan", F.col("_there").isNull()).drop("_there")


def with_neighbours(hits: DataFrame, chunks: DataFrame, n: int = 1) -> DataFrame:
    """Each hit's neighbouring chunks of the same document, up to n places away: an equi join, hits being spread over places."""
    spread = hits.select("query_id", "chunk_id", "document_id", F.explode(F.sequence(F.col("ordinal") - n, F.col("ordinal") + n)).alias("ordinal"))
    return spread.join(chunks.select("document_id", "ordinal", F.col("chunk_id").alias("neighbour_id")), ["document_id", "ordinal"])


def dedupe_hits(hits: DataFrame, content: str) -> DataFrame:
    """Of hits with equal content the best-ranked one of each query."""
    order = Window.partitionBy("query_id", F.md5(content)).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def overlap_score(query: Column, passage: Column) -> Column:
    """The share of the query's distinct content words that the passage has."""
    own = F.array_distinct(X.terms(query))
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, X.terms(passage))) / F.size(own))


def rerank(hits: DataFrame, score: Column | None, top_n: int | None = 8) -> DataFrame:
    """hits in order of a scorer, the original order for ties; without a scorer 1 - i / n in the order given. The top_n
    best are kept, or all."""
    if score is None:
        score = 1 - (F.col("rank") - 1) / F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank")
    ranked = hits.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(order))
    return ranked if top_n is None else ranked.filter(F.col("new_rank") <= top_n)


def best_score(*names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def recall_at_k(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query the share of expected (query_id, chunk_id) among its k best hits."""
    found = expected.join(hits.filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def mrr(hits: DataFrame, expected: DataFrame) -> DataFrame:
    first = hits.join(expected, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return expected.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 6).alias("reciprocal"))


def ndcg_at_k(hits: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    gain = hits.filter(F.col("rank") <= k).join(expected, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k).cast("long"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return n.join(gain, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def gate(results: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, passed) of the mean of every metric that has a threshold."""
    each = [results.agg(F.round(F.avg(m), 6).alias("value")).select(F.lit(m).alias("metric"), "value", F.lit(t).alias("threshold"), (F.col("value") >= t).alias("passed")) for m, t in thresholds.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def diff_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A full outer join of two runs: what changed, came or went."""
    x, y = a.select(*keys, F.col(value).alias("before")), b.select(*keys, F.col(value).alias("after"))
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("after") > F.col("before"), "better").when(F.col("after") < F.col("before"), "worse").otherwise("same")
    return x.join(y, keys, "full_outer").withColumn("change", kind)


def fused_lists(variants: DataFrame, points: DataFrame, collections: list, k: int = 10, limit: int = 60, metric: str = "cosine") -> DataFrame:
    """variants(query_id, variant, embedding) searched in each collection of points(chunk_id, collection, embedding): one
    ranked list a variant and collection, fused by rank; the first `limit` stay. Collections without points add no list."""
    # one long names a variant of a query, as searches know queries by a number
    names = variants.select("query_id", "variant", F.xxhash64("query_id", "variant").alias("_name"), "embedding")
    lists = None
    for i, c in enumerate(collections):
        own = knn(names, points.filter(F.col("collection") == F.lit(c)), k, metric, query_id="_name").withColumn("_collection", F.lit(i))
        lists = own if lists is None else lists.unionByName(own)
    named = lists.join(names.select("_name", "query_id", "variant"), "_name")
    return rrf(named.select("query_id", F.struct("_collection", "variant").alias("arm"), "chunk_id", "rank"), 60, limit)


def parse_web_query(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, clause, pos, excluded, words): the parts of queries as people type them.

    `or` parts clauses, of which a document must meet one; all of a clause's words must be there, a quoted phrase in its
    order, and nothing after a minus. Anything else is read as words; parts without index terms are left out.
    """
    parts = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    rows = queries.select("query_id", F.posexplode(parts).alias("pos", "part"))
    rows = rows.withColumn("clause", F.sum((F.col("part") == "or").cast("int")).over(Window.partitionBy("query_id").orderBy("pos")))
    rows = rows.filter("part <> 'or'").select("query_id", "clause", "pos", F.col("part").startswith("-").alias("excluded"), X.index_terms(F.col("part")).alias("words"))
    return rows.filter(F.size("words") > 0)


def web_search(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries(query_id, query) over docs(chunk_id, text), see parse_web_query.

    Only the queries' own terms are counted. Texts are read for the documents alone that hold all words of a clause with a
    phrase or an exclusion. A document's score is its best clause's BM25, damped to s / (s + 1).
    """
    parts = parse_web_query(queries)
    wanted = parts.filter("NOT excluded").select("query_id", "clause", F.explode("words").alias("term")).distinct()
    needed = wanted.groupBy("query_id", "clause").agg(F.count(F.lit(1)).alias("needed"))
    stats = L.corpus_stats(docs, "text")
    posts = L.postings(docs, "chunk_id", "text", wanted.select("term").distinct())
    idf = L.document_frequency(posts).join(F.broadcast(stats), how="cross").select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = wanted.join(idf, "term").join(L.bm25_documents(posts, stats).select("term", "chunk_id", "weight"), "term")
    met = weighed.groupBy("query_id", "clause", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("idf") * F.col("weight")).alias("s"))
    met = met.join(needed, ["query_id", "clause"]).filter("n = needed").drop("n", "needed")
    padded = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    checks = parts.filter("excluded OR size(words) > 1").groupBy("query_id", "clause").agg(F.collect_list(F.struct("excluded", padded(F.col("words")).alias("phrase"))).alias("checks"))
    met = met.join(checks, ["query_id", "clause"], "left")
    read = met.filter("checks IS NOT NULL").join(docs.select("chunk_id", padded(X.index_terms(F.col("text"))).alias("t")), "chunk_id")
    fine = read.filter(F.forall("checks", lambda c: F.contains(F.col("t"), c["phrase"]) != c["excluded"])).select("query_id", "chunk_id", "s")
    both = met.filter("checks IS NULL").select("query_id", "chunk_id", "s").unionByName(fine)
    best = both.groupBy("query_id", "chunk_id").agg(F.max("s").alias("s")).select("query_id", "chunk_id", (F.col("s") / (F.col("s") + 1)).alias("score"))
    return top(best, "query_id", "score", "chunk_id", k)


# Kinds of chunk whose own layout says what they are, and how much of either kind a reranker reads.
LAID_OUT, LAID_OUT_CHARS, PROSE_CHARS = ("table", "code", "form"), 4000, 2000


def passage(content: Column, kind: Column, heading_path: Column) -> Column:
    """What a reranker reads of a chunk: the start of a structured one; of prose its last two headings, then its start."""
    path = F.filter(F.coalesce(heading_path, F.array().cast("array<string>")), lambda h: h.isNotNull())
    prefix = F.array_join(F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), F.lit(2)), " > ")
    prose = F.substring(content, 1, PROSE_CHARS)
    return F.when(F.coalesce(kind.isin(*LAID_OUT), F.lit(False)), F.substring(content, 1, LAID_OUT_CHARS)).when(prefix != "", F.concat(prefix, F.lit("\n"), prose)).otherwise(prose)


def refusal_accuracy(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(kind, n, accuracy): of cases(case_id, kind, must_refuse) that must be refused, the share whose result(case_id,
    status) is a refusal. A case without a result is wrong; of several results of a case all must be refusals."""
    refused = results.groupBy("case_id").agg(F.min(F.coalesce(F.col("status").isin("refused", "no_answer"), F.lit(False))).alias("_ok"))
    asked = cases.filter("must_refuse").join(refused, "case_id", "left")
    return asked.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("_ok", F.lit(False)).cast("int")), 6).alias("accuracy"))


def context_quality(hits: DataFrame, query: Column, content: Column, least: float = 0.1) -> DataFrame:
    """(query_id, precision, recall): the share of hits that overlap the query by more than `least`, and the best overlap."""
    rows = hits.withColumn("_o", overlap_score(query, content))
    return rows.groupBy("query_id").agg(F.round(F.avg((F.col("_o") > least).cast("int")), 6).alias("precision"), F.round(F.max("_o"), 6).alias("recall"))


def debug_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, stage, place, chunk_id, rank): what every stage of a retrieval had for each query, stages in order."""
    parts = [df.select("query_id", F.lit(name).alias("stage"), F.lit(i).alias("place"), "chunk_id", F.col("rank").cast("int").alias("rank")) for i, (name, df) in enumerate(stages.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
