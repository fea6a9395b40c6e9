"""Nearest neighbours by counting collisions in windows of single projections (query-aware hashing).

Every vector has its values under M random projections. A row that lies in many of the windows around a query's own
values is a candidate and its exact score is computed. Windows grow step by step (virtual rehashing: only the new rings
are read) until rows as near as the k-th best found so far would have become candidates with high probability.

1. Rows fall into leaves of a tree that splits at medians of projections, and leaves into blocks of bounded size. The tree
   is fitted on about SAMPLE rows and has at most LEAVES leaves; every row is indexed. A block keeps, for each projection,
   its values sorted.
2. A query is first searched in one block of its own leaf, with growing windows. Its k-th best there fixes how far its
   windows have to reach everywhere else.
3. With that reach it goes on to the leaves whose ranges its windows meet in as many projections as a candidate needs,
   and to no others: a row can't collide more often than its leaf does. The k best of all these blocks are the answer.

On vectors that gather, a query meets few leaves. On vectors without any structure in high dimensions windows that catch
the nearest rows meet nearly all leaves, as for any exact-to-0.9 search; the work is then queries times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 16_384
PROJECTIONS = 64
#: A row is verified once it lies in this share of the windows; a search ends when a row as near as the k-th best so far
#: would be verified but for SURE standard deviations of its count.
COLLIDE, SURE = 0.5, 1.4
#: Window reaches in units of the longest vector; after the last of them every row is verified.
WIDTHS = tuple(0.6 * 1.12**i for i in range(18))
QUERY_BATCH = 64
#: Rows that the tree is fitted on (about), its leaves at most, and sampled rows of a leaf at least.
SAMPLE, LEAVES, PER_LEAF = 8_192, 256, 32


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def _sure() -> float:
    """The reach, in units of a row's distance, at which the row lies in enough windows but for SURE standard deviations."""
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = 2 * float(_normal_cdf(np.array(mid))) - 1
        lo, hi = (lo, mid) if p * PROJECTIONS - SURE * np.sqrt(PROJECTIONS * p * (1 - p)) >= COLLIDE * PROJECTIONS else (mid, hi)
    return hi


REACH = _sure()


class Space:
    """The projections of inner-product search over vectors of length at most top.

    A vector x becomes (x, sqrt(top^2 - |x|^2)), a query q becomes q * top / |q|: then the largest inner product is the
    least Euclidean distance.
    """

    def __init__(self, dim: int, top: float, seed: int = 7):
        self.top = top
        self.axes = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.axes[:-1] + np.sqrt(np.maximum(self.top**2 - (vectors**2).sum(1), 0))[:, None] * self.axes[-1]

    def queries(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(projections, the factor by which each query was stretched)."""
        scale = self.top / np.sqrt((vectors**2).sum(1))
        return (vectors @ self.axes[:-1]) * scale[:, None], scale

    def reach(self, scale: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """How far windows reach so that rows of score worst or more are found; without end for -inf."""
        far = np.sqrt(np.maximum(2 * self.top**2 - 2 * scale * np.maximum(worst, -1e300), 0))
        return np.where(np.isneginf(worst), np.inf, far * REACH + 1e-9 * self.top)


class Tree:
    """Splits of projected values at medians, on the projection of largest spread, down to leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.value, self.left, self.right, self.leaf = [], [], [], [], []
        self.n_leaves = 0
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self._grow(sample, depth)
        self.axis, self.value, self.left, self.right, self.leaf = (np.array(x) for x in (self.axis, self.value, self.left, self.right, self.leaf))

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        here = len(self.axis)
        for x, v in ((self.axis, 0), (self.value, 0.0), (self.left, here), (self.right, here), (self.leaf, -1)):
            x.append(v)
        if depth and len(sample) >= 2 * PER_LEAF:
            axis = int(np.argmax(sample.var(0)))
            value = float(np.median(sample[:, axis]))
            low = sample[:, axis] <= value
            if low.any() and not low.all():
                self.axis[here], self.value[here] = axis, value
                self.left[here] = self._grow(sample[low], depth - 1)
                self.right[here] = self._grow(sample[~low], depth - 1)
                return here
        self.leaf[here] = self.n_leaves
        self.n_leaves += 1
        return here

    def of(self, projected: np.ndarray) -> np.ndarray:
        at, every = np.zeros(len(projected), np.int64), np.arange(len(projected))
        while (self.leaf[at] < 0).any():
            at = np.where(projected[every, self.axis[at]] <= self.value[at], self.left[at], self.right[at])
        return self.leaf[at]


class Block:
    """The sorted projections of some vectors."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray):
        self.space, self.ids, self.vectors = space, ids, vectors
        projected = space.rows(vectors)
        order = np.argsort(projected, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(projected, order, 0).T)

    def bounds(self) -> np.ndarray:
        return np.concatenate([self.values[:, 0], self.values[:, -1]])

    def search(self, asked: np.ndarray, own: np.ndarray, worst: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of the k best rows found, but not the row of the query's own id.

        A query with a score to reach (worst) reads its windows at once; one without (nan) widens them step by step.
        """
        centre, scale = self.space.queries(asked)
        steps = np.where(np.isnan(worst)[:, None], np.array(WIDTHS)[None, :] * self.space.top, self.space.reach(scale, np.nan_to_num(worst, nan=-np.inf))[:, None])
        # bounds[j]: for each query and width the window's ends in the j-th sorted array
        bounds = np.stack([np.searchsorted(v, np.concatenate([c[:, None] - steps, c[:, None] + steps], 1)) for v, c in zip(self.values, centre.T, strict=True)])
        for i, q in enumerate(asked):
            n = steps.shape[1] if np.isnan(worst[i]) else 1
            yield self._one(q, float(scale[i]), bounds[:, i, :n], bounds[:, i, steps.shape[1] : steps.shape[1] + n], steps[i, :n], self.ids == own[i], float(worst[i]), k)

    def _one(self, q: np.ndarray, scale: float, low: np.ndarray, high: np.ndarray, reach: np.ndarray, seen: np.ndarray, known: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, need = self.ids.size, COLLIDE * PROJECTIONS
        counts = np.zeros(n, np.int64)
        rows, scores = [], []
        for step in range(reach.size + int(np.isnan(known))):
            if step < reach.size:
                if step:
                    rings = [x for j in range(PROJECTIONS) for x in (self.order[j, low[j, step] : low[j, step - 1]], self.order[j, high[j, step - 1] : high[j, step]])]
                else:
                    rings = [self.order[j, low[j, 0] : high[j, 0]] for j in range(PROJECTIONS)]
                counts += np.bincount(np.concatenate(rings), minlength=n)
                new = np.flatnonzero((counts >= need) & ~seen)
            else:
                new = np.flatnonzero(~seen)
            if new.size:
                seen[new] = True
                rows.append(new)
                scores.append(self.vectors[new] @ q)
            if np.isnan(known) and step < reach.size and sum(map(len, rows)) >= k:
                every = np.concatenate(scores)
                worst = np.partition(every, every.size - k)[every.size - k]
                if reach[step] >= self.space.reach(np.array(scale), np.array(worst)):
                    break
        if not rows:
            return self.ids[:0], np.zeros(0)
        near, rough = np.concatenate(rows), np.concatenate(scores)
        least = -np.inf if np.isnan(known) else known
        if near.size > k:
            least = max(least, np.partition(rough, rough.size - k)[rough.size - k])
        if least > -np.inf:
            near = near[rough >= least - 1e-9 * (1 + abs(least))]
        exact = (self.vectors[near] * q).sum(1)
        best = np.lexsort((self.ids[near], -exact))[:k]
        return self.ids[near[best]], exact[best]


def _searched(filed: DataFrame, sent: DataFrame, n_blocks: int, space: Space, dim: int, k: int) -> DataFrame:
    """(query_id, id, score, block, bounds): what the queries sent(block, id, v, worst) find in the blocks of filed(block,
    id, v), and one row per block with its projections' bounds. A task holds one block at a time."""
    rows = filed.select("block", F.lit(0).alias("asks"), "id", "v", F.lit(0.0).alias("worst")).unionByName(sent.select("block", F.lit(1).alias("asks"), "id", "v", "worst"))
    together = rows.repartitionByRange(n_blocks, "block").sortWithinPartitions("block", "asks", "id")
    names = ["query_id", "id", "score", "block", "bounds"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.float64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, vectors, index, out, held = None, [], [], None, [], 0

        def made() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds[:4], strict=True)], pa.nulls(cols[0].size, kinds[4])], names)

        def bounds() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), pa.array([number], kinds[3]), pa.array([index.bounds()], kinds[4])], names)

        for batch in batches:
            of, asks, own = (np.asarray(batch.column(i)) for i in range(3))
            v = np.asarray(batch.column(3).flatten()).reshape(len(own), dim)
            worst = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            cuts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                if of[a] != number:
                    if ids and index is None:
                        index = Block(space, np.concatenate(ids), np.concatenate(vectors))
                        yield bounds()
                    number, ids, vectors, index = int(of[a]), [], [], None
                if not asks[a]:
                    ids.append(own[a:b]), vectors.append(v[a:b])
                    continue
                if not ids:
                    continue
                if index is None:
                    index = Block(space, np.concatenate(ids), np.concatenate(vectors))
                    yield bounds()
                for x in range(a, b, QUERY_BATCH):
                    y = min(b, x + QUERY_BATCH)
                    for query, (found, score) in zip(own[x:y].tolist(), index.search(v[x:y], own[x:y], worst[x:y], k), strict=True):
                        out.append((np.full(found.size, query), found, score, np.full(found.size, number)))
                        held += found.size
                    if held >= 10_000:
                        yield made()
                        out, held = [], 0
        if ids and index is None:
            index = Block(space, np.concatenate(ids), np.concatenate(vectors))
            yield bounds()
        if held:
            yield made()

    return together.mapInArrow(work, "query_id long, id long, score double, block int, bounds array<double>")


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product with each query, but its own row.

    Vectors that are null, zero or hold null or non-finite components take no part, on either side; vectors of another
    length than the most common one neither. Fewer rows than k give them all; ties go to the smaller id. An id that
    repeats counts once for each of its rows; a null id takes no part. Other columns are not read. Tables without usable
    rows give no rows. To the driver come one number per block, about SAMPLE vectors, and the ranges of LEAVES leaves.
    """
    vector = F.col(vector_col).cast("array<double>")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    size = clean.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    dim, n = size[0]["d"], size[0]["n"]
    clean, asked = clean.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    space = Space(dim, float(np.sqrt(size[0]["top"])))
    picked = clean.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n)) < SAMPLE).select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()
    tree = Tree(space.rows(np.asarray(picked.flatten()).reshape(-1, dim)) if len(picked) else np.zeros((0, PROJECTIONS)), min(LEAVES, -(-n // block_rows)))

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, dim)
            # a row and a query of the same vector point the same way, so that the leaf of either is the same one's
            asks = np.asarray(batch.column(1)).astype(bool)
            leaf = tree.of(np.where(asks[:, None], space.queries(v)[0], space.rows(v)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    both = clean.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1))).select("id", "asks", "v")
    both = written(both.mapInArrow(leaves_of, "id long, asks int, v array<double>, leaf int"), "leaves")
    filed, asked = both.filter("asks = 0"), both.filter("asks = 1")
    parts = [0] * tree.n_leaves
    for r in filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n")).collect():
        parts[r["leaf"]] = r["n"]
    begin = np.concatenate([[0], np.cumsum(parts)]).tolist()
    first, of_leaf = (F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("leaf")) for values in (begin, parts))
    block = (first + F.pmod(F.xxhash64("id", "v"), F.greatest(of_leaf, F.lit(1))).cast("int")).cast("int")
    filed = filed.select(block.alias("block"), "id", "v")
    home = asked.filter(of_leaf > 0).select(block.alias("block"), "id", "v", F.lit(float("nan")).alias("worst"))
    near = _searched(filed, home, begin[-1], space, dim, k)
    if begin[-1] > 1:
        near = written(near, "near")
        met = near.filter("bounds IS NOT NULL").select("block", F.posexplode("bounds").alias("j", "x"))
        owner = F.size(F.filter(F.array(*[F.lit(int(x)) for x in begin[:-1]]), lambda b: b <= F.col("block"))) - 1
        met = met.groupBy(owner.alias("leaf"), "j").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
        low, high = np.full((tree.n_leaves, PROJECTIONS), np.inf), np.full((tree.n_leaves, PROJECTIONS), -np.inf)
        for r in met:
            if r["j"] < PROJECTIONS:
                low[r["leaf"], r["j"]] = r["low"]
            else:
                high[r["leaf"], r["j"] - PROJECTIONS] = r["high"]
        best = near.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        known = asked.select("id", "v", F.when(of_leaf > 0, block).otherwise(-1).alias("done")).join(best.hint("merge"), F.col("id") == F.col("query_id"), "left")
        known = known.select("id", "v", "done", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("worst"))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks_of = [np.arange(begin[i], begin[i + 1]) for i in range(tree.n_leaves)]
            for batch in batches:
                for a in range(0, batch.num_rows, QUERY_BATCH):
                    part = batch.slice(a, QUERY_BATCH)
                    v = np.asarray(part.column(1).flatten()).reshape(part.num_rows, dim)
                    done, worst = np.asarray(part.column(2)), np.asarray(part.column(3))
                    centre, scale = space.queries(v)
                    reach = space.reach(scale, worst)[:, None, None]
                    meets = ((low[None] <= centre[:, None] + reach) & (high[None] >= centre[:, None] - reach)).sum(2) >= COLLIDE * PROJECTIONS
                    to = [np.concatenate([blocks_of[x] for x in np.flatnonzero(m)] or [np.zeros(0, np.int64)]) for m in meets]
                    to = [x[x != d] for x, d in zip(to, done, strict=True)]
                    rows_of = pa.array(np.repeat(np.arange(part.num_rows), [x.size for x in to]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to), pa.int32()), *[part.column(i).take(rows_of) for i in (0, 1, 3)]], ["block", "id", "v", "worst"])

        sent = known.mapInArrow(routed, "block int, id long, v array<double>, worst double")
        near = near.unionByName(_searched(filed, sent, begin[-1], space, dim, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.filter("query_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
