"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, bands, and exact weighted Jaccard.

1. Words are runs of ASCII letters and digits and of any other non-ASCII characters, lower case; shingles are five words
   (a shorter text is one shingle). A shingle weighs its count in the text times the mean of its words' inverse document
   frequencies, 1 + ln((1 + N) / (1 + df)). Frequencies are exact, word by word, over all documents; words in fewer than
   one document in RARE (or so few that more than MOST_WORDS could be as frequent) count as if in as many.
2. Texts of equal word sequences (by a digest of 128 bits) are one class; one of them goes on.
3. Improved consistent weighted sampling draws BANDS * ROWS samples a text: two texts agree in one with the probability
   of their weighted Jaccard similarity. Texts that agree in all samples of a band share a bucket.
4. In a bucket every text is compared with the least one (a star); those that fail, with the least that failed and with
   their neighbours in an order that brings together those that share the next band too. Comparisons are exact, on whole
   texts, in groups of at most about GROUP texts. Buckets of at most SETTLED texts are settled then.
5. Where a larger bucket still holds several components, its texts meet by a prefix join: a text's shingles in one order
   of all shingles, the rarest first, until less than THRESHOLD of its weight is left. Texts of THRESHOLD or more share
   one of these, and enough weight is left from the first that they share on. All pairs of different components for
   which that holds are compared exactly, so no near pair of a bucket is left out, and a frequent passage, which stands
   last in the order, makes no pairs.
6. Links of THRESHOLD or more make components; a document's class is the least id in its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roll, blocks, bounded_batches, dropped, flat, mixed, written
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
BLOCK = 1 << 18
GROUP = 256
#: The frequency below which words count alike, and the most words whose frequency is sent to every task.
RARE, MOST_WORDS = 1024, 1 << 18
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 20
#: Step 4 compares all texts of a bucket that can be near if it holds no more than these.
SETTLED = 3
#: Counters that order shingles by frequency; how many there are moves the speed and no result.
PLACES = 1 << 18
#: Room for rounding of single-precision weights in bounds.
SLACK = 1e-4
NO_ID = -(2**63)

_IN_WORD = np.array([chr(b).isalnum() if b < 0x80 else True for b in range(256)])


def _grid(n: int) -> np.ndarray:
    """n quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    want = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < want
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


_TABLE = 1 << 12
_RATE = _grid(_TABLE).astype(np.float32)
_INVERSE = (1 / _RATE).astype(np.float32)
_SHIFT = ((np.arange(_TABLE) + 0.5) / _TABLE).astype(np.float32)
_LOG = np.log(_grid(_TABLE)).astype(np.float32)
_STEPS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COMBINE = np.random.default_rng(12).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words start in them) of lower-case texts in one array."""
    inside = np.zeros(data.size + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Roll(data).of(begin, end), np.searchsorted(begin, offsets)


def sequences(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each text's words in order; of the text itself if it has none."""
    inside = _IN_WORD[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # a byte behind each word parts it from the next
    plain = np.where(inside, data, np.uint8(0x20))[kept].tobytes()
    at = np.concatenate([[0], np.cumsum(kept)])[offsets].tolist()
    raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    out = []
    for i in range(len(at) - 1):
        words = plain[at[i] : at[i + 1]].strip(b" ")
        out.append(hashlib.blake2b(words if words else b" " + bytes(raw[ends[i] : ends[i + 1]]), digest_size=16).digest())
    return out


@dataclass
class Idf:
    """Inverse document frequencies in units of 1 / UNIT: of the words in `words` (sorted hashes), and of all others."""

    words: np.ndarray
    values: np.ndarray
    others: int

    UNIT = 1 << 12

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not self.words.size:
            return np.full(hashes.size, self.others, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), self.words.size - 1)
        return np.where(self.words[at] == hashes, self.values[at], self.others)


def shingles(hashes: np.ndarray, at: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, shingle hashes, weights), each distinct shingle of a text once, texts in order."""
    n_words = np.diff(at)
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    of = np.repeat(np.arange(n.size), n)
    first = at[:-1][of] + np.arange(of.size) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    sums = np.concatenate([[0], np.cumsum(idf.of(hashes))])  # whole numbers, so that a shingle weighs the same everywhere
    h = np.zeros(of.size, np.uint64)
    stop = np.minimum(first + WORDS, at[1:][of])
    for j in range(WORDS):
        here = first + j
        h += np.where(here < stop, padded[here] * _COMBINE[j], np.uint64(0))
    h = mixed(h) >> np.uint64(16)
    weight = (sums[stop] - sums[first]) / (Idf.UNIT * np.maximum(stop - first, 1))
    key = (of.astype(np.uint64) << np.uint64(48)) | h  # a block has fewer than 65,536 texts
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    count = np.diff(np.append(head, key.size))
    return of[order][head], h[order][head], (weight[order][head] * count).astype(np.float32)


def samples(of: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, one row of BANDS * ROWS sample hashes for each)."""
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    log = np.log(weight)
    place = np.arange(h.size, dtype=np.uint64)
    out = np.zeros((starts.size, BANDS * ROWS), np.uint64)
    mask = np.uint64(_TABLE - 1)
    for k, step in enumerate(_STEPS):
        m = h * step
        m ^= m >> np.uint64(29)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        i, j, c = ((m >> np.uint64(s) & mask).astype(np.int64) for s in (52, 40, 28))
        rate, shift = _RATE[i], _SHIFT[j]
        t = np.floor(log * _INVERSE[i] + shift)
        value = _LOG[c] - rate * (t - shift) - rate
        bits = value.view(np.uint32)
        sortable = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        best = (np.minimum.reduceat((sortable << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = mixed(h[best] * np.uint64(BANDS * ROWS) + np.uint64(k) + (t[best].astype(np.int64).view(np.uint64) << np.uint64(50)))
    return of[starts], out


def _small_blocks(offsets: np.ndarray):
    for a, b in blocks(offsets, BLOCK):
        for x in range(a, b, 60_000):
            yield x, min(b, x + 60_000)


def frequencies(docs: DataFrame) -> Idf:
    """Inverse document frequencies from all rows of docs(text).

    Words are counted in tasks and summed by word in an aggregation; only words of at least the least frequency come to
    the driver. Since all counts together are `pairs`, at most MOST_WORDS can reach pairs / MOST_WORDS.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            words = np.concatenate([w for w, _ in held])
            order = np.argsort(words, kind="stable")
            words = words[order]
            head = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return words[head], np.add.reduceat(np.concatenate([c for _, c in held])[order], head)

        def rows(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            data, offsets = flat(batch.column(0))
            n += batch.num_rows
            for a, b in _small_blocks(offsets):
                words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = np.repeat(np.arange(b - a), np.diff(at))
                order = np.lexsort((of, words))
                words, of = words[order], of[order]
                once = words[np.concatenate([[True], (words[1:] != words[:-1]) | (of[1:] != of[:-1])])] if words.size else words
                if once.size:
                    held.append(np.unique(once, return_counts=True))
                    size += held[-1][0].size
                if size > 2 * COUNTED:
                    held = [summed()]
                    size = held[0][0].size
                    if size > COUNTED:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*summed())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n])], ["word", "n"])

    counts = docs.select(F.lower("text").alias("text")).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "frequencies")
    total, pairs = counts.agg(F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))).first()
    least = max(total / RARE, pairs / MOST_WORDS, 1)
    got = counts.filter(F.col("word").isNotNull() & (F.col("n") >= least)).toArrow()
    dropped(counts)
    words, n = np.asarray(got["word"]).view(np.uint64), np.asarray(got["n"])
    order = np.argsort(words)
    scaled = lambda df: np.rint((1 + np.log((1 + total) / (1 + df))) * Idf.UNIT).astype(np.int64)
    return Idf(words[order], scaled(n[order].astype(float)), int(scaled(np.float64(least))))


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """(d, x, same, bands) of docs(d, text): a hash of the text, the digest of its words in order, and a key for each band."""
    schema = pa.schema([("d", pa.int64()), ("x", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = flat(batch.column(2))
            for a, b in _small_blocks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, at = word_hashes(part, own)
                of, h, weight = shingles(words, at, idf)
                keys, size = np.zeros(0, np.int64), np.zeros(b - a, np.int64)
                if h.size:
                    texts, drawn = samples(of, h, weight)
                    rows = drawn.reshape(texts.size, BANDS, ROWS)
                    band = np.arange(BANDS, dtype=np.uint64)[None, :]
                    for r in range(ROWS):
                        band = mixed(band + rows[:, :, r])
                    keys, size[texts] = band.view(np.int64).ravel(), BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(x[a:b]), pa.array(sequences(part, own), pa.binary()), lists], schema=schema)

    return docs.select("d", F.xxhash64("text").alias("x"), F.lower("text").alias("text")).mapInArrow(work, "d long, x long, same binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf) -> DataFrame:
    """(a, b, similarity) of pairs(a, b): the exact weighted Jaccard similarity of whole texts(d, text).

    The members b of one a are dealt over groups of about GROUP, each with a copy of a's text; a task reads a group as a
    stream and holds a's shingles and one block of the others.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(sizes.hint("merge"), "a").withColumn("g", F.pmod(F.hash("b"), F.col("groups")))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("a").alias("d"), F.lit(0).alias("other"))
    asked = heads.union(dealt.select("a", "g", F.col("b").alias("d"), F.lit(1).alias("other")))
    rows = asked.hint("merge").join(texts, "d").select("a", "g", "other", "d", F.lower("text").alias("text"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for batch in batches:
            a, g, other, d = (np.asarray(batch.column(i)) for i in range(4))
            data, offsets = flat(batch.column(4))
            out = []
            cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (g[1:] != g[:-1]) | (other[1:] != other[:-1])]))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
                if (a[x], g[x]) != group:
                    group, heads = (a[x], g[x]), []
                for p, q in _small_blocks(offsets[x : y + 1]):
                    p, q = p + x, q + x
                    words, at = word_hashes(data[offsets[p] : offsets[q]], offsets[p : q + 1] - offsets[p])
                    of, h, weight = shingles(words, at, idf)
                    if not other[x]:
                        heads += [(h[of == i], weight[of == i].astype(np.float64)) for i in range(q - p)]
                        continue
                    total = np.bincount(of, weights=weight, minlength=q - p)
                    best = np.zeros(q - p)
                    for own, w in heads:
                        if not own.size:
                            continue
                        k = np.minimum(np.searchsorted(own, h), own.size - 1)
                        shared = np.bincount(of, weights=np.where(own[k] == h, np.minimum(w[k], weight), 0), minlength=q - p)
                        best = np.maximum(best, shared / np.maximum(w.sum() + total - shared, 1e-12))
                    out.append((np.full(q - p, a[x]), d[p:q], best))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.repartition("a", "g").sortWithinPartitions("a", "g", "other", "d").mapInArrow(work, "a long, b long, similarity double")


def shingle_counts(texts: DataFrame, idf: Idf) -> np.ndarray:
    """How many texts(text) hold a shingle, per place of its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(PLACES, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in _small_blocks(offsets):
                words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                _, h, _ = shingles(words, at, idf)
                seen += np.bincount((h & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["place", "n"])

    out = np.zeros(PLACES, np.int64)
    for r in texts.select(F.lower("text").alias("text")).mapInArrow(work, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["place"]] = r["n"]
    return out


def neighbours(filed: DataFrame) -> DataFrame:
    """(a, b) of filed(key, then, node, n, failed): texts of one bucket, one of which failed, that stand next to each
    other or next but one in order of (then, node). Buckets of at most SETTLED texts are kept together; larger ones may
    be cut between tasks, so that none gathers in one."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            own = [np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(4).to_numpy(zero_copy_only=False).astype(bool)]
            n = before[0].size
            key, node, failed = (np.concatenate(x) for x in zip(before, own, strict=True))
            for k in (1, 2):
                i = np.arange(max(0, n - k), key.size - k)
                i = i[(key[i] == key[i + k]) & (failed[i] | failed[i + k])]
                if i.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[i + k])), pa.array(np.maximum(node[i], node[i + k]))], schema=names)
            before = [key[-2:], node[-2:], failed[-2:]]

    large = F.col("n") > SETTLED
    rows = filed.select("key", "then", "node", "n", "failed")
    return rows.repartitionByRange("key", F.when(large, F.col("then")), F.when(large, F.col("node"))).sortWithinPartitions("key", "then", "node").mapInArrow(work, "a long, b long")


def prefixes(texts: DataFrame, idf: Idf, seen: np.ndarray, threshold: float) -> DataFrame:
    """(d, root, h, total, left) of texts(d, root, text): the shingles h of each text's prefix, in order of seen and hash,
    the text's whole weight and that from this shingle on; behind the prefix less than threshold of the whole is left."""
    schema = pa.schema([("d", pa.int64()), ("root", pa.int64()), ("h", pa.int64()), ("total", pa.float64()), ("left", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = flat(batch.column(2))
            for a, b in _small_blocks(offsets):
                words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of, h, weight = shingles(words, at, idf)
                order = np.lexsort((h, seen[(h & np.uint64(PLACES - 1)).astype(np.int64)], of))
                of, h, weight = of[order], h[order], weight[order].astype(np.float64)
                total = np.bincount(of, weights=weight, minlength=b - a)
                ends = np.cumsum(weight)
                left = total[of] - (ends - weight - np.concatenate([[0.0], np.cumsum(total)])[of])
                kept = np.flatnonzero(left >= threshold * (1 - SLACK) * total[of])
                of = of[kept]
                cols = (ids[a:b][of], roots[a:b][of], h[kept].view(np.int64), total[of], left[kept])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return texts.select("d", "root", F.lower("text").alias("text")).mapInArrow(work, "d long, root long, h long, total double, left double")


def prefix_pairs(texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """(a, b), a < b, of texts(d, root, text): all pairs of different roots that can have threshold or more.

    The order of the prefixes is one for all texts. What two texts share begins at a shingle that stands in both
    prefixes, and weighs no more than what is left of either from there on: both must have `needed` of their common
    weight left. Roots meet first, by the texts of theirs that could do so at best, and then their texts, so that the
    members of one root never meet each other.
    """
    found = written(prefixes(texts, idf, shingle_counts(texts.select("text"), idf), threshold), "prefixes")
    shared = found.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h")
    needed = threshold / (1 + threshold) * (1 - SLACK)
    found = written(found.hint("merge").join(shared, "h", "left_semi").withColumn("room", F.col("left") / needed - F.col("total")), "shared")
    roots = found.groupBy("h", "root").agg(F.min("total").alias("total"), F.max("room").alias("room"))
    side = lambda df, x: df.select("h", *[F.col(c).alias(c + x) for c in df.columns if c != "h"])
    fits = (F.col("totalb") <= F.col("rooma")) & (F.col("totala") <= F.col("roomb"))
    met = side(roots, "a").hint("merge").join(side(roots, "b"), "h").filter(fits & (F.col("roota") < F.col("rootb"))).select("h", "roota", "rootb", F.col("totalb").alias("least"), F.col("roomb").alias("most"))
    texts_of = found.select("h", "d", "root", "total", "room")
    half = side(texts_of, "a").hint("merge").join(met, ["h", "roota"]).filter("least <= rooma AND totala <= most").select("h", "rootb", "da", "totala", "rooma")
    pairs = half.hint("merge").join(side(texts_of, "b"), ["h", "rootb"]).filter(fits)
    return pairs.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).distinct()


def class_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(d, x, class_d, class_x), one row for each row of docs: its id (NO_ID for null) and xxhash64 of its text, and those
    of the least row, in order of id and hash, that near links join it to."""
    keyed = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idf = frequencies(keyed.select("text"))
    signed = written(signatures(keyed, idf), "signatures")
    one = signed.groupBy("same").agg(F.min(F.struct("d", "x")).alias("rep"), F.first("bands").alias("bands"))
    # the numbers of nodes hold once they are written
    one = written(one.select(F.monotonically_increasing_id().alias("node"), "same", "rep", "bands"), "representatives")

    # `then` is the next band's key
    filed = one.select("node", F.explode(F.arrays_zip(F.col("bands").alias("key"), F.concat(F.slice("bands", 2, BANDS - 1), F.slice("bands", 1, 1)).alias("then"))).alias("x")).select("node", "x.key", "x.then")
    buckets = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    filed = written(filed.hint("merge").join(buckets, "key"), "buckets")
    # by hint, since a list of ids that is small here grows with the corpus: one way to join at every size
    wanted = one.select("node", "rep.d", "rep.x").hint("merge").join(filed.select("node").distinct(), "node", "left_semi")
    texts = keyed.withColumn("x", F.xxhash64("text")).join(wanted.hint("merge"), ["d", "x"]).dropDuplicates(["d", "x"])
    texts = written(texts.select(F.col("node").alias("d"), "text"), "texts")

    star = filed.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    star = written(verified(star, texts, idf), "stars")
    far = star.filter(F.col("similarity") < threshold).select(F.col("a").alias("least"), F.col("b").alias("node"), F.lit(True).alias("failed"))
    judged = filed.filter("n > 2").join(far.hint("merge"), ["least", "node"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    again = judged.groupBy("key").agg(F.min(F.when(F.col("failed"), F.col("node"))).alias("second")).filter("second IS NOT NULL")
    judged = written(judged.hint("merge").join(again, "key"), "judged")
    more = neighbours(judged).union(judged.filter("failed AND node <> second").select(F.col("second").alias("a"), F.col("node").alias("b"))).distinct()
    more = more.join(star.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    links = star.unionByName(verified(written(more, "more"), texts, idf)).filter(F.col("similarity") >= threshold).select("a", "b")
    roots = components(links)

    large = filed.filter(F.col("n") > SETTLED).select("key", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    unsettled = large.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p <> q").select("key")
    left = large.hint("merge").join(unsettled, "key", "left_semi").select(F.col("node").alias("d"), "root").distinct()
    left = written(left.hint("merge").join(texts, "d").select("d", "root", "text"), "unsettled")
    if not left.isEmpty():
        pairs = written(prefix_pairs(left, idf, threshold), "pairs")
        more = written(verified(pairs, left.select("d", "text"), idf).filter(F.col("similarity") >= threshold).select("a", "b"), "links")
        if not more.isEmpty():
            roots = components(more.union(roots.select("node", "root")))
    rooted = one.select("node", "same", "rep").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    members = rooted.select("same", "root").join(least.hint("merge"), "root").select("same", F.col("least.d").alias("class_d"), F.col("least.x").alias("class_x"))
    return signed.select("d", "x", "same").join(members.hint("merge"), "same").select("d", "x", "class_d", "class_x")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, class_id), one row for each row of docs: the least id of the documents that near links join it to.

    Null texts count as empty; texts without words are alike only if equal. A null id comes before all others and is a
    class id like any (null). Rows that share an id are judged one by one, each by its text; repeated rows each get a row.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    rows = class_rows(docs, id_col, text_col, threshold)
    clear = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(clear("d").alias(id_col), clear("class_d").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are the least of their class in order of id and text hash; of rows that repeat
    id and text one stays. Nulls, ties and empty tables as in classes()."""
    kept = class_rows(docs, id_col, text_col, threshold).filter("d = class_d AND x = class_x").select(F.col("d").alias("_kept_d"), F.col("x").alias("_kept_x")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_kept_d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_kept_x"))
    kept = rows.join(kept.hint("merge"), ["_kept_d", "_kept_x"]).dropDuplicates(["_kept_d", "_kept_x"])
    return kept.select("_row.*")
