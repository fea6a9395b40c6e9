"""Approximate quotes: where a text says nearly what a quote says.

A quote of m characters is found in a text if some stretch of the text is within k = floor(m * SHARE / 100) edits of it, so
the likeness 1 - edits / m is at least 0.85. Of k + 1 pieces of the quote at least one stands in that stretch unchanged:
the pieces' first q-grams and the q-grams of the texts meet in an equi-join on their hashes. What meets names stretches of
texts, and only those are compared, bit-parallel, with the quote. Nothing that the definition allows is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import bounded_batches

#: Edits allowed, in percent of the quote's length.
SHARE = 15
#: q-grams written in one batch.
BATCH = 1 << 18
#: Bits of a q-gram's hash that tell whether a quote may have it as a seed.
MARKS = 14


def plain(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hashes(text: str, size: int) -> np.ndarray:
    """Hashes of the q-grams at every position; texts that differ share one by chance only, which costs a comparison."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if codes.size < size:
        return np.zeros(0, np.int64)
    out = np.zeros(codes.size - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : codes.size - size + 1 + i]
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def pieces(quote: str) -> tuple[int, list[int]]:
    """(q, offsets) of the k + 1 seeds of a quote."""
    m = len(quote)
    parts = m * SHARE // 100 + 1
    return m // parts, [m * i // parts for i in range(parts)]


def _masks(quote: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance_in(quote: str, text: str) -> int:
    """The fewest edits between a quote and any stretch of text."""
    return _distance(len(quote), _masks(quote), text)


def _distance(m: int, masks: dict[str, int], text: str) -> int:
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best = every, 0, m, m
    for c in text:
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & every, up & across
        now += bool(rise & high) - bool(fall & high)
        best = min(best, now)
        rise, fall = rise << 1 & every, fall << 1 & every
        along = same | down
        up, down = fall | ~(along | rise) & every, rise & along
    return best


def _windows(quote: str, places: list[int], text: str) -> Iterator[str]:
    """The stretches of text that places, multiples of a quote's length (64 at least), stand for, edits on either side."""
    most, wide = len(quote) * SHARE // 100, max(len(quote), 64)
    for p in places:
        first, last = p * wide - most, (p + 1) * wide + len(quote) + most
        yield text[max(0, first) : max(0, last)]


def _best(quote: str, places: list[int], text: str) -> int | None:
    """The fewest edits at any of the places, None if more than allowed. k edits leave m - 3 - 4 k of a quote's 4-grams as
    they are; a stretch that holds fewer is passed over."""
    m = len(quote)
    most = best = m * SHARE // 100
    least, grams, found = m - 3 - 4 * most, {quote[i : i + 4] for i in range(m - 3)}, None
    for own in _windows(quote, places, text):
        if least > 0 and sum(own[i : i + 4] in grams for i in range(len(own) - 3)) < least:
            continue
        edits = distance_in(quote, own)
        if edits <= best:
            best = found = edits
        if not edits:
            break
    return found


@lru_cache(1024)
def _ladder(quote: str) -> tuple[int, np.ndarray, dict[str, list[tuple[int, list[tuple[int, int, int, dict[str, int]]]]]]]:
    """(q, marks, seeds): where the seeds' hashes fall, and of each seed (offset, parts); parts are the growing parts of the
    quote around it, as (offset, length, edits allowed, masks), the whole last.

    A part of n pieces may have n - 1 edits. Where it has no more, one of its halves, of n1 + n2 = n pieces, has at most
    n1 - 1 or n2 - 1: else there were n. So a stretch with the quote shows some seed whose parts all keep their limits.
    """
    size, offsets = pieces(quote)
    ends = [*offsets, len(quote)]
    chains: list[list[tuple[int, int, int, dict[str, int]]]] = [[] for _ in offsets]

    def split(first: int, last: int) -> None:
        if last - first > 1 or len(offsets) == 1:
            at, end = ends[first], ends[last]
            part = (at, end - at, last - first - 1, _masks(quote[at:end]))
            for chain in chains[first:last]:
                chain.insert(0, part)
        if last - first > 1:
            split(first, (first + last) // 2)
            split((first + last) // 2, last)

    split(0, len(offsets))
    seeds, marks = {}, np.zeros(1 << MARKS, bool)
    for at, chain in zip(offsets, chains, strict=True):
        seeds.setdefault(quote[at : at + size], []).append((at, chain))
    marks[_mark(hashes(quote, size)[offsets])] = True
    return size, marks, seeds


def _mark(hashed: np.ndarray) -> np.ndarray:
    return (hashed.view(np.uint64) >> np.uint64(64 - MARKS)).astype(np.intp)


def fewest_edits(quote: str, text: str, marks_of: Callable[[int], np.ndarray] | None = None) -> int | None:
    """The fewest edits between a quote and any stretch of text, None if more than allowed. From every seed found in place
    the parts around it are compared, small ones first, each on as much text as it can stand on. marks_of gives the marks of
    the text's q-grams where they are known."""
    found, known = None, {}
    size, marks, seeds = _ladder(quote)
    own = _mark(hashes(text, size)) if marks_of is None else marks_of(size)
    for i in np.flatnonzero(marks[own]).tolist():
        for at, chain in seeds.get(text[i : i + size], ()):
            start, edits = i - at, None
            for offset, m, most, masks in chain:
                key = (offset, m, start)
                if key not in known:
                    known[key] = _distance(m, masks, text[max(0, start + offset - most) : start + offset + m + most])
                edits = known[key]
                if edits > most:
                    break
            else:
                found = edits if found is None else min(found, edits)
                if not found:
                    return 0
    return found


def fuzzy_pairs(rows: DataFrame, quote: str, text: str, keep: Sequence[str], made_plain: bool = False) -> DataFrame:
    """keep, edits, likeness: the rows whose text has their quote, with the fewest edits that do.

    For quotes whose source is known: both stand in one row, seeds are looked up in place, and nothing is shuffled. Case
    and white space don't count. A null or empty quote and a null text have nothing. made_plain: both columns hold plain()
    already, which a text of many quotes needs but once.
    """
    keep = list(keep)
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("edits", T.LongType()), T.StructField("likeness", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, marks = None, {}

        def marks_of(size: int) -> np.ndarray:
            if size not in marks:
                marks[size] = _mark(hashes(last, size))
            return marks[size]

        for batch in batches:
            n, found = len(keep), []
            for i, (own, whole) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                # a text's quotes follow one another
                if whole != last:
                    last, marks = whole, {}
                if own and whole and (edits := fewest_edits(own, whole, marks_of)) is not None:
                    found.append((i, edits, round(1 - edits / len(own), 6)))
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(n)], pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], schema.names)

    of = F.col if made_plain else lambda c: plain(F.col(c))
    return bounded_batches(rows.select(*keep, of(quote).alias("_quote"), of(text).alias("_text"))).mapInArrow(work, schema)


def _grams(rows: DataFrame, keys: list[str], text: str, of) -> DataFrame:
    """keys, size, hash, at: of(text) gives (size, positions, hashes)."""
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("at", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for i, own in enumerate(batch.column(len(keys)).to_pylist()):
                for size, at, hashed in of(own):
                    for a in range(0, at.size, BATCH):
                        held.append((i, size, at[a : a + BATCH], hashed[a : a + BATCH]))
                        if sum(h[2].size for h in held[-64:]) >= BATCH or len(held) > 1000:
                            yield made(batch, held)
                            held = []
            if held:
                yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        counts = [h[2].size for h in held]
        row = pa.array(np.repeat([h[0] for h in held], counts))
        arrays = [batch.column(i).take(row) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.repeat([h[1] for h in held], counts), pa.int32()), pa.array(np.concatenate([h[3] for h in held]), pa.int64()), pa.array(np.concatenate([h[2] for h in held]), pa.int64())], schema.names)

    return rows.select(*keys, text).mapInArrow(work, schema)


def _seeds(quote: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    size, offsets = pieces(quote)
    return [(size, np.array(offsets, np.int64), hashes(quote, size)[offsets])]


def fuzzy_quotes(quotes: DataFrame, quote_id: str, quote: str, sources: DataFrame, source_id: str, text: str, on: Sequence[str] = ()) -> DataFrame:
    """(on, quote_id, source_id, edits, likeness): every source that has the quote, with the fewest edits that do.

    on: columns that a quote and its sources share; without any, all sources are searched. Case and white space don't
    count. For quotes whose source isn't known; in prose of few syllables seeds are common, and most pairs are compared.
    Null and empty quotes stand nowhere; a null text says nothing. Of rows that repeat a key with differing texts
    each counts, and the fewest edits are given. Texts of any length are cut into stretches of about a quote's length.
    """
    on = list(on)
    q = quotes.select(*on, F.col(quote_id).alias("_quote_id"), plain(F.col(quote)).alias("_quote")).filter("_quote <> ''").distinct()
    t = sources.select(*on, F.col(source_id).alias("_source_id"), plain(F.col(text)).alias("_text")).filter("_text IS NOT NULL").distinct()
    q, t = (d.withColumn("_key", F.xxhash64(*d.columns)) for d in (q, t))
    size = F.floor(F.length("_quote") / (F.floor(F.length("_quote") * SHARE / 100) + 1))
    # one to six numbers
    sizes = sorted(r[0] for r in q.select(size.cast("int")).distinct().collect())

    def every(own: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n in sizes:
            h = hashes(own, n)
            yield n, np.arange(h.size), h

    seeds = _grams(q.withColumn("_m", F.length("_quote")), [*on, "_key", "_m"], "_quote", _seeds)
    grams = _grams(t, [*on, "_key"], "_text", every).withColumnsRenamed({"_key": "_source_key", "at": "_at"})
    met = grams.join(seeds, [*on, "size", "hash"])
    span = F.greatest(F.col("_m"), F.lit(64))
    places = met.select(F.col("_key"), "_source_key", F.floor((F.col("_at") - F.col("at")) / span).alias("place"))
    found = places.groupBy("_key", "_source_key").agg(F.array_sort(F.collect_set("place")).alias("places"))
    both = found.join(q, "_key").join(t.withColumnRenamed("_key", "_source_key").select("_source_key", "_source_id", "_text"), "_source_key")
    keys = [*on, "_quote_id", "_source_id"]
    schema = T.StructType([*[both.schema[c] for c in keys], T.StructField("m", T.LongType()), T.StructField("edits", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            found = [(i, len(own), edits) for i, (own, whole, at) in enumerate(zip(*(batch.column(n + j).to_pylist() for j in range(3)), strict=True)) if (edits := _best(own, at, whole)) is not None]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(n)], pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], schema.names)

    near = both.select(*keys, "_quote", "_text", "places").mapInArrow(work, schema)
    best = near.groupBy(*keys).agg(F.min_by(F.struct("edits", "m"), F.col("edits") / F.col("m")).alias("b"))
    return best.select(*on, F.col("_quote_id").alias(quote_id), F.col("_source_id").alias(source_id), "b.edits", F.round(1 - F.col("b.edits") / F.col("b.m"), 6).alias("likeness"))
