"""I-Match fingerprints: terms of a band of document frequency, sorted, hashed under several random lexicons.

Everything is DataFrame functions; no Python runs on executors. Document frequencies are counted term by term over all
documents. The band holds the terms that are in at least LEAST documents and at least one document in RARE, and in at most
the share MOST of all documents: an inverse document frequency from 1 / MOST to RARE, whatever the size of the table. It
can't hold more than RARE times the mean number of distinct terms of a text. A band of at most MOST_TERMS terms goes into
the plan as a constant; a larger one stays a table, which the texts' distinct terms are joined to. Both give the same
fingerprints. Terms are read from the whole of every text.

A lexicon of level R keeps one term in R, and there are several of each level: coarse ones survive edits of short texts,
fine ones edits of long texts. The first lexicon keeps all terms of the band.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Places of the band's table, which hold a few terms each.
PLACES = 1 << 16
#: The band.
LEAST, RARE, MOST = 2, 1 << 10, 0.2
#: The most terms of a band that is a constant in the plan, and over how many keys a term of a larger one is dealt.
MOST_TERMS, SALTS = 1 << 18, 16
LEVELS = (16, 64, 256, 1024, 4096)
PER_LEVEL = 8
#: The hash of no terms, which is the hash function's seed.
NONE = 42


def term_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the text's terms: runs of letters and digits, lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.sort_array(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))))


def _place(h: Column) -> Column:
    return h.bitwiseAND(F.lit(PLACES - 1)).cast("int")


class Band(NamedTuple):
    """The band's term hashes in order of their places, and where each place starts in them, as constant arrays; or, where
    they are too many for that, a table of them."""

    terms: Column | None
    starts: Column | None
    table: DataFrame | None = None

    def holds(self, h: Column) -> Column:
        start = F.get(self.starts, _place(h))
        return F.array_contains(F.slice(self.terms, start + 1, F.get(self.starts, _place(h) + 1) - start), h)


def lexicon(docs: DataFrame, text_col: str = "text", least: int = LEAST, most: float = MOST, rare: int = RARE, most_terms: int = MOST_TERMS) -> Band:
    """The band's terms. A document counts once for a term; at most most_terms terms come to the driver.

    Null texts count as documents without terms; an empty table has an empty band.
    """
    counts = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "terms")
    total = docs.count()
    kept = counts.filter((F.col("n") >= max(least, total / rare)) & (F.col("n") <= max(total * most, least))).select("term")
    if kept.count() > most_terms:
        return Band(None, None, kept)
    terms = sorted((r["term"] for r in kept.collect()), key=lambda h: (h & (PLACES - 1), h))
    dropped(counts)
    starts, at = [], 0
    for place in range(PLACES + 1):
        while at < len(terms) and terms[at] & (PLACES - 1) < place:
            at += 1
        starts.append(at)
    constant = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    return Band(constant(terms or [0], "bigint"), constant(starts, "int"))


def fingerprint(text: Column, band: Band) -> Column:
    """Array of 64-bit hashes, the whole band's first and then PER_LEVEL of each level; NONE where a lexicon holds no term.

    Equal texts have equal fingerprints; a text without a term of the band has the hash of itself first. The band must be
    a constant; with_fingerprint() takes any.
    """
    return of_terms(text, F.filter(term_hashes(text), band.holds))


def of_terms(text: Column, kept: Column) -> Column:
    """The fingerprint of a text whose terms in the band, sorted and distinct, are `kept`."""

    def hashes(terms: Column) -> Column:
        whole = F.when(F.size(terms) == 0, F.xxhash64(F.coalesce(text, F.lit("")))).otherwise(F.xxhash64(terms))
        return F.flatten(F.array(F.array(whole), *[_level(terms, rate) for rate in LEVELS]))

    # an array of one binds the terms once for all levels
    return F.flatten(F.transform(F.array(kept), hashes))


def with_fingerprint(rows: DataFrame, text_col: str, name: str, band: Band) -> DataFrame:
    """rows and a column `name`, the fingerprint of text_col (null: of the empty text).

    A band in a table is joined to the distinct terms of the distinct texts, which are told apart by SHA-256; a frequent
    term is dealt over SALTS keys.
    """
    if band.table is None:
        return rows.withColumn(name, fingerprint(F.col(text_col), band))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = rows.select(F.sha2(text, 256).alias("_key"), text.alias("_text")).groupBy("_key").agg(F.first("_text").alias("_text"))
    texts = written(texts, "texts")
    terms = texts.select("_key", F.explode(term_hashes(F.col("_text"))).alias("term")).withColumn("salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    held = band.table.select("term", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])).alias("salt"))
    kept = terms.hint("merge").join(held, ["term", "salt"]).groupBy("_key").agg(F.sort_array(F.collect_list("term")).alias("_kept"))
    none = F.array().cast("array<bigint>")
    prints = texts.hint("merge").join(kept, "_key", "left").select("_key", of_terms(F.col("_text"), F.coalesce("_kept", none)).alias("_print"))
    prints = written(prints, "fingerprints")
    dropped(texts)
    return rows.withColumn("_key", F.sha2(text, 256)).hint("merge").join(prints, "_key").select(*rows.columns, F.col("_print").alias(name))


def _level(kept: Column, rate: int) -> Column:
    def cell(h: Column) -> Column:  # from bits that the place doesn't use
        return F.pmod(F.shiftrightunsigned(h, 20), F.lit(rate))

    def one(j: int, terms: Column) -> Column:
        return F.xxhash64(F.filter(terms, lambda h: cell(h) == j))

    near = F.filter(kept, lambda h: cell(h) < PER_LEVEL)
    return F.flatten(F.transform(F.array(near), lambda terms: F.array(*[one(j, terms) for j in range(PER_LEVEL)])))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), "-")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the lexicons that hold a term of either text.

    A level all of whose lexicons hold terms of both texts is too coarse for their length and is left out, unless no
    other level holds any term.
    """

    def level(fp: Column, i: int) -> Column:
        return F.slice(fp, 2 + i * PER_LEVEL, PER_LEVEL)

    crowded = lambda fp, i: ~F.array_contains(level(fp, i), F.lit(NONE).cast("long"))
    pairs = lambda x, y: F.arrays_zip(x.alias("a"), y.alias("b"))
    fine = F.flatten(F.array(*[F.when(crowded(a, i) & crowded(b, i), F.slice(pairs(a, b), 1, 0)).otherwise(pairs(level(a, i), level(b, i))) for i in range(len(LEVELS))]))
    held = F.filter(fine, lambda x: (x["a"] != NONE) | (x["b"] != NONE))
    used = F.when(F.size(held) > 0, held).otherwise(F.filter(pairs(a, b), lambda x: (x["a"] != NONE) | (x["b"] != NONE)))
    return F.get(F.transform(F.array(used), lambda u: F.size(F.filter(u, lambda x: x["a"] == x["b"])) / F.size(u)), F.lit(0))


def with_next(docs: DataFrame, id_col: str, text_col: str, n_buckets: int | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """docs' (id, text), the next text in order of ids, the first one after the last, and of each of `carry`, columns of
    docs, its value here and there (as next_...); one shuffle, no global window.

    Ids are cut into ranges at quantiles that are ids of the table; a range's first document goes to the range before it
    too. Rows that share an id follow by text; null ids come first and stay null; a null text is the empty one. The next
    text of a table's only row is itself. An empty table gives no rows.
    """
    spark, own = docs.sparkSession, carry or {}
    n = n_buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = docs.select(F.col(id_col).cast("long").alias("_given"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(k) for k, c in own.items()])
    got = rows.select(F.percentile_approx("id", [i / n for i in range(n)], 10_000).alias("q"), F.min("id").alias("least")).first()
    if got["least"] is None:
        return rows.select(F.col("_given").alias("id"), "text", F.lit("").alias("next"), *own, *[F.col(k).alias(f"next_{k}") for k in own])
    starts = sorted({got["least"], *got["q"]})
    edges = F.array(*[F.lit(s) for s in starts])
    at = F.size(F.filter(edges, lambda s: s <= F.col("id"))) - 1
    # the first document of a range also ends the range before; the very first one ends the last range
    ends = F.when(F.array_contains(edges, F.col("id")), F.array(at, F.pmod(at - 1, F.lit(len(starts))))).otherwise(F.array(at))
    dealt = rows.select("*", F.posexplode(ends).alias("guest", "range"))
    order = Window.partitionBy("range").orderBy(F.expr("guest = 1"), "id", "text")
    led = dealt.select("*", F.lead("text").over(order).alias("next"), *[F.lead(k).over(order).alias(f"next_{k}") for k in own]).filter("guest = 0")
    return led.select(F.col("_given").alias("id"), "text", F.coalesce("next", F.lit("")).alias("next"), *own, *[f"next_{k}" for k in own])


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 4) code points replaced by as many from the start of the following one (or all)."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))
