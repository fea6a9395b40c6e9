"""Lines, blocks and boilerplate of documents; rows as text; content types."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import bounded_batches


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def repeated_lines(pages: DataFrame, doc: str, page: str, text: str, min_pages: int = 3, threshold: float = 0.6) -> DataFrame:
    """(doc, line, pages): lines among the first or last two of a page that stand on most pages of their document."""
    own = F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")
    ends = F.array_distinct(F.concat(F.slice(own, 1, 2), F.slice(own, F.greatest(F.size(own) - 1, F.lit(1)), F.lit(2))))
    each = pages.select(doc, page, F.explode(ends).alias("line")).filter(F.length("line").between(3, 120))
    counts = each.groupBy(doc, "line").agg(F.countDistinct(page).alias("pages"))
    totals = pages.groupBy(doc).agg(F.countDistinct(page).alias("total"))
    return counts.join(totals, doc).filter((F.col("total") >= min_pages) & (F.col("pages") >= F.greatest(F.lit(min_pages - 1), F.floor(F.col("total") * threshold)))).select(doc, "line", "pages")


def strip_boilerplate(pages: DataFrame, known: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, kept lines) without known lines and bare page numbers."""
    each = pages.select(doc, page, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("line", X.strip(F.col("raw")))
    left = each.filter(~F.col("raw").rlike(X.PAGE_NUMBER)).join(known.select(doc, "line"), [doc, "line"], "left_anti")
    kept = left.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("l"))
    return kept.select(doc, page, X.strip(F.array_join(F.transform("l", lambda x: x["raw"]), "\n")).alias("text"))


def paragraph_list(text: Column | str) -> Column:
    """The blank-line paragraphs of a text that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), X.strip), lambda p: p != "")


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, content): blank-line paragraphs that aren't empty; a row is a whole text, so nothing is shuffled."""
    return df.select(key, F.posexplode(paragraph_list(text)).alias("ordinal", "content"))


def heading_sections(df: DataFrame, key: str, text: str, least: float = 0.65) -> DataFrame:
    """(key, line_no, section): lines with the number of their section, which a heading opens."""
    h = X.detect_heading(F.col("line"))
    own = lines(df, key, text).withColumn("opens", F.coalesce(h["confidence"] >= least, F.lit(False)))
    return own.withColumn("section", F.sum(F.col("opens").cast("int")).over(Window.partitionBy(key).orderBy("line_no")))


def row_records(df: DataFrame, columns: list[str]) -> Column:
    """A row as `Header: value` parts, empty cells left out."""
    return F.concat_ws(" | ", *[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])


def range_of(df: DataFrame, order: str) -> Column:
    """A row's range by `order`, ascending from 0 with nulls first, cut at quantiles. Unlike the number of a partition it
    depends on the row alone, so it is the same wherever it is worked out."""
    value = F.col(order)
    if isinstance(df.schema[order].dataType, T.StringType):
        # a text's first seven bytes, as a number
        value = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    elif not isinstance(df.schema[order].dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        raise TypeError(f"no ranges of {df.schema[order].dataType.simpleString()}")
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.select(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted({c for c in cuts if c == c})

    def place(low: int, high: int) -> Column:
        """How many of the cuts from low to high a value reaches, and low: halved, since it is asked for every row."""
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(value < F.lit(cuts[mid]), place(low, mid)).otherwise(place(mid + 1, high))

    return F.when(value.isNull(), 0).otherwise(place(0, len(cuts)))


def table_blocks(df: DataFrame, order: str, columns: list[str], group: int = 25) -> DataFrame:
    """(block_no, text): rows in order, `group` records a block. Blocks are numbered by the order column's rank, which is
    computed in ranges: counts per range come first, so no single task sees all rows."""
    ranged = df.withColumn("_part", range_of(df, order))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("_part", (F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    ranked = ranged.join(F.broadcast(starts), "_part").withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("start") - 1)
    rows = ranked.select((F.floor(F.col("rank") / group)).alias("block_no"), "rank", row_records(df, columns).alias("record"))
    return rows.groupBy("block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record"))), lambda x: x["record"]), "\n").alias("text"))


def classify_text(text: Column) -> Column:
    """html, json, csv, markdown or text, by the shape of a text's first 200 lines."""
    head = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 200)
    t = F.ltrim(F.coalesce(text, F.lit("")))
    commas = F.transform(F.filter(head, lambda x: F.trim(x) != ""), lambda x: F.regexp_count(x, F.lit(",")))
    even = (F.size(commas) >= 2) & (F.array_min(commas) >= 1) & (F.array_min(commas) == F.array_max(commas))
    marked = F.size(F.filter(head, lambda x: x.rlike(r"^(#{1,6} |[-*] |```|\|.*\|$)")))
    return F.when(t.rlike(r"(?i)^<(!doctype html|html|head|body)"), "html").when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json").when(even, "csv").when(marked >= 2, "markdown").otherwise("text")


def json_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of the fields of JSON objects, one level deep."""
    kinds = F.from_json(column, "map<string,string>")
    return df.select(key, F.explode(kinds).alias("path", "value"))


def validate_extraction(df: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    return df.groupBy(key).agg((F.sum(F.length(F.coalesce(text, F.lit("")))) >= least).alias("valid"))


def best_terms(chunks: list[str], k: int) -> list[tuple[int, int, str]]:
    """(chunk, place, term) of one document's chunks; see keywords()."""
    counts = [Counter(X.term_list(c, 3)) for c in chunks]
    df = Counter(term for c in counts for term in c)
    weight = {term: math.log(1 + len(chunks) / n) for term, n in df.items()}
    out = []
    for i, c in enumerate(counts):
        best = sorted((-round(tf * weight[term], 9), term) for term, tf in c.items())[:k]
        out += [(i, place, term) for place, (_, term) in enumerate(best, 1)]
    return out


def keywords(docs: DataFrame, doc: str, chunks: str, k: int = 6) -> DataFrame:
    """(doc, ordinal, place, term): the k terms of three or more characters of each chunk by count x ln(1 + chunks / chunks
    with the term). A document is a row with the array of its chunks; terms are counted within it, nothing is shuffled."""
    schema = T.StructType([docs.schema[doc], T.StructField("ordinal", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("term", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in enumerate(batch.column(1)):
                found = best_terms(own.as_py() or [], k)
                if found:
                    key = batch.column(0).take(pa.array([row] * len(found), pa.int64()))
                    yield pa.RecordBatch.from_arrays([key, *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string())))], schema.names)

    return bounded_batches(docs.select(doc, chunks)).mapInArrow(work, schema)


def dedupe_chunks(chunks: DataFrame, doc: str, ordinal: str, text: str) -> DataFrame:
    """Chunks whose white-space-normal content doesn't repeat an earlier one of the same document."""
    first = F.min(ordinal).over(Window.partitionBy(doc, F.sha2(X.strip(F.regexp_replace(text, r"\s+", " ")), 256)))
    return chunks.withColumn("_first", first).filter(F.col("_first") == F.col(ordinal)).drop("_first")


def regions(blocks: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """blocks with region: maximal runs of one kind."""
    w = Window.partitionBy(doc).orderBy(order)
    change = F.coalesce(F.lag(kind).over(w) != F.col(kind), F.lit(True)).cast("int")
    return blocks.withColumn("_c", change).withColumn("region", F.sum("_c").over(w)).drop("_c")
