"""Scans: raw files with decoding and rejects, HTML and Markdown as blocks, positioned words as lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import bounded_batches


def read_raw(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of a folder: path, content, length, modified, and text decoded as UTF-8, UTF-16 by its mark, or
    Latin-1, which never fails; files of white space alone are rejects. (Spark's scan doesn't list files of no bytes.)"""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", "length", F.col("modificationTime").alias("modified"))
    files = raw.withColumn("text", decode_text(F.col("content")))
    empty = X.strip(F.col("text")) == ""
    return files.filter(~empty), files.filter(empty).select("path", F.lit("empty").alias("reason"))


def decode_text(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 3))
    plain = F.when(head == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content)
    utf16 = head.startswith("FFFE") | head.startswith("FEFF")
    return F.when(utf16, F.decode(content, "UTF-16")).when(F.is_valid_utf8(plain.cast("string")), plain.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


# Elements that hold no text of their own, and elements that open a block.
DROPPED = frozenset("script style nav footer aside form noscript svg iframe head".split())
BLOCKS = frozenset("p div section article main body td th tr table ul ol li h1 h2 h3 h4 h5 h6 pre blockquote br".split())


# Elements that hold a page's own text, the first that a page has.
ROOTS = ("main", "article")


class _Blocks(HTMLParser):
    """Blocks of a page in order, each with the root elements that it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.kind, self.now, self.out = 0, "paragraph", [], []
        self.seen, self.inside = dict.fromkeys(ROOTS, 0), dict.fromkeys(ROOTS, 0)
        self.tables, self.rows, self.cell = 0, [], None

    def add(self, kind: str, level: int | None, text: str) -> None:
        # a root counts if it is the first of its kind, or stands in it
        self.out.append((frozenset(r for r in ROOTS if self.inside[r] and self.seen[r] == 1), kind, level, text))

    def put(self) -> None:
        text = "".join(self.now) if self.kind == "code" else " ".join("".join(self.now).split())
        if text.strip():
            level = int(self.kind[1]) if re.fullmatch("h[1-6]", self.kind) else None
            self.add("heading" if level else self.kind, level, f"- {text}" if self.kind == "list" else text)
        self.now = []

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
        self.cell = None

    def end_table(self) -> None:
        """The rows as a Markdown grid, the first as its head; a row that is short is filled up."""
        self.end_cell()
        rows = [r for r in self.rows if any(r)]
        width = max(map(len, rows), default=0)
        if rows:
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.add("table", None, "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))
        self.rows = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += 1
        if self.tables:
            if tag == "table":
                self.tables += 1
            elif self.tables == 1 and tag == "tr":
                self.end_cell()
                self.rows.append([])
            elif self.tables == 1 and tag in ("td", "th"):
                self.end_cell()
                if not self.rows:
                    self.rows.append([])
                self.cell = []
            elif self.cell is not None and tag in BLOCKS:
                self.cell.append(" ")
            return
        if tag in BLOCKS:
            self.put()
            self.kind = tag if re.fullmatch("h[1-6]", tag) else {"li": "list", "pre": "code"}.get(tag, "paragraph")
        if tag in ROOTS and not self.skip:
            self.seen[tag] += not self.inside[tag]
            self.inside[tag] += 1
        if tag == "table" and not self.skip:
            self.tables = 1

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skip:
            self.skip -= 1
        if self.tables:
            if tag == "table":
                self.tables -= 1
                if not self.tables:
                    self.end_table()
            return
        if tag in BLOCKS:
            self.put()
            self.kind = "paragraph"
        if tag in ROOTS and self.inside[tag] and not self.skip:
            self.inside[tag] -= 1

    def handle_data(self, data):
        if self.skip:
            return
        if self.tables:
            if self.cell is not None:
                self.cell.append(data)
        else:
            self.now.append(data)

    def blocks(self, page: str) -> list[tuple[str, int | None, str]]:
        self.feed(page)
        self.close()
        if self.tables:
            self.end_table()
        self.put()
        root = next((r for r in ROOTS if self.seen[r]), None)
        return [b[1:] for b in self.out if root is None or root in b[0]]


def html_to_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, block_no, block_type, level, text): headings, paragraphs, list items, code and tables (as Markdown grids) of
    HTML pages, noise dropped. The page's first main element, else its first article, else all of it is read, as parsed: a
    tag in a comment or script is none. The tree walk is per page; rows are the parallel axis."""
    schema = T.StructType([df.schema[key], T.StructField("block_no", T.LongType()), T.StructField("block_type", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, *b) for k, page in zip(f[key], f[column].fillna(""), strict=True) for i, b in enumerate(_Blocks().blocks(page))]
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"level": "Int32"})

    return bounded_batches(df.select(key, column)).mapInPandas(work, schema).filter(F.col("block_type").isin("code", "table") | ~X.is_noise(F.col("text")))


def text_to_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block_type, text, start): blank-line blocks of plain text; lines inside a fence are one code block."""
    each = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no")
    rows = each.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fence = F.col("line").rlike(r"^\s*```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("code", (F.col("fences") % 2 == 1) | fence)
    heading = ~F.col("code") & F.coalesce(X.detect_heading(F.col("line"))["confidence"] >= 0.65, F.lit(False))
    rows = rows.withColumn("heading", heading).withColumn("blank", ~F.col("code") & (X.strip(F.col("line")) == ""))
    opens = F.col("blank") | F.col("heading") | F.coalesce(F.lag(F.col("blank") | F.col("heading")).over(order), F.lit(True)) | (F.coalesce(F.lag("code").over(order), F.lit(False)) != F.col("code"))
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(order)).filter("NOT blank")
    kind = F.when(F.max("code"), "code").when(F.max("heading"), "heading").otherwise("paragraph")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    blocks = rows.groupBy(key, "block").agg(kind.alias("block_type"), joined.alias("text"), F.min("start").alias("start"))
    return blocks.withColumn("block_no", F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1).drop("block")


def front_matter(text: Column) -> Column:
    """The flat `key: value` lines between --- lines at a Markdown text's start, as a map."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda x: F.split(x, r":\s*", 2)), lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))


def _first(v) -> tuple[int, object]:
    """A value as it sorts in Spark: null first, NaN last."""
    return (0, 0) if v is None else (2, 0) if v != v else (1, v)


def _largest(values: list) -> float | None:
    return max((v for v in values if v is not None), key=_first, default=None)


def words_to_lines(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """words(doc, page, top, x0, text, size) -> (doc, page, line_no, top, text, size): a word further than tolerance below
    the top of the line before it opens the next one. Pages are the parallel axis: their words come sorted and pass as a
    stream, of which only the line at hand is held."""
    schema = T.StructType([words.schema["doc"], words.schema["page"], T.StructField("line_no", T.IntegerType()), T.StructField("top", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, number, top, line, out = None, 0, None, [], []

        def end() -> None:
            if len(line) > 1:
                line.sort(key=lambda w: (_first(w[0]), _first(w[1]), _first(w[2])) if None in w or w[0] != w[0] or w[2] != w[2] else ((1, w[0]), (1, w[1]), (1, w[2])))
            out.append((*page, number, top, " ".join(w[1] for w in line if w[1] is not None), _largest([w[2] for w in line])))
            line.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema.names)
            out.clear()
            return batch

        arrow = None
        for batch in batches:
            arrow = arrow or [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.float64(), pa.string(), pa.float64()]
            for doc, at, y, x, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, at) != page:
                    if line:
                        end()
                    page, number, top = (doc, at), 0, y
                elif y is not None and top is not None and not abs(y - top) <= tolerance:
                    end()
                    number, top = number + 1, y
                line.append((x, text, size))
            if out:
                yield made()
        if line:
            end()
            yield made()

    each = words.select("doc", "page", F.col("top").cast("double"), F.col("x0").cast("double"), "text", F.col("size").cast("double"))
    return each.repartition("doc", "page").sortWithinPartitions("doc", "page", "top", "x0", "text", "size").mapInArrow(work, schema)


def body_size(lines: DataFrame) -> DataFrame:
    """Per document the size in which most characters are set."""
    sizes = lines.groupBy("doc", F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"))
    return sizes.groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body_size"))


def append_by_month(df: DataFrame, path: str, at: str) -> None:
    """Append to a table with one folder per month."""
    df.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions that df has rows of, and no others: a repeated write leaves one generation."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def export(df: DataFrame, fmt: str, path: str) -> None:
    """CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
