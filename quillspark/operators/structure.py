"""Structure of parsed documents: heading paths, titles, Markdown and JSON as blocks, tables as grids, final chunk rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.batches import bounded_batches

DEEPEST = 6
#: Limits of JSON as lines: nesting, items of an array, lines of a block.
MAX_DEPTH, MAX_ITEMS, LINES = 8, 200, 40
#: Limits of table cells: characters of a cell, and of one that may be a header's.
MAX_CELL, MAX_LABEL = 300, 60


def heading_paths(blocks: DataFrame, key: str, order: str, level: str, text: str) -> DataFrame:
    """blocks with heading_path: the headings that a block stands under, outermost first; a heading's own text ends its path.

    A heading ends all sections of its level and deeper ones. So the last heading of a level is open where no shallower one
    is more recent. Blocks of null level are no headings; levels are held to 1 to 6. `order` is unique in a document; the
    running frames hold one row a level, however long the document is.
    """
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.when(F.col(level).isNotNull(), F.least(F.greatest(F.col(level), F.lit(1)), F.lit(DEEPEST)))
    last = [F.last(F.when(held == n, F.struct(F.col(order).alias("at"), X.strip(F.col(text)).alias("text"))), True).over(so_far).alias(f"_h{n}") for n in range(1, DEEPEST + 1)]
    rows = blocks.select("*", *last)
    opened = [F.lit(True) if n == 1 else F.coalesce(F.col(f"_h{n}.at") > F.greatest(F.lit(-1), *[F.col(f"_h{m}.at") for m in range(1, n)]), F.lit(True)) for n in range(1, DEEPEST + 1)]
    path = F.array_compact(F.array(*[F.when(o, F.col(f"_h{n}.text")) for n, o in enumerate(opened, 1)]))
    return rows.withColumn("heading_path", path).drop(*[f"_h{n}" for n in range(1, DEEPEST + 1)])


def document_title(blocks: DataFrame, key: str, order: str, heading: Column, text: str, fallback: str | None = None) -> DataFrame:
    """(key, title): the first heading of 3 to 120 characters in a document's first 12 blocks (order counts from 0), else the
    first line of 8 to 120 characters that opens one of its first 4 blocks, else the fallback."""
    own = X.strip(F.col(text))
    line = F.split(own, "\n", 2)[0]
    named = heading & F.length(text).between(3, 120) & (F.col(order) < 12)
    opening = F.length(line).between(8, 120) & (F.col(order) < 4)
    first = lambda value, where: F.min_by(value, F.when(where, F.col(order)))
    chosen = blocks.groupBy(key).agg(first(own, named).alias("a"), F.min(F.when(named, F.col(order))).alias("_a"), first(line, opening).alias("b"), F.min(F.when(opening, F.col(order))).alias("_b"))
    return chosen.select(key, F.when(F.col("_a").isNotNull(), F.col("a")).when(F.col("_b").isNotNull(), F.col("b")).otherwise(F.lit(fallback)).alias("title"))


def heading_by_font(line: Column, size: Column, body: Column, bold: Column) -> Column:
    """(level, confidence) of a line set in `size` on a page whose body is set in `body`.

    What the text says for certain (labels and numbers) goes first; then the size decides, also against a heading; lines
    without sizes are headings by capitals or by bold type of at most 10 words.
    """
    s = X.strip(line)
    words = F.size(F.split(s, r"\s+"))
    said = X.detect_heading(line)
    out = s.isNull() | (s == "") | (F.length(s) > 120) | (words > 14) | s.rlike(r"[.!?;:]$")
    as_heading = lambda level, sure: F.struct(F.lit(level).alias("level"), F.lit(sure).alias("confidence"))
    ratio = F.when((size > 0) & (body > 0), size / body)
    by_size = F.when(ratio >= 1.35, as_heading(1, 0.9)).when(ratio >= 1.15, as_heading(2, 0.75)).when((ratio >= 1.05) & bold, as_heading(3, 0.6))
    return F.when(said["confidence"] >= 0.7, said).when(out, F.lit(None)).when(ratio.isNotNull(), by_size).when(said.isNotNull(), said).when(bold & (words <= 10), as_heading(3, 0.55))


def looks_like_header(cells: Column) -> Column:
    """Whether a row of cells may name columns: some cell is filled, none is over 60 characters, and at most a third of
    the filled ones (rounded down) are numbers. A null row is none."""
    filled = F.filter(F.transform(cells, lambda c: X.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    bare = lambda c: X.strip(F.regexp_replace(c, "[,%$€]", ""))
    numbers = F.size(F.filter(filled, lambda c: bare(c).rlike(r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf(?:inity)?)$")))
    return F.coalesce((F.size(filled) > 0) & ~F.exists(filled, lambda c: F.length(c) > MAX_LABEL) & (numbers <= F.floor(F.size(filled) / 3)), F.lit(False))


def cell(c: Column) -> Column:
    """A cell of a Markdown grid: trimmed, held to 300 characters, without what would end the cell or the row."""
    s = X.strip(F.coalesce(c.cast("string"), F.lit("")))
    held = F.when(F.length(s) > MAX_CELL, F.concat(F.substring(s, 1, MAX_CELL - 1), F.lit("…"))).otherwise(s)
    return F.regexp_replace(F.regexp_replace(held, r"\|", r"\\|"), r"[\n\r]", " ")


def grid_row(df: DataFrame, columns: list[str]) -> Column:
    """A row as a line of a Markdown grid."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))


def markdown_grid(df: DataFrame, block: str, order: str, columns: list[str]) -> DataFrame:
    """(block, text): the rows of each block, in order, as a Markdown grid under the columns' names."""
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    rows = df.select(block, order, grid_row(df, columns).alias("_row"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "_row"))), lambda r: r["_row"])
    return rows.groupBy(block).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("text"))


def schema_block(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row (text): what a table is called, its columns and its number of rows."""
    return df.agg(F.concat(F.lit(f"Dataset: {name}\nColumns ({len(columns)}): {', '.join(columns)}\nRows: "), F.format_number(F.count(F.lit(1)), 0)).alias("text"))


#: Stands for a line end inside a quoted cell; a character that Unicode leaves to private use.
ASIDE = chr(0xE000)


_FIELD = re.compile(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)')
_QUOTED = re.compile(r'\A"(.*)"(?=[\r\x85\u2028\u2029]?\Z)', re.DOTALL)
_WHITE = " \t\n\x0b\f\r"


def _delimited(text: str | None) -> list[list[str]]:
    """The cells of each line of a delimited text that isn't blank."""
    parts = (text or "").split('"')
    # between quotes, line ends stand aside while lines are split; behind a quote that none closes they don't
    held = '"'.join(p.replace("\n", ASIDE) if i % 2 == 1 and i < len(parts) - 1 else p for i, p in enumerate(parts))
    lines = [x for x in re.split(r"\r?\n", held) if x.strip(_WHITE)]
    return [[_QUOTED.sub(r"\1", c).replace('""', '"').strip(_WHITE).replace(ASIDE, "\n") for c in _FIELD.findall("," + x)] for x in lines]


def delimited_blocks(df: DataFrame, key: str, text: str, group: int = 25) -> DataFrame:
    """(key, block_no, text) of delimited texts: block 0 is the schema, the others hold `group` records each.

    The first line names the columns if it looks like a header; else they are column_1 and so on. Lines without a filled
    cell make no record. Cells are split at commas; double quotes hold cells together, line ends in them too, and one that
    is never closed is a character like any. Null and blank texts have no block. Texts are taken apart once, in Arrow
    batches: as nested expressions over arrays the same is worked out again for each place that names it.
    """
    schema = T.StructType([df.schema[key], T.StructField("_cells", T.ArrayType(T.ArrayType(T.StringType())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array([_delimited(t) for t in batch.column(1).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells], schema.names)

    rows = bounded_batches(df.select(key, text)).mapInArrow(work, schema).filter(F.size("_cells") > 0)
    rows = rows.withColumn("_head", F.col("_cells")[0]).withColumn("_named", looks_like_header(F.col("_head")))
    body = F.when(F.col("_named"), F.slice("_cells", F.lit(2), F.size("_cells"))).otherwise(F.col("_cells"))
    widest = F.array_max(F.transform("_cells", F.size))
    columns = F.when(F.col("_named"), F.col("_head")).otherwise(F.transform(F.sequence(F.lit(1), widest), lambda i: F.concat(F.lit("column_"), i)))
    label = lambda i: F.when(F.coalesce(F.get(F.col("_columns"), i), F.lit("")) != "", F.get(F.col("_columns"), i)).otherwise(F.concat(F.lit("column_"), i + 1))
    record = lambda cells: F.array_join(F.filter(F.transform(cells, lambda c, i: F.when(c != "", F.concat(label(i), F.lit(": "), c))), lambda c: c.isNotNull()), " | ")
    # lines and blocks as rows: what an explode passes on is worked out once
    rows = rows.select(key, F.explode(F.array(F.struct(columns.alias("_columns"), body.alias("_body")))).alias("_t")).select(key, "_t.*")
    rows = rows.select(key, "_columns", F.size("_body").alias("_n"), F.explode(F.array(F.filter(F.transform("_body", record), lambda r: r != ""))).alias("_r"))
    first = F.concat(F.lit("Columns ("), F.size("_columns"), F.lit("): "), F.array_join("_columns", ", "), F.lit("\nRows: "), F.format_number(F.col("_n"), 0))
    rows = rows.select(key, first.alias("_first"), "_r", F.explode(F.sequence(F.lit(0), F.ceil(F.size("_r") / group).cast("int"))).alias("_p"))
    own = F.array_join(F.slice("_r", (F.col("_p") - 1) * group + 1, F.lit(group)), "\n")
    return rows.select(key, F.col("_p").cast("long").alias("block_no"), F.when(F.col("_p") == 0, F.col("_first")).otherwise(own).alias("text"))


def markdown_to_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block_type, level, text): headings, tables, code, lists and paragraphs of Markdown texts.

    Front matter is left out. Only # lines are headings. A table is a run of pipe lines whose second one is a divider; it
    stays whole. Code is what stands between fences, to the end if the last is missing. Null texts have no block.
    """
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    order = Window.partitionBy(key).orderBy("line_no")
    before = lambda c, none: F.coalesce(F.lag(c).over(order), F.lit(none))
    rows = df.select(key, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("fence", F.col("line").rlike(r"^\s*```")).withColumn("fences", F.sum(F.col("fence").cast("int")).over(order))
    rows = rows.withColumn("code", F.col("fence") | (F.col("fences") % 2 == 1)).withColumn("pipe", ~F.col("code") & F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    divider = F.col("line").rlike(r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")
    rows = rows.withColumn("run", F.sum((F.col("pipe") != before("pipe", False)).cast("int")).over(order))
    per_run = Window.partitionBy(key, "run")
    rows = rows.withColumn("nth", F.col("line_no") - F.min("line_no").over(per_run)).withColumn("table", F.col("pipe") & F.max(F.col("pipe") & divider & (F.col("nth") == 1)).over(per_run))
    heading = F.regexp_extract("line", r"^\s*(#{1,6})\s+\S", 1)
    rows = rows.withColumn("level", F.when(~F.col("code") & (heading != ""), F.length(heading))).withColumn("blank", ~F.col("code") & (X.strip(F.col("line")) == ""))
    kind = F.when(F.col("code"), "code").when(F.col("table"), "table").when(F.col("level").isNotNull(), "heading").when(F.col("blank"), "blank").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    opens = (F.col("kind") != before("kind", "")) | (F.col("kind") == "heading") | (F.col("fence") & (F.col("fences") % 2 == 1))
    rows = rows.withColumn("block", F.sum(opens.cast("int")).over(order)).filter("kind <> 'blank' AND NOT fence")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    blocks = rows.groupBy(key, "block").agg(F.first("kind").alias("kind"), F.first("level").alias("level"), joined.alias("raw"))
    clean = F.when(F.col("kind") == "heading", F.regexp_replace("raw", r"^\s*#{1,6}\s+|\s*#*\s*$", "")).when(F.col("kind") == "code", F.col("raw")).otherwise(X.strip(F.col("raw")))
    numbered = F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1
    return blocks.select(key, numbered.cast("long").alias("block_no"), F.when((F.col("kind") == "paragraph") & X.is_list(F.col("raw")), "list").otherwise(F.col("kind")).alias("block_type"), "level", clean.alias("text"))


def _leaves(value: object) -> Iterator[str]:
    """path: value lines of a parsed JSON value, in its own order; the walk keeps its own stack."""
    todo: list[tuple[str, int, object]] = [("", 0, value)]
    while todo:
        path, depth, v = todo.pop()
        if depth < 0:  # a note in the place of items
            yield f"{path}: {v}"
        elif depth > MAX_DEPTH:
            yield f"{path}: (nested content omitted)"
        elif isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, depth + 1, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            rest = len(v) - MAX_ITEMS
            if rest > 0:
                todo.append((path, -1, f"({rest} more items omitted)"))
            todo += [(f"{path}[{i}]", depth + 1, x) for i, x in reversed([*enumerate(v[:MAX_ITEMS])])]
        else:
            yield f"{path or 'value'}: {v}"


def json_to_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_no, block_no, line): the leaves of JSON texts as `a.b[0].c: value`, 40 a block.

    Fields keep their order (which variants don't, hence the parse in Arrow batches). What lies deeper than 8 levels, and
    array items after the 200th, leave one line that says so. Null texts and texts that are no JSON have no line.
    """
    schema = T.StructType([df.schema[key], T.StructField("line_no", T.LongType()), T.StructField("block_no", T.LongType()), T.StructField("line", T.StringType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, source in zip(f[key], f[column], strict=True):
                try:
                    value = json.loads(source) if source is not None else None
                except ValueError:
                    continue
                if source is not None:
                    rows += [(k, i, i // LINES, line) for i, line in enumerate(_leaves(value))]
            yield pd.DataFrame(rows, columns=schema.names)

    return bounded_batches(df.select(key, column)).mapInPandas(work, schema)


def finalize_chunks(chunks: DataFrame, docs: DataFrame, doc: str, order: str, strategy: str) -> DataFrame:
    """chunks with dense ordinals from 0, the document's language where they have none, and the strategy that made them."""
    own = Window.partitionBy(doc).orderBy(order)
    named = chunks.join(docs.select(doc, F.col("lang").alias("_lang")), doc, "left")
    return named.withColumn("ordinal", (F.row_number().over(own) - 1).cast("long")).withColumn("lang", F.coalesce("lang", "_lang")).withColumn("strategy", F.lit(strategy)).drop("_lang")
