"""Chunks with what their source blocks say: pages, heading path, section, language and type, joined by character spans.

A span of text meets the blocks that it overlaps. Both are cut over cells of a fixed number of characters and joined on
(document, cell); a pair that shares several cells is counted in the one where the later of the two begins. So the join is
on equal keys, a long document is spread over its cells, and no span meets blocks that are far from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from . import chunking

CELL = 4096
# Types of block that are no running text.
STRUCTURED = ("table", "code")
#: What a block may say, besides its place; a column that blocks lack is null.
FACTS = {"block_type": "string", "page": "bigint", "heading_path": "array<string>", "language": "string", "confidence": "double"}


def _in_cells(first: Column, end: Column, cell: int) -> Column:
    return F.explode(F.sequence(F.floor(first / cell), F.floor(F.greatest(end - 1, first) / cell)))


def overlaps(spans: DataFrame, blocks: DataFrame, doc: str, cell: int = CELL) -> DataFrame:
    """(doc, ordinal, block_no, _from, and the FACTS): every block that a span shares a character with.

    spans(doc, ordinal, start, end), blocks(doc, block_no, start, end). Empty spans and blocks overlap nothing; a null
    document, start or end meets nothing.
    """
    facts = [F.col(c).cast(k).alias(c) if c in blocks.columns else F.lit(None).cast(k).alias(c) for c, k in FACTS.items()]
    a = spans.filter("start < end").select(doc, "ordinal", F.col("start").alias("_s0"), F.col("end").alias("_s1")).select("*", _in_cells(F.col("_s0"), F.col("_s1"), cell).alias("_cell"))
    b = blocks.filter("start < end").select(doc, "block_no", F.col("start").alias("_b0"), F.col("end").alias("_b1"), *facts).select("*", _in_cells(F.col("_b0"), F.col("_b1"), cell).alias("_cell"))
    met = a.join(b, [doc, "_cell"]).filter("_b0 < _s1 AND _s0 < _b1").filter(F.col("_cell") == F.floor(F.greatest("_s0", "_b0") / cell))
    return met.select(doc, "ordinal", "block_no", F.col("_b0").alias("_from"), *FACTS)


def assemble(spans: DataFrame, blocks: DataFrame, doc: str, ocr: bool = True, cell: int = CELL) -> DataFrame:
    """spans with page_from, page_to, heading_path, section, language, block_type and blocks (how many it overlaps).

    The path is the first that isn't empty, in order of the blocks, the section its last part, the language the first
    that is known; the type is that of the first structured block, else `ocr` if all blocks were recognised with a
    confidence, else that of the first block. A span without blocks has nulls and an empty path.
    """
    met = overlaps(spans, blocks, doc, cell)
    order = F.struct("_from", "block_no")
    structured = F.col("block_type").isin(*STRUCTURED)
    first = lambda value, known: F.min_by(F.when(known, value), F.when(known, order))
    facts = met.groupBy(doc, "ordinal").agg(
        F.min("page").alias("page_from"),
        F.max("page").alias("page_to"),
        first(F.col("heading_path"), F.coalesce(F.size("heading_path") > 0, F.lit(False))).alias("_path"),
        first(F.col("language"), F.coalesce(F.col("language") != "", F.lit(False))).alias("language"),
        first(F.col("block_type"), F.coalesce(structured, F.lit(False))).alias("_structured"),
        first(F.col("block_type"), F.col("block_type").isNotNull()).alias("_type"),
        F.min(F.col("confidence").isNotNull()).alias("_seen"),
        F.count(F.lit(1)).alias("blocks"),
    )
    path = F.coalesce("_path", F.array().cast("array<string>"))
    kind = F.coalesce("_structured", F.when(F.col("_seen"), F.lit("ocr")) if ocr else F.lit(None).cast("string"), "_type")
    out = spans.join(facts, [doc, "ordinal"], "left").withColumns({"heading_path": path, "block_type": kind, "blocks": F.coalesce("blocks", F.lit(0)).cast("long")})
    return out.withColumn("section", F.try_element_at("heading_path", F.lit(-1))).drop("_path", "_structured", "_type", "_seen")


def recursive_chunks(docs: DataFrame, key: str, text: str, config: chunking.Config = chunking.Config(), blocks: DataFrame | None = None) -> DataFrame:
    """(key, ordinal, content, start, end, tokens and the facts of assemble()): sentences packed into chunks, with a break
    wanted before every heading. Without blocks(key, block_no, block_type, start, end) those of plain text are taken."""
    if blocks is None:
        found = readers.text_to_blocks(docs, key, text)
        blocks = found.withColumn("end", F.col("start") + F.length("text")).drop("text")
    heads = blocks.filter("block_type = 'heading'").groupBy(key).agg(F.array_sort(F.collect_list(F.col("start").cast("long"))).alias("_heads"))
    chunks = chunking.chunk(docs.select(key, text).join(heads, key, "left"), key, text, config, breaks="_heads")
    return assemble(chunks, blocks, key)
