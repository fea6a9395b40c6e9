"""Mixing sources to target weights: sizes per source, repetition rates, whole copies plus one hash-seeded draw.

Everything is DataFrame functions; no Python runs on executors. The only rows brought together are one per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_RATE = 3.0


def n_words(text: Column) -> Column:
    """Words of a text: maximal runs of bytes other than white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """Targets of (source, source_size): shares by weight of the sum of all sizes, none above max_rate times its size.

    Sources in order of code points, null last, take the weights in turn. Sharing the excess again and again by
    weight ends where every target is min(cap, weight x level); the level is found in one pass over the sources
    sorted by cap / weight. A source of size 0 gets 0; with no words at all every target is 0.
    """
    named = F.when(F.col("source").isNull(), 1).otherwise(0)
    order = Window.orderBy(named, F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    caps = sizes.select("source", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(float(max_rate))).alias("_cap"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), named, F.col("source").cast("binary"))
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    levels = caps.withColumn("_level", level).withColumn("_tight", F.col("_cap") > F.col("_w") * F.col("_level"))
    # the first source that its cap doesn't bind sets the level for all from there on
    fixed = F.first(F.when(F.col("_tight"), F.col("_level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return levels.select("source", "source_size", F.when(fixed.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * fixed)).alias("target"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_rate: float, seed: int) -> DataFrame:
    """The columns of docs and _mix_size, _mix_source_size, _mix_target, _mix_rate, _mix_copies."""
    slim = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate)
    targets = targets.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    both = docs.withColumn("_mix_size", n_words(F.col(text_col))).join(targets, F.col(source_col).eqNullSafe(F.col("_mix_source")), "inner").withColumn("_mix_rate", rate)
    extra = F.when(unit_draw(F.col(id_col), seed) < F.col("_mix_rate") - F.floor("_mix_rate"), 1).otherwise(0)
    return both.withColumn("_mix_copies", (F.floor("_mix_rate") + extra).cast("int")).drop("_mix_source")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = 17) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, copies.

    copies = floor(rate) + 1 if the document's own draw is below rate's fraction. Null and empty texts have size 0 and
    are copied like others of their source; a null source is a source; equal rows get equal copies; an empty table
    gives no rows. Sizes are summed on the map side, so a hot source is one row per task in the shuffle.
    """
    own = ("size", "source_size", "target", "rate", "copies")
    return _planned(docs, id_col, text_col, source_col, weights, max_rate, seed).select(id_col, *[F.col(f"_mix_{c}").alias(c) for c in own])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = 17) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as its plan says (rows with 0 copies go)."""
    plan = _planned(docs, id_col, text_col, source_col, weights, max_rate, seed)
    return plan.filter("_mix_copies > 0").select(*docs.columns, F.explode(F.expr("sequence(1, _mix_copies)")).alias("_mix_copy")).select(*docs.columns)
