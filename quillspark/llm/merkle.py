"""A Merkle manifest of a table: digest-to-children records, and proofs found by descent from the root.

Every row is a leaf. Leaves of one group ascend by key and are hashed in runs of FAN until one node, the group's subroot,
is left; the subroots, ordered by group, are hashed likewise into the root. A record maps a node's digest to the digests
of its children, so that what a digest stands for is found by its content, wherever it occurs. Requests for leaves
descend from the root by the digits of their rank (base FAN); those with the same leading digits descend as one row,
which carries the unselected children of each record passed. The segments, reversed, are the proof from leaf to root.

All steps are DataFrame operations: ranks come from a range-partitioned sort and counts per partition, a level of the
tree is one aggregation of at most FAN rows a key, a level of the descent one equi-join on digests. Digests are lower-case
hexadecimal text, children their concatenation. Each level is written to the shared folder, so a lost executor costs one.

A null group is a group of its own and comes first; a null key comes first; any other column may be null, empty or very
long (a row's text is hashed where it is read and never shuffled). Rows that repeat are leaves each; between equal ones
the order doesn't show. An empty table has no root and gives no rows. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 8
HEX = 64
#: Bits of monotonically_increasing_id() that number the rows of a partition.
PLACE_BITS = 33
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value of a leaf: `-` for null, else its UTF-8 bytes behind their count."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """Text that is never null and orders like value, null first: empty for null, else behind an equals sign."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


@dataclass
class Manifest:
    """leaves: key columns, _group, _size (leaves of the group), _rank, leaf. levels, top_levels: nodes of each level,
    lowest first (_group, _size, _rank, digest, children). roots: one row (digest), none for an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top_levels: list[DataFrame]
    roots: DataFrame


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with _group) and _rank, from 0 in each group by order, and _size, the group's rows. Written.

    A range-partitioned sort places all rows; counts per partition and group, summed before each partition, number them.
    A random last key spreads rows that are equal in all of order, which may be a third of the table.
    """
    spread = rows.withColumn("_salt", F.rand(20))
    keys = ["_group", *order, "_salt"]
    # nulls come first in Spark's ascending order
    placed = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, name).withColumn("_part", F.shiftright("_id", PLACE_BITS)).withColumn("_place", F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_id")
    counts = placed.groupBy("_group", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition that a group touches
    counts = counts.select("_group", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("_group")).alias("_size"))
    return placed.join(counts, ["_group", "_part"]).withColumn("_rank", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def _grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (_group, _size, _rank, digest), lowest first, and the single node left of each group."""
    largest = nodes.agg(F.max("_size")).first()[0] or 0
    levels: list[DataFrame] = []
    tops, below, reach = [nodes.filter("_size = 1")], nodes, 1
    while reach < largest:
        runs = below.filter(F.col("_size") > reach).groupBy("_group", "_size", F.shiftright("_rank", 3).alias("_up"))
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "digest"))), lambda c: c["digest"]), "")
        level = runs.agg(children.alias("children")).select("_group", "_size", F.col("_up").alias("_rank"), F.sha2("children", 256).alias("digest"), "children")
        below = written(level, f"{name}{len(levels) + 1}")
        levels.append(below)
        reach *= FAN
        tops.append(below.filter(F.col("_size") <= reach).select(*nodes.columns))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def build(leaves: DataFrame, keys: list[str]) -> Manifest:
    """The manifest of leaves (_group, leaf, and columns of which keys give the order in a group)."""
    own = ranked(leaves, [*keys, "leaf"], "leaves")
    levels, subroots = _grown(own.select("_group", "_size", "_rank", F.col("leaf").alias("digest")), "level")
    named = ranked(subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), F.col("_size").alias("_leaves"), "digest"), ["_name"], "subroots")
    top_levels, root = _grown(named.select("_group", "_size", "_rank", "digest"), "top")
    return Manifest(own, levels, named.select(F.col("_name"), F.col("_leaves"), "_size", "_rank", "digest"), top_levels, root.select("digest"))


def _record(level: DataFrame) -> DataFrame:
    """Digest to children; equal subtrees are one record."""
    return level.select("digest", "children").distinct()


def segment(children: Column, digit: Column) -> Column:
    """The unselected children of a record: those before and those after the digit."""
    return F.struct(F.substr(children, F.lit(1), digit * HEX).alias("before"), F.substr(children, (digit + 1) * HEX + 1).alias("after"))


def _step(now: DataFrame, level: DataFrame) -> DataFrame:
    """now (_rank, digest, path and what goes along) at one level, moved to all children, their segments put in front."""
    met = now.join(_record(level), "digest")
    digits = F.sequence(F.lit(0), (F.length("children") / HEX).cast("int") - 1)
    along = [c for c in now.columns if c not in ("_rank", "digest", "path")]
    return met.select(*along, "_rank", "children", "path", F.explode(digits).alias("_digit")).select(
        *along,
        (F.col("_rank") * FAN + F.col("_digit")).alias("_rank"),
        F.substr("children", F.col("_digit") * HEX + 1, F.lit(HEX)).alias("digest"),
        F.concat(F.array(segment(F.col("children"), F.col("_digit"))), "path").alias("path"),
    )


def _asked(now: DataFrame, requests: DataFrame | None, places: int) -> DataFrame:
    """Of now those whose rank is a prefix of a request's, of which `places` digits are yet to come."""
    if requests is None:
        return now
    prefixes = requests.select("_group", F.shiftright("_rank", 3 * places).alias("_rank")).distinct()
    return now.join(prefixes, ["_group", "_rank"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The rows of manifest.leaves (or those of requests, a subset of their rows) with subroot, root and path.

    path holds, from the leaf to the root, the unselected children of each record on the way. Requests that share a
    prefix of digits are one row until they part, so a level carries as many rows as it has nodes that are asked for.
    """
    rows = manifest.leaves if requests is None else requests
    empty = F.array().cast("array<struct<before:string,after:string>>")
    now = manifest.roots.select(F.col("digest").alias("root"), F.lit(0).cast("bigint").alias("_rank"), "digest", empty.alias("path"))
    for level in reversed(manifest.top_levels):
        now = _step(now, level)
    # arrived at the subroots: each group's tree begins at its own height
    heads = now.join(manifest.subroots.select("_rank", F.col("_name").alias("_group"), F.col("_leaves").alias("_size")), "_rank")
    heads = heads.select("root", F.col("digest").alias("subroot"), "_group", "_size", F.lit(0).cast("bigint").alias("_rank"), "digest", "path")
    if requests is not None:
        heads = heads.join(requests.select("_group").distinct(), "_group", "left_semi")
    count, now = len(manifest.levels), None
    for n in range(count, 0, -1):
        here = heads.filter(F.col("_size") > FAN ** (n - 1)).filter(F.col("_size") <= FAN**n)
        now = here if now is None else now.unionByName(here)
        if n > 1:
            now = _asked(_step(now, manifest.levels[n - 1]), requests, n - 1)
    out = rows.filter("_size = 1").join(heads.filter("_size = 1").select("_group", "subroot", "root", "path"), "_group")
    if now is not None:
        last = now.join(_record(manifest.levels[0]), "digest").select("_group", F.col("_rank").alias("_up"), "subroot", "root", "children", F.col("path").alias("_path"))
        many = rows.filter("_size > 1").withColumn("_up", F.shiftright("_rank", 3)).join(last, ["_group", "_up"])
        digit = F.col("_rank").bitwiseAND(FAN - 1).cast("int")
        many = many.withColumn("path", F.concat(F.array(segment(F.col("children"), digit)), "_path")).drop("_up", "children", "_path")
        out = many.unionByName(out)
    return out


def siblings(path: Column) -> Column:
    """The digests of a path, from the leaf's run to the root's, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def tampered_text(text: Column) -> Column:
    """text with A-Z in lower case and every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def verify(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", values: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and whether it still folds to the root.

    tampered marks rows whose text is lower-cased (A-Z) after the manifest was made; without it none is. A null id is
    never tampered by a rule on ids.
    """
    changed = leaf(*[tampered_text(F.col(c)) if c == text_col else F.col(c) for c in values])
    again = F.when(F.coalesce(tampered, F.lit(False)), changed) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_key"), group_key(F.col(group_col)).alias("_group"), leaf(*map(F.col, values)).alias("leaf"), again.alias("_again"))
    proofs = prove(build(rows, ["_key"]))
    held = proofs.select(F.col("_key").alias(id_col), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("_again", "leaf"), F.col("path")).alias("folded_root"))
    return held.withColumn("verified", F.col("folded_root") == F.col("root"))
