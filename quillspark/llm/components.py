"""Connected components of a graph whose edges are rows, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge and the least node of its component.

    Each round links the larger neighbours of a node to the least one around it (large star), then the smaller ones
    (small star); a number of rounds near the logarithm of the longest path reaches a forest of stars. A round is
    aggregations, combined on the map side, and joins on node keys; it is written to the shared folder, so that a lost
    executor costs one round, and the table before it is deleted. The loop ends when every edge leads to a root, each node
    has one, and no root has one: only then, whatever the number of rounds. Loops of a node to itself are no edges, null
    edges count not at all, repeated ones once; an empty table gives no rows.
    """
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = written(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not (now.join(now.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty()):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.join(large.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")
        small = down.select("u", F.col("m").alias("v")).union(down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        then, now = now, written(small, "edges")
        dropped(then)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
