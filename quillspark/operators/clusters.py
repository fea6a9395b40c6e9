"""Clusters of questions that say nearly the same: an exact similarity join of their words, and connected components.

Questions become sets of words. Two sets with a Jaccard similarity of at least t share a word among the first
n - ceil(t n) + 1 of each, when words are in one order everywhere; in an order of rising frequency these are the rarest,
so few sets meet. What meets is compared whole. Equal sets are one from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def words(text: Column) -> Column:
    """The distinct words and numbers of a question, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(X.WORD), F.lit(0)))


def similar_sets(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of distinct keys whose sets of strings have a Jaccard similarity of at least the threshold.

    Exact. Empty and null sets resemble none. Sets are met on one rare word at a time; a pair is checked once a shared
    word, on the words alone, and given once.
    """
    own = sets.select(F.col(key).alias("_k"), F.array_distinct(items).alias("_w")).filter("size(_w) > 0")
    each = own.select("_k", F.explode("_w").alias("_x"))
    frequency = each.groupBy("_x").agg(F.count(F.lit(1)).alias("_f"))
    ordered = each.join(frequency, "_x").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_f", "_x"))).alias("_o")).select("_k", F.col("_o._x").alias("_w"))
    n = F.size("_w")
    # the small number keeps products such as 0.7 * 10 from being rounded up
    prefix = F.slice("_w", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))
    # of the first word that two sets share they need what follows alone, and what is left bounds what they can share
    heads = ordered.select("_k", n.alias("_n"), "_w", F.posexplode(prefix).alias("_p", "_x")).select("_x", "_k", "_n", F.slice("_w", F.col("_p") + 1, n).alias("_w"))
    # both sides are one plan, so that it is shuffled once
    left, right = heads.alias("l"), heads.alias("r")
    size = lambda c: F.col(f"{c}._n")
    least = threshold * (size("l") + size("r")) - 1e-9
    near = left.join(right, F.col("l._x") == F.col("r._x")).filter("l._k < r._k").filter((size("l") >= threshold * size("r") - 1e-9) & (size("r") >= threshold * size("l") - 1e-9))
    near = near.filter((1 + threshold) * F.least(F.size("l._w"), F.size("r._w")) >= least)
    shared = F.size(F.array_intersect("l._w", "r._w"))
    return near.filter(shared >= threshold * (size("l") + size("r") - shared) - 1e-9).select(F.col("l._k").alias("a"), F.col("r._k").alias("b")).distinct()


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, root): the least node that each node of links(a, b) is connected with. Rounds are tables under path, so a
    lost executor costs one of them; their number grows with the logarithm of the longest way."""
    spark = links.sparkSession
    # written first, since both directions are read and each would make the links anew
    links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").write.mode("overwrite").parquet(f"{path}/links")
    edges = spark.read.parquet(f"{path}/links")
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")
    roots, round_no = edges.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), 0
    while True:
        # the least root among a node and its neighbours, then that root's own
        near = edges.join(roots, edges["v"] == roots["node"]).groupBy("u").agg(F.min("root").alias("_near"))
        hooked = roots.join(near, roots["node"] == near["u"], "left").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        jump = hooked.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        new = hooked.join(jump, F.col("root") == F.col("_n"), "left").select("node", "_old", F.least("root", "_up").alias("root"))
        new.write.mode("overwrite").parquet(f"{path}/round={round_no}")
        done = spark.read.parquet(f"{path}/round={round_no}")
        if not done.filter("root <> _old").limit(1).count():
            return done.select("node", "root")
        roots, round_no = done.select("node", "root"), round_no + 1


def cluster_questions(questions: DataFrame, key: str, text: str, path: str, threshold: float = 0.6) -> DataFrame:
    """(key, cluster, size): questions in clusters, named by the least key; a question like no other is one of its own.

    Clusters are the components of pairs whose word sets have a Jaccard similarity of at least the threshold. A question
    of no words (null, blank) stands alone. Rows that repeat a key must repeat its text. Tables go under path.
    """
    rows = questions.select(F.col(key).alias("_q"), words(F.col(text)).alias("_w")).withColumn("_w", F.array_sort("_w"))
    # equal sets are one, by their least key
    heads = F.min("_q").over(Window.partitionBy("_w"))
    kept = rows.withColumn("_head", F.when(F.size("_w") > 0, heads).otherwise(F.col("_q")))
    kept.write.mode("overwrite").parquet(f"{path}/questions")
    kept = questions.sparkSession.read.parquet(f"{path}/questions")
    links = similar_sets(kept.filter("_q = _head AND size(_w) > 0").dropDuplicates(["_q"]), "_q", "_w", threshold)
    roots = components(links, path)
    named = kept.join(roots, F.col("_head") == F.col("node"), "left").select("_q", F.coalesce("root", "_head").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "cluster").select(F.col("_q").alias(key), "cluster", "size")
