import random

from pyspark.sql import functions as F

from quillspark.operators import clusters as K


def test_components_make_links_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(a: int) -> int:
        made.add(1)
        return a

    rows = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    links = rows.select(F.udf(seen, "long").asNondeterministic()("a").alias("a"), "b")
    got = {r.node: r.root for r in K.components(links, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert made.value == 3


def test_similar_sets_misses_none(spark):
    random.seed(2)
    sets = {i: random.sample("abcdefghijkl", random.randrange(0, 9)) for i in range(120)}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) >= 0.6 * len({*sets[a]} | {*sets[b]}) - 1e-9}
    got = [(r.a, r.b) for r in K.similar_sets(spark.createDataFrame(list(sets.items()), "k long, w array<string>"), "k", "w", 0.6).collect()]
    assert near and len(got) == len(near) and {*got} == near
