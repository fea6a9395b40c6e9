import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle
from quillspark.llm.queries import OP13_SQL, op13_merkle

from ..compare import same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, place):
    out = []
    for nodes in levels[:-1]:
        first = place // 8 * 8
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 8])))
        place //= 8
    return out


def by_hand(rows):
    """Sorted rows of the query's result, from a tree in memory."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = {g: levels_of([leaf_of(r, r.text) for r in groups[g]]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = path_of(trees[g], i) + path_of(top, n)
            digest = own = trees[g][0][i]
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
                digest = leaf_of(r, r.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
            for before, after in path:
                digest = h(before, digest, after)
            root = top[-1][0]
            out.append((str(r.doc_id), own, trees[g][-1][0], root, h(*(b + a for b, a in path)), digest, digest == root))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def third():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def test_query_equals_its_sql(spark, duck, sf):
    same(spark, duck, sf, op13_merkle, OP13_SQL)


def test_whole_table_equals_brute_force(spark, sf):
    got = result(op13_merkle(spark, sf))
    assert got == by_hand(spark.read.parquet(f"{sf}/documents.parquet").collect())
    changed = sum(not r[-1] for r in got)
    assert 0 < changed < len(got)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"a": 9, "b": 1}, {"a": 65, None: 64, "": 2, "é": 7, "z": 1}, {str(i): 1 + i % 3 for i in range(75)}])
def test_sizes_of_groups(spark, sizes):
    rows, n = [], 0
    for lang, count in sizes.items():
        for _ in range(count):
            rows.append((n, f"Text {n} É", lang, "s", n, "clash", n))
            n += 7
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string, _rank int").repartition(3)
    assert result(merkle.verify(df, tampered=third())) == by_hand(df.collect())


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "A", None, None, 1), (3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (3, "B", "en", "s", 1), (5, "", "en", "", 0), (6, "Xé" * 400_000, "en", "s", 800_000)] + [(12, "Same", "de", "s", 4)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert result(merkle.verify(df, tampered=third())) == by_hand(df.collect())
    assert merkle.verify(df.limit(0), tampered=third()).count() == 0
    assert all(r.verified for r in merkle.verify(df).collect())


def test_a_subset_of_requests_descends_alone(spark):
    rows = [(i, f"t{i}", "ab"[i % 2], "s", 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.build(df.select(F.col("doc_id").alias("_key"), merkle.group_key(F.col("lang")).alias("_group"), merkle.leaf(F.col("doc_id"), F.col("text")).alias("leaf")), ["_key"])
    whole = {r._key: r.path for r in merkle.prove(made).collect()}
    some = merkle.prove(made, made.leaves.filter("_key IN (4, 77, 299)")).collect()
    assert len(whole) == 300 and {r._key: r.path for r in some} == {k: whole[k] for k in (4, 77, 299)}


def test_equal_subtrees_are_one_record(spark):
    rows = [(1, "t", "a", "s", 1)] * 64
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.build(df.select(F.col("doc_id").alias("_key"), merkle.group_key(F.col("lang")).alias("_group"), merkle.leaf(F.col("text")).alias("leaf")), ["_key"])
    assert made.levels[0].count() == 8 and merkle._record(made.levels[0]).count() == 1
    assert merkle.prove(made).count() == 64
