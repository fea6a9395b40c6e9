import random
import re

import pytest

from quillspark.llm import minhash_dedup as M
from quillspark.llm.components import components


def near(a, b):
    def shingles(t):
        w = re.findall(r"[a-z0-9]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    out = [" ".join(rng.choices(words, k=300)) for _ in range(40)]
    for i in range(60):  # a large group with an edit each, and smaller ones
        w = out[0 if i < 40 else i - 35].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    return out


def test_links_and_classes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in M.classes(df).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        for j in range(i):
            s = near(texts[i], texts[j])
            if s >= 0.85:
                assert got[i] == got[j]
    assert all(got[i] == i for i in range(40))  # originals don't resemble each other


def test_odd_rows(spark, texts):
    rows = [(5, "same words here"), (3, "Same, words HERE!"), (7, None), (8, ""), (9, "..."), (None, texts[0]), (2, texts[0]), (2, texts[0]), (4, texts[0] + " x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id) for r in M.classes(df).collect()), key=str)
    assert len(got) == len(rows)
    by = dict(got)
    assert by[5] == by[3] == 3 and by[7] == by[8] == 7 and by[9] == 9
    assert by[2] is by[4] is by[None] is None
    kept = M.one_of_each(df).collect()
    assert sorted((r.doc_id, r.text, r.class_id) for r in kept if r.doc_id is not None) == [(3, "Same, words HERE!", 0), (7, None, 0), (9, "...", 0)] and sum(r.doc_id is None for r in kept) == 1
    assert M.one_of_each(df.limit(0)).count() == 0
    assert M.classes(df.limit(0)).count() == 0


def bags_of(texts, idf):
    """{shingle: weight} of each text, from the operator's own shingles."""
    import numpy as np

    data = np.frombuffer("".join(texts).lower().encode(), np.uint8)
    of, h, weight = M.shingles(*M.word_hashes(data, np.cumsum([0, *[len(t.lower().encode()) for t in texts]])), idf)
    out = [{} for _ in texts]
    for i, k, w in zip(of.tolist(), h.tolist(), weight.tolist(), strict=True):
        out[i][k] = w
    return out


def test_weights_are_tf_idf(spark):
    import math

    texts = ["the cat sat on the mat", "the dog sat on the mat the dog sat on the mat", "the", "a cat"]
    idf = M.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    value = lambda w: 1 + math.log((1 + len(texts)) / (1 + df[w]))
    for text, bag in zip(texts, bags_of(texts, idf), strict=True):
        want = {}
        w = text.split()
        for i in range(max(1, len(w) - 4)):
            own = tuple(w[i : i + 5])
            want[own] = want.get(own, 0) + sum(map(value, own)) / len(own)
        assert sorted(bag.values()) == pytest.approx(sorted(want.values()), abs=1e-3)


def test_recall_of_all_near_pairs(spark):
    """Against all pairs of the whole table: no near pair is parted, and classes hold nothing but linked documents."""
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in M.classes(df).collect()}
    bags = bags_of([t for _, t in rows], M.frequencies(df.select("text")))
    total = [sum(b.values()) for b in bags]
    posted, shared = {}, {}
    for i, bag in enumerate(bags):
        for h, w in bag.items():
            for j, v in posted.setdefault(h, []):
                shared[j, i] = shared.get((j, i), 0.0) + min(v, w)
            posted[h].append((i, w))
    near = [p for p, x in shared.items() if x >= 0.8 * (total[p[0]] + total[p[1]] - x)]
    assert len(near) > 50
    met = [got[rows[i][0]] == got[rows[j][0]] for i, j in near]
    assert sum(met) / len(met) >= 0.99
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    for i, (d, text) in enumerate(rows):
        if bags[i]:
            assert got[d] >= rows[find(i)][0]


def test_ids_that_repeat(spark, texts):
    a, b = texts[1], texts[2]
    rows = [(3, a), (5, a + " more"), (5, b), (9, b + " words"), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in M.classes(df).collect()) == [(3, 3), (5, 3), (5, 5), (5, 5), (9, 5)]
    assert sorted(tuple(r) for r in M.one_of_each(df).collect()) == [(3, a), (5, b)]


def test_sampling_estimates_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    agree, of = [], np.repeat([0, 1], 800)
    for _ in range(60):
        h = rng.integers(0, 1 << 48, 900, dtype=np.uint64)
        w = rng.uniform(1, 3, 900).astype(np.float32)
        own, other = (h[:800], w[:800]), (h[100:], w[100:])
        _, drawn = M.samples(of, np.concatenate([own[0], other[0]]), np.concatenate([own[1], other[1]]))
        agree.append((drawn[0] == drawn[1]).mean())
    assert abs(np.mean(agree) - 700 / 900) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[101] == got[102] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_pairs_in_hot_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(5000)]
    passage = rng.choices(words, k=150)
    rows = []
    for i in range(40):  # the passage in all; an own part in two, and a few words apart
        own = rng.choices(words, k=50)
        for j in (i, 1000 - i):
            w = passage + own
            for at in rng.sample(range(len(w)), 2):
                w[at] = f"edit{j}x{at}"
            rows.append((j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    idf = M.frequencies(df.select("text"))
    bags = bags_of([t for _, t in rows], idf)
    # every sample falls on the passage: all texts share the bucket of every band
    drawn = M.signatures
    monkeypatch.setattr(M, "signatures", lambda *args: drawn(*args).withColumn("bands", F.array(*[F.lit(k).cast("long") for k in range(M.BANDS)])))
    got = {r.doc_id: r.class_id for r in M.classes(df).collect()}
    near = []
    for i, x in enumerate(bags):
        for j in range(i):
            shared = sum(min(w, bags[j][k]) for k, w in x.items() if k in bags[j])
            if shared >= 0.8 * (sum(x.values()) + sum(bags[j].values()) - shared):
                near.append((rows[i][0], rows[j][0]))
    assert len(near) > 20
    assert [p for p in near if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) == len(rows) - len(near)  # and no others
