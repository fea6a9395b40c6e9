import random
import zlib

from quillspark.llm import quality
from quillspark.llm.queries import op8_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            total += 1
            right += r.predicted == labels[r.doc_id]
    assert right / total >= 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, "", "good text of words", "BAD!! BAD!! BAD!!", "x" * 200_000] * 3)] + [(1, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 5 != 3, 0) for i in range(15)], "doc_id long, quality boolean, toxic int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert quality.fit(docs, labels.filter("quality")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {1.0}
    model = quality.fit(docs, labels)
    assert quality.score(docs.limit(0), model).count() == 0


def test_labelled_texts_count_to_their_ends(spark):
    rng = random.Random(5)
    kinds = [["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(400)] for letters in ("abcdefgh", "qrstuvwx")]
    part = lambda kind, n: " ".join(rng.choices(kinds[kind], k=n // 6))
    # both kinds begin alike; what makes a text bad stands behind 36,000 characters
    rows = [(i, part(0, 80_000) if i % 2 else part(0, 36_000) + part(1, 50_000), i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    got = quality.score(docs, quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))).collect()
    assert all((r.score > 0.5) == r.quality for r in got)


def test_features_keep_their_level_in_long_texts():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(400)]
    text = " ".join(rng.choices(words, k=250_000)).encode()
    scorer = quality.Scorer(text[:50_000], b"x")
    short = [scorer.features(text[i : i + 8 * quality.PIECE]) for i in range(100_000, 900_000, 40_000)]
    long = scorer.features(text[100_000:])
    for i in (2, 4):
        values = [f[i] for f in short]
        assert min(values) < long[i] < max(values)
