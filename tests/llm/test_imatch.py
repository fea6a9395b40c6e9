import hashlib

from pyspark.sql import functions as F

from quillspark.llm import imatch
from quillspark.llm.queries import op2_imatch


def test_edited_texts_and_likeness(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(op2_imatch(spark, sf).collect())
    assert [r.doc_id for r in rows] == [d for d, _ in docs]
    for i, ((_, t), r) in enumerate(zip(docs, rows, strict=True)):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + docs[(i + 1) % len(docs)][1][:cut]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for (_, t), r in zip(docs, rows, strict=True):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert sum(r.near_edited for r in rows) > 10 * sum(r.near_next for r in rows)


def test_no_python_in_the_plan(spark, sf):
    plan = op2_imatch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def prints(spark, texts, band):
    """{key: fingerprint} of {key: text}, from Spark's term hashes and plain Python."""
    rows = spark.createDataFrame(list(texts.items()), "k string, text string").select("k", imatch.term_hashes(F.col("text")).alias("t"), F.xxhash64("text").alias("x")).collect()
    lists, where = [], {}
    for r in rows:
        kept = [h for h in r.t if h in band]
        own = [kept] + [[h for h in kept if ((h & (2**64 - 1)) >> 20) % rate == j] for rate in imatch.LEVELS for j in range(imatch.PER_LEVEL)]
        where[r.k] = (len(lists), bool(kept), r.x)
        lists += own
    hashed = [r.h for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<bigint>").select("i", F.xxhash64("x").alias("h")).orderBy("i").collect()]
    per = 1 + len(imatch.LEVELS) * imatch.PER_LEVEL
    return {k: hashed[at : at + per] if some else [x, *hashed[at + 1 : at + per]] for k, (at, some, x) in where.items()}


def alike(a, b):
    fine = []
    for k in range(len(imatch.LEVELS)):
        x, y = (fp[1 + k * imatch.PER_LEVEL : 1 + (k + 1) * imatch.PER_LEVEL] for fp in (a, b))
        if imatch.NONE in x or imatch.NONE in y:
            fine += zip(x, y, strict=True)
    none = (imatch.NONE, imatch.NONE)
    used = [p for p in fine if p != none] or [p for p in zip(a, b, strict=True) if p != none]
    return sum(x == y for x, y in used) / len(used)


def test_fingerprints_by_brute_force(spark, sf):
    """The band, every lexicon's hash of every text and edited text, and both likenesses again."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = spark.createDataFrame(list(docs.items()), "k long, text string").select(imatch.term_hashes(F.col("text")).alias("t")).collect()
    df = {}
    for r in rows:
        for h in r.t:
            df[h] = df.get(h, 0) + 1
    low = max(imatch.LEAST, len(rows) / imatch.RARE)
    band = {h for h, n in df.items() if low <= n <= max(imatch.MOST * len(rows), imatch.LEAST)}
    assert band and any(n > imatch.MOST * len(rows) for n in df.values()) and any(n < low for n in df.values())
    order = sorted(docs)
    texts = {f"own {d}": t for d, t in docs.items()}
    for i, d in enumerate(order):
        cut = len(docs[d]) // 4
        texts[f"edited {d}"] = docs[d][: len(docs[d]) - cut] + docs[order[(i + 1) % len(order)]][:cut]
    want = prints(spark, texts, band)
    got = {r.doc_id: r for r in op2_imatch(spark, sf).collect()}
    text = lambda fp: "-".join(f"{h & (2**64 - 1):x}" for h in fp)
    for i, d in enumerate(order):
        own, changed, following = want[f"own {d}"], want[f"edited {d}"], want[f"own {order[(i + 1) % len(order)]}"]
        assert got[d].fingerprint == text(own) and got[d].edited_fingerprint == text(changed)
        assert got[d].near_edited == alike(own, changed) and got[d].near_next == alike(own, following)


def test_a_band_in_a_table_gives_the_same_fingerprints(spark, sf, monkeypatch):
    want = sorted(op2_imatch(spark, sf).collect())
    whole = imatch.lexicon
    monkeypatch.setattr(imatch, "lexicon", lambda docs: whole(docs, most_terms=10))
    assert sorted(op2_imatch(spark, sf).collect()) == want
    plan = op2_imatch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_band_is_the_same_at_every_size(spark):
    """Ten times as many documents of the same shares of terms: the same band, so the same fingerprints."""
    texts = [" ".join(f"w{k}" for k in range(1, 60) if i % k == 0) for i in range(200)]
    small = spark.createDataFrame([(t,) for t in texts], "text string")
    large = spark.createDataFrame([(t,) for t in texts * 10], "text string")
    bands = [imatch.lexicon(df, rare=40) for df in (small, large)]
    a, b = (small.select(imatch.fingerprint(F.col("text"), band).alias("f")).collect() for band in bands)
    assert a == b and len({tuple(r.f) for r in a}) > 10


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, None), (2, "zz"), (2, "zz"), (9, "")], "id long, body string")
    got = imatch.with_next(df, "id", "body", n_buckets=3).orderBy("id", "text").collect()
    assert [(r.text, r.next) for r in got] == [("a b c", ""), ("", "zz"), ("zz", "zz"), ("zz", ""), ("", "a b c")]
    assert imatch.with_next(df.limit(0), "id", "body").count() == 0
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 2), (False, 2), (False, 2), (False, 9), (True, 0)]
    band = imatch.lexicon(df, "body", least=1, most=1.0)
    assert imatch.with_next(df.limit(1), "id", "body").select("id", "text", "next").collect() == [(None, "a b c", "a b c")]
    marks = df.select(imatch.fingerprint(F.col("body"), band).alias("f"), "body").collect()
    table = imatch.lexicon(df, "body", least=1, most=1.0, most_terms=0)
    order = lambda rows: sorted((r.body or "", r.f) for r in rows)
    assert order(imatch.with_fingerprint(df, "body", "f", table).collect()) == order(marks)
    assert imatch.with_fingerprint(df.limit(0), "body", "f", table).count() == 0
    assert marks[1].f == marks[4].f and marks[2].f == marks[3].f != marks[0].f
