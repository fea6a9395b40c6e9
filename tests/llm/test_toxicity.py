import random
import zlib

import numpy as np
import pyarrow as pa

from quillspark.llm import toxicity
from quillspark.llm.queries import op12_toxicity

LETTERS = "abcdefghijklmnop"


def corpus(rng, n, bad, length=60, each=2):
    """n texts of invented words, of which every third has words of `bad`."""
    out = []
    for i in range(n):
        words = ["".join(rng.choices(LETTERS, k=rng.randint(2, 8))) for _ in range(length)]
        if i % 3 == 0:
            for _ in range(each):
                words[rng.randrange(length)] = rng.choice(bad)
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def frames(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_query_over_the_whole_table(spark, sf):
    rows = op12_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in op12_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = ([(s, p) for s, p, y in held if y == k] for k in (1, 0))
    area = np.mean([[a > b for b, _ in clean] for a, _ in toxic])
    # a third of these texts are toxic by words that fewer than 25 labelled texts of their language show
    assert len(toxic) > 50 and area >= 0.94
    assert np.mean([p for _, p in toxic]) >= 0.75 and np.mean([p for _, p in clean]) <= 0.02


def test_unseen_misspellings_share_subwords(spark):
    rng = random.Random(1)
    rows = corpus(rng, 400, ["zurtwix", "quyzzer", "wrexyz"])
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels)
    clean = " ".join("".join(rng.choices(LETTERS, k=5)) for _ in range(40))
    asked = [(1, clean), (2, clean + " zurtwixes"), (3, clean + " zzurtwix"), (4, "QUYZZERS " + clean), (5, clean + ". Wrexyz!"), (6, clean * 50 + " zurtwix " + clean * 50)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[1] < 0.01 and got[2] > 10 * got[1] and all(got[i] >= 0.3 for i in (3, 4, 5, 6)), got


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    table = rng.normal(size=toxicity.BUCKETS)
    hashed = {}

    def bucket(gram):
        if gram not in hashed:
            h = 0
            for c in gram:
                h = (h * int(toxicity._BASE) + c + 1) % 2**64
            h = (h + len(gram)) % 2**64
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % 2**64
            hashed[gram] = (h ^ (h >> 31)) % toxicity.BUCKETS
        return table[hashed[gram]]

    def by_hand(text):
        spaced = bytes(c if toxicity._INSIDE[c] else 32 for c in text.lower().encode())
        words = [b" " + w + b" " for w in spaced.split()]
        if not words:
            return 0.25
        scores = []
        for w in words:
            values = [bucket(w[i : i + n]) for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)]
            scores.append(sum(values) / len(values))
        parts = max(1, len(words) // toxicity.PASSAGE)
        cuts = [i * len(words) // parts for i in range(parts + 1)]
        return max(sum(scores[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)) + 0.25

    texts = ["", "a", "  \n", "Ünïcode IS here", "one two three four five six seven eight nine ten", "x" * 3000, "!!?? ..", "é", "l@st w*rds, d'accord 4ever", " ".join("w" + str(i) for i in range(2000))]
    for block in (64, toxicity.BLOCK):
        old, toxicity.BLOCK = toxicity.BLOCK, block
        try:
            got = toxicity.worst(pa.array(texts), table, 0.25)
        finally:
            toxicity.BLOCK = old
        assert np.allclose(got, [by_hand(t) for t in texts])


def test_gradient_step_lowers_the_loss():
    trainer = toxicity.Trainer(["bad word here", "good thing there", "", "\n"], np.array([1, 0, 1, 0]))
    assert trainer.size.tolist() == [3, 3]
    before = trainer.scores()
    for _ in range(20):
        trainer.step(np.array([0, 1]), np.array([1, 0]), 0.1)
    after = trainer.scores()
    assert after[0] > before[0] and after[1] < before[1]


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = corpus(rng, 60, ["zurtwix"])
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 5.0, "k"), (1, "", 5.0, "k"), (None, "x" * 3_000_000, 5.0, "k"), (3, "zurtwix", None, None), (3, "zurtwix", None, None), (4, "\x00\x1f…", 1.0, "k")], "doc_id long, text string, score double, _own_0 string")
    out = toxicity.score(odd, model)
    assert out.columns == ["doc_id", "text", "_own_0", "score"]
    got = out.collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 1")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit(docs.unionByName(docs), labels.unionByName(labels)).bias == model.bias
