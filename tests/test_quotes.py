import random
import re

import pytest

from quillspark.operators import evidence as E
from quillspark.operators import quotes as Q
from quillspark.plans.structure import QUERIES


def sellers(quote, text):
    """The fewest edits between a quote and any stretch of text, by the whole table."""
    row = list(range(len(quote) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, q in enumerate(quote, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (q != c)))
        row, best = new, min(best, new[-1])
    return best


def plain(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i : i + (kind > 0)] = [rng.choice("abcdé ")] if kind < 2 else []
    return "".join(out)


def expected(quotes, sources):
    out = set()
    for qid, q in quotes:
        for sid, t in sources:
            if q is not None and t is not None and (p := plain(q)) and (d := sellers(p, plain(t))) <= len(p) * 15 // 100:
                out.add((qid, sid, d, round(1 - d / len(p), 6)))
    return out


def test_distance_equals_the_whole_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 70))) for _ in "ab")
        assert Q.distance_in(a, b) == sellers(a, b)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é", "xyz\U0001f600 "])
def test_fuzzy_quotes_equal_brute_force(spark, letters):
    rng = random.Random(len(letters))
    sources = [(i, "".join(rng.choices(letters, k=rng.choice([0, 5, 40, 300, 500])))) for i in range(14)] + [(99, None)]
    quotes = [(0, None), (1, ""), (2, "  "), (3, "zz zz zz zz not there")]
    for n in range(4, 34):
        text = rng.choice([t for _, t in sources if t and len(t) > 30])
        a, m = rng.randrange(len(text) - 20), rng.choice([1, 3, 6, 7, 13, 14, 20, 27, 60, 130])
        piece = text[a : a + m]
        quotes.append((n, edited(rng, piece, rng.randint(0, max(1, len(piece) // 6))).upper() or "a"))
    got = Q.fuzzy_quotes(spark.createDataFrame(quotes, "q int, quote string"), "q", "quote", spark.createDataFrame(sources, "s int, text string"), "s", "text")
    assert {(r.q, r.s, r.edits, r.likeness) for r in got.collect()} == expected(quotes, sources)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(0, None, "x"), (1, "x", None), (2, "", "x"), (3, "x", "")]
    for n in range(4, 60):
        text = "".join(rng.choices("abcdefgh é", k=rng.choice([30, 300, 700])))
        a, m = rng.randrange(len(text) - 20), rng.choice([1, 6, 7, 14, 27, 60, 130])
        piece = text[a : a + m]
        rows.append((n, edited(rng, piece, rng.randint(0, max(1, len(piece) // 5))) or "a", text))
    got = {r.n: (r.edits, r.likeness) for r in Q.fuzzy_pairs(spark.createDataFrame(rows, "n int, q string, t string"), "q", "t", ["n"]).collect()}
    want = {}
    for n, q, t in rows:
        if q is not None and t is not None and (p := plain(q)) and (d := sellers(p, plain(t))) <= len(p) * 15 // 100:
            want[n] = (d, round(1 - d / len(p), 6))
    assert got == want and 10 < len(want) < 50


def test_passages_of_the_tables(spark, sf):
    """The query's edits are those of the whole table's distance, for every pair."""
    got = {(r.query_id, r.chunk_id): r.edits for r in QUERIES["evl4_fuzzy"](spark, sf).collect()}
    items = {r.item_id: plain(re.sub(r"(?s)(.{11}).", r"\1", r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: plain(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i, q in items.items():
        for d, t in docs.items():
            if d % 40 == i % 40:
                edits = Q.distance_in(q, t)
                assert got.get((i, d)) == (edits if edits <= len(q) * 15 // 100 else None)


def test_citations_with_nearly_right_quotes(spark):
    cited = spark.createDataFrame([(1, 1, "the staff must complete step four"), (1, 2, "the staff must complete step four"), (1, 1, "teh staff must complet step four"), (1, 1, "something else was said here"), (1, 7, "the staff"), (1, 1, None)], "query_id int, marker int, quote string")
    offered = spark.createDataFrame([(1, 1, 10, "All of the staff must\ncomplete STEP four by noon."), (1, 2, 11, "nothing")], "query_id int, rank int, chunk_id int, content string")
    wanted = offered.select("query_id", "chunk_id")
    exact = sorted((r.marker, r.quoted) for r in E.citation_correctness(cited, offered, wanted).collect())
    near = sorted((r.marker, r.quoted) for r in E.citation_correctness(cited, offered, wanted, fuzzy=True).collect())
    assert sum(q for _, q in exact) == 1 and sum(q for _, q in near) == 2 and len(near) == len(exact) == 6


def test_fewest_edits_compares_few_texts_whole(monkeypatch):
    random.seed(5)
    word = lambda: "".join(random.choice(("ka", "lo", "mi", "ru")) for _ in range(3))
    quote, text = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(2000))
    # seeds are everywhere, but what is said is not: hardly a seed leads to the whole quote
    walked, plain_walk = [], Q._distance
    monkeypatch.setattr(Q, "_distance", lambda m, masks, t: walked.append(m) or plain_walk(m, masks, t))
    assert Q.fewest_edits(quote, text) is None
    assert walked and max(walked) < len(quote)
    assert Q.fewest_edits(quote, text + quote[:50] + "x" + quote[50:] + text) == 1
