import hashlib
import random

import pytest

from quillspark.llm import suffix_dedup as S


def brute(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[d] = (len(b), sum(mark), sum(1 for i in range(len(b)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r[0]: (r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in S.strip_repeats(df).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choices("ab", k=rng.choice([5, 60, 100, 130, 300]))) for _ in range(12)]
    return [(i, "".join(rng.choices(base, k=rng.randint(0, 8)))) for i in range(200)] + [(1000, "a" * 1000), (1001, "a" * 1500), (1002, None), (1003, "xy" * 300), (1004, "é" * 200), (1005, "")]


def test_equals_brute_force(spark, rows):
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_hot_anchors_and_cut_blocks(spark, rows, monkeypatch):
    for name, value in (("CHUNK_SLICES", 3), ("BLOCK", 700), ("COLLAPSED", 300), ("CHUNK", 2000)):
        monkeypatch.setattr(S, name, value)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])


def ragged(n, seed=11):
    """One passage in every row, with surroundings that differ and a few that agree for some bytes."""
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    near = ["".join(rng.choices("ab", k=k)) for k in (1, 3, 20, 60, 90)]
    out = []
    for i in range(n):
        cut = rng.choice([0, 0, 0, 1, 2, 5, 30])
        out.append((i, "".join(rng.choices("abcdefgh ", k=120)) + rng.choice(near) + passage[cut : 400 - rng.choice([0, 0, 1, 7])] + rng.choice(near) + "".join(rng.choices("abcdefgh ", k=120))))
    return out


def test_a_hot_passage_with_ragged_ends(spark, monkeypatch):
    rows = ragged(500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(df) == brute(rows)
    monkeypatch.setattr(S, "CHUNK_SLICES", 40)
    assert got(df) == brute(rows)


def test_rows_stay_in_proportion(spark):
    per_slice = []
    for n in (200, 800):
        df = spark.createDataFrame(ragged(n), "doc_id long, text string").repartition(4)
        edges = S.edge_slices(df, S.marks(df))
        per_slice.append(edges.mapInArrow(S.repeat_rows(100), "d long, pos long, spans array<struct<start:int,size:int>>, firsts array<int>, slice binary").count() / edges.count())
    assert max(per_slice) <= 1


def test_groups_are_all_maximal_repeats(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("ab", k=k)) for k in (30, 45, 60, 25)]
    rows = [(i, "".join(rng.choices(base, k=4)) + str(i)) for i in range(40)]
    text = dict(rows)
    found = {}
    for r in S.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), length=40).collect():
        found.setdefault((r.ah, r.part), {})[r["rank"]] = r
    seen = {}
    for ranks in found.values():
        for r in ranks.values():
            for size, last in r.repeats:
                members = [ranks[k] for k in range(r["rank"], last + 1)]
                strings = {text[m.d][m.at : m.at + size] for m in members}
                assert len(strings) == 1 and len(members) > 1
                seen.setdefault(strings.pop(), set()).update((m.d, m.at) for m in members)
    assert seen
    for string, places in seen.items():  # a group lists every occurrence but those in slices that are whole copies
        every = {(d, k) for d, t in rows for k in range(len(t) - len(string) + 1) if t.startswith(string, k)}
        assert places <= every and len({t for t in places}) >= 2


def test_maximal_repeats_cover_every_repeat():
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        base = ["".join(rng.choices("ab", k=rng.choice([5, 20, 30]))) for _ in range(4)]
        slices = ["".join(rng.choices(base, k=rng.randint(1, 6))).encode()[:168] for _ in range(rng.randint(2, 12))]
        places, found = {}, set()
        for i, s in enumerate(slices):
            for k in range(len(s) - 19):
                places.setdefault(s[k : k + 20], []).append((i, k))
        which, start, intervals = S.prefix_intervals(slices, 20)
        for size, a, b in intervals.tolist():
            occurrences = sorted(zip(which[a:b].tolist(), start[a:b].tolist(), strict=True))
            string = {slices[i][k : k + size] for i, k in occurrences}
            assert len(string) == 1
            string = string.pop()
            assert occurrences == [(i, k) for i, s in enumerate(slices) for k in range(len(s) - size + 1) if s.startswith(string, k)]
            found |= {(i, x) for i, k in occurrences[1:] for x in range(k, k + size - 19)}
        again = {p for v in places.values() for p in v[1:]}
        assert found == again
        when = np.empty(which.size, np.int64)
        when[np.lexsort((start, which))] = np.arange(which.size)
        size = S.repeated_ahead(when, intervals)
        assert {(i, x) for i, k, n in zip(which.tolist(), start.tolist(), size.tolist(), strict=True) if n for x in range(k, k + n - 19)} == again


def test_whole_characters(spark):
    rows = [(0, "é€𝄞\ufffd" * 40 + "abc"), (1, "x" + "é€𝄞\ufffd" * 40 + "\ufffdend"), (2, "y" * 7 + ("é€𝄞\ufffd" * 40)[2:] + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, whole = ({r.doc_id: r for r in S.strip_repeats(df, whole=w).collect()} for w in (False, True))
    for i, text in rows:
        kept = bytes(whole[i]._kept).decode()  # strict
        assert bytes(whole[i]._kept) == bytes(plain[i]._kept).decode("utf-8", "ignore").encode()
        assert (whole[i]._n_bytes, whole[i]._n_removed, whole[i]._n_spans) == (plain[i]._n_bytes, plain[i]._n_removed, plain[i]._n_spans)
        assert ("\ufffdend" in kept) == (i == 1) and (i or kept.startswith("é€𝄞\ufffd"))


def test_odd_rows(spark):
    long = "the quick brown fox jumps over the lazy dog " * 5
    rows = [(None, long, 1), (1, long, 2), (1, long, 2), (1, "other " + long, 3), (2, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int")
    out = S.strip_repeats(df)
    assert out.columns == ["doc_id", "d", "_n_bytes", "_n_removed", "_n_spans", "_kept"]
    result = sorted((r.d, r._n_bytes, r._n_removed) for r in out.collect())
    assert [x[0] for x in result] == [1, 2, 2, 3, 4]
    assert result[1] == result[2] and result[1][1] == result[1][2]
    assert S.strip_repeats(df.limit(0)).count() == 0
