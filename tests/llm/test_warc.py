import gzip
import hashlib

import pytest

from quillspark.llm import warc
from quillspark.llm.queries import OP5_SQL, op5_warc

from ..compare import same


def test_query_equals_its_sql(spark, duck, sf):
    same(spark, duck, sf, op5_warc, OP5_SQL)


@pytest.fixture(scope="module")
def pages(spark):
    big, copy = "é" * 300_000, "c" * 1500
    rows = [(1, "http://a/\r\nX", copy, 0), (9, None, copy, 0), (4, "http://b", copy, 0), (2, "u", None, 0), (3, "u", "", 0), (5, "u", big, 0), (6, "u", "small", 0), (7, "u", "small", 0), (None, "u", copy, 0), (8, "u", "x\r\n\r\nWARC/1.1\r\n" * 9, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, n_bytes int")


def test_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 1000)
    manifest = warc.write_archives(warc.record_table(pages, chunk=50_000), size=1000)
    rows = warc.read_archives(manifest).collect()
    whole = {}
    for r in sorted((r for r in rows), key=lambda r: r.chunk_no):
        whole.setdefault(r.page_id, []).append(r)
    for p in pages.collect():
        got, raw = whole[p.page_id], (p.html or "").encode()
        last = got[-1]
        assert last.last and last.payload_bytes == len(raw) and last.payload_digest == hashlib.sha1(raw).hexdigest()
        if last.record_type == "response":
            assert b"".join(bytes(g.data) for g in got) == raw and last.refers_to is None
        else:
            assert last.refers_to == 9 and p.page_id in (1, 4, None)
    assert {k for k, v in whole.items() if v[-1].record_type == "revisit"} == {1, 4, None}
    assert len(whole[5]) > 1


def test_archives_are_plain_warc(spark, pages):
    manifest = warc.write_archives(warc.record_table(pages).coalesce(1)).collect()
    data = gzip.decompress(open(manifest[0].archive.removeprefix("file://"), "rb").read())
    heads = data.split(b"WARC/1.1\r\nWARC-Type: ")
    assert len(heads) - 1 == pages.count() and manifest[0].n_records == pages.count()
    assert b"WARC-Target-URI: http://a/%0D%0AX\r\n" in data


def test_rows_that_repeat(spark):
    long = "z" * 2000
    rows = [(5, "b", long), (5, "a", long), (5, "a", long), (2, "c", long), (None, "d", "w" * 2000), (None, "d", "w" * 2000), (5, "a", "short"), (5, "a", "short")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, chunk_no int")
    got = warc.read_archives(warc.write_archives(warc.record_table(df)), payloads=False).filter("last").collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [(0, 2000, "response", 0)] * 2 + [(2, 2000, "revisit", 5)] + [(5, 5, "response", 0)] * 2 + [(5, 2000, "response", 0)] + [(5, 2000, "revisit", 5)] * 2


def test_empty_table(spark, pages):
    assert warc.read_archives(warc.write_archives(warc.record_table(pages.limit(0)))).count() == 0
