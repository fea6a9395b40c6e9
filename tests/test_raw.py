import io
import zipfile

from pyspark.sql import functions as F

from quillspark.sources import raw as R


def office(folder):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(f"{folder}/document.xml", "<x/>" * 500)
    return out.getvalue()


CASES = {
    # name: (bytes, declared, mime, supported, mismatch)
    "a.pdf": (b"%PDF-1.7 ...", "application/pdf", R.PDF, True, False),
    "a.txt": (b"%PDF-1.4", "text/plain; charset=utf-8", R.PDF, True, True),
    "b.docx": (office("word"), None, R.DOCX, True, False),
    "b.xlsx": (office("xl"), R.XLSX.upper(), R.XLSX, True, False),
    "b.zip": (office("photos"), "application/octet-stream", R.ZIP, False, False),
    "broken.zip": (b"PK\x03\x04 and no directory", None, R.ZIP, False, False),
    "old.xls": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 40, None, R.XLS, False, False),
    "old": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 40, None, R.DOC, False, False),
    "r.doc": (b"{\\rtf1 x}", None, R.RTF, False, False),
    "p.md": (b"\x89PNG\r\n\x1a\n....", None, "image/png", False, False),
    "n.bin": (b"abc\0def", None, R.UNKNOWN, False, False),
    "w.html": ("  <!DOCTYPE html><p>x".encode("utf-16"), None, R.HTML, True, False),
    "page.txt": (b"text then <BODY> in it", "text/plain", R.HTML, True, True),
    "o.json": (b' {"a": 1}', None, R.JSON, True, False),
    "o.txt": (b'{"a": 1}', None, R.TXT, True, False),
    "t.csv": (b'name,"a, b"\nx,"two\nlines"\ny,z\n', None, R.CSV, True, False),
    "prose.csv": (b"First, a sentence.\nThen, another one.\n", None, R.TXT, True, False),
    "t.tsv": (b"a\tb\n1\t2\n", None, R.TSV, True, False),
    "rows.dat": (b"id,size\n1,2\n3,4\n", None, R.CSV, True, False),
    "notes.txt": (b"# Title\n\n- one\n- two\n", None, R.MARKDOWN, True, False),
    "one.txt": (b"# Title\nand prose\n", None, R.TXT, True, False),
    "x.markdown": (b"prose only", None, R.MARKDOWN, True, False),
    "latin.txt": ("un caf\xe9, d\xe9j\xe0 vu".encode("cp1252"), None, R.TXT, True, False),
    "cut.txt": ("é" * 5000).encode() and (b"x" + "é".encode() * 5000, None, R.TXT, True, False),
    "empty.txt": (b"", None, R.TXT, True, False),
}


def test_kinds(spark):
    rows = [(name, data, declared) for name, (data, declared, *_) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, content binary, declared string")
    got = {r.name: r.k for r in R.with_kind(df, "content", "name", "declared", "k").collect()}
    for name, (_, _, mime, supported, mismatch) in CASES.items():
        k = got[name]
        assert (k.mime, k.is_supported, k.mismatch) == (mime, supported, mismatch), name
        assert (k.detail is None) == supported
    assert got["b.docx"].extension == "docx" and got["old"].extension == ""
    odd = R.with_kind(spark.createDataFrame([(None, None)], "name string, content binary"), "content", "name").first().kind
    assert odd.mime == R.TXT and not odd.mismatch


def test_decode_ladder(spark):
    word = "naïve “quotes” – déjà"
    cases = [(word.encode(), word), (word.encode("utf-8-sig"), word), (word.encode("utf-16"), word), (word.encode("utf-16-be") and b"\xfe\xff" + word.encode("utf-16-be"), word), (word.encode("cp1252"), word), (word.encode("cp1252") + b" ", word + " "), (b"caf\xe9 \x81", "café \x81"), ("ab".encode("utf-16-le") + b"\xe9\0", "abé"), (b"\xff\xfe\x00\xd8", "ÿþ\0Ø"), (b"", ""), (None, None), (b"\xe9" * 100_000, "é" * 100_000)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = {r.i: r.t for r in df.select("i", R.decode_bytes(F.col("content")).alias("t")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


def test_files_of_a_folder_and_rejects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, (data, *_) in CASES.items():
        (tmp_path / "sub" / name).write_bytes(data)
    (tmp_path / "blank.txt").write_bytes(b" \n\t")
    files = R.scan(spark, f"file://{tmp_path}")
    good, bad = R.read_documents(files.withColumn("path", F.regexp_extract("path", "[^/]+$", 0)))
    texts, reasons = {r.path: r.text for r in good.collect()}, {r.path: r.reason for r in bad.collect()}
    assert set(texts) | set(reasons) | {"empty.txt"} == {*CASES, "blank.txt"} and not set(texts) & set(reasons)
    assert set(reasons) - {"empty.txt"} == {"blank.txt", *(n for n, c in CASES.items() if not c[3])}
    assert texts["w.html"] == "  <!DOCTYPE html><p>x" and texts["latin.txt"] == "un café, déjà vu" and texts["a.pdf"] is None
    both = R.read_documents(spark.createDataFrame([("e.txt", bytearray(b"")), ("n.txt", None)], "path string, content binary"))
    assert both[0].count() == 0 and {r.reason for r in both[1].collect()} == {"empty"}
