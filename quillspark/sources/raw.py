"""Raw files: bytes as they lie in a store, what kind they are of, their text, and what is turned away.

Bytes are judged where they are read. The main way (UTF-8) and all signatures and shapes are built-in expressions; only
bytes that are no UTF-8 pass Python, a batch at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Bytes from which a kind is told.
HEAD = 8192

# Content types by their names, those that are taken in, and the type that an extension declares.
PDF, ZIP, HTML, MARKDOWN, CSV, TSV, JSON, TXT, RTF = "application/pdf", "application/zip", "text/html", "text/markdown", "text/csv", "text/tab-separated-values", "application/json", "text/plain", "application/rtf"
_OFFICE = "application/vnd.openxmlformats-officedocument."
DOCX, PPTX, XLSX = _OFFICE + "wordprocessingml.document", _OFFICE + "presentationml.presentation", _OFFICE + "spreadsheetml.sheet"
DOC, XLS, PPT = "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"
UNKNOWN = "application/octet-stream"
SUPPORTED = (PDF, DOCX, PPTX, XLSX, HTML, MARKDOWN, CSV, TSV, JSON, TXT)
EXTENSIONS = {"pdf": PDF, "docx": DOCX, "pptx": PPTX, "xlsx": XLSX, "doc": DOC, "xls": XLS, "ppt": PPT, "htm": HTML, "html": HTML, "md": MARKDOWN, "markdown": MARKDOWN, "csv": CSV, "tsv": TSV, "json": JSON, "txt": TXT, "text": TXT, "log": TXT, "rtf": RTF}
# Signatures of files that are no documents, by the hexadecimal digits they begin with.
SIGNATURES = {
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "474946383761": "image/gif",
    "474946383961": "image/gif",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
    "1F8B08": "application/gzip",
    "425A68": "application/x-bzip2",
    "FD377A585A00": "application/x-xz",
    "377ABCAF271C": "application/x-7z-compressed",
    "526172211A07": "application/x-rar-compressed",
    "7F454C46": "application/x-executable",
    "494433": "audio/mpeg",
    "4F676753": "audio/ogg",
}
# The longest name of a table's column, in characters and words.
LONGEST_NAME, MOST_WORDS = 48, 5
_LINE_END = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85" + chr(0x2028) + chr(0x2029) + "]"


@F.pandas_udf(T.StringType())
def _other_encodings(content: pd.Series) -> pd.Series:
    """The text of bytes that are no UTF-8: UTF-16 if they have its mark or NULs, else Windows' Latin, else Latin-1."""

    def text(data: bytes | None) -> str | None:
        if data is None:
            return None
        wide = data[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in data
        for encoding in (["utf-16"] if wide else []) + ["cp1252"]:
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                pass
        return data.decode("latin-1")

    return content.map(text)


def decode_bytes(content: Column) -> Column:
    """The text of bytes, never failing: UTF-8 (its mark dropped), UTF-16 with a mark or NULs, Windows-1252, Latin-1.

    Bytes of even length that have neither mark nor NUL are never read as UTF-16, though many would pass for it. Null
    bytes give null.
    """
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    body = F.when(marked, F.substring(content, 4, 2**31 - 1)).otherwise(content)
    good = F.is_valid_utf8(body.cast("string"))
    return F.coalesce(F.when(good, body.cast("string")), _other_encodings(F.when(~good, content)))


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, length, modified) of the files of a folder and the folders in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content", "length", F.col("modificationTime").alias("modified"))


def _sample(content: Column) -> Column:
    """What the head of a file reads as; null for bytes that are no text."""
    head = F.substring(content, 1, HEAD)
    mark = F.hex(F.substring(content, 1, 2))
    latin = F.decode(head, "ISO-8859-1")
    # a cut may fall inside a character, so what is no UTF-8 there is replaced
    wide = F.regexp_replace(latin, "[\x00ÿþ]", "")
    plain = F.when(F.is_valid_utf8(head.cast("string")) | F.is_valid_utf8(F.substring(head, 1, HEAD - 3).cast("string")), F.make_valid_utf8(head.cast("string"))).otherwise(latin)
    return F.when(mark.isin("FFFE", "FEFF"), wide).when(F.instr(latin, "\0") > 0, None).otherwise(F.regexp_replace(plain, "^" + chr(0xFEFF), ""))


def _lines(text: Column, most: int) -> Column:
    every = F.split(text, _LINE_END)
    return F.slice(F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every), 1, most)


def looks_markdown(text: Column) -> Column:
    """Headings, fences, quotes, list marks, table rows or links begin one line in 20 of the first 200, and two at least."""
    lines = _lines(text, 200)
    marks = F.size(F.filter(lines, lambda x: x.rlike(r"^(#{1,2} |[-*>|] |```)") | (x.startswith("[") & (F.instr(x, "](") > 0))))
    return (F.size(lines) > 0) & (marks >= F.greatest(F.lit(2), F.floor(F.size(lines) / 20)))


def looks_tabular(text: Column, delimiter: str) -> Column:
    """The first 20 lines are rows of as many fields, two or more, and the first row's are names. Quoted fields may hold
    delimiters and line ends."""
    sample = F.array_join(_lines(text, 20), "\n")
    rows = F.filter(F.split(F.regexp_replace(sample, '"[^"]*+(?:""[^"]*+)*+"', "q"), "\n"), lambda x: x != "")
    widths = F.transform(rows, lambda x: F.size(F.split(x, delimiter)))
    names = F.transform(F.split(F.coalesce(F.get(rows, F.lit(0)), F.lit("")), delimiter), X.strip)
    name = lambda c: (c != "") & (F.length(c) <= LONGEST_NAME) & ~c.rlike(r"[.!?:;]$") & (F.size(F.split(c, r"\s+")) <= MOST_WORDS)
    return (F.size(rows) >= 2) & (F.array_min(widths) >= 2) & (F.array_min(widths) == F.array_max(widths)) & F.forall(names, name)


def _text_kind(text: Column, declared: Column, extension: Column) -> Column:
    head = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    low = F.lower(F.substring(head, 1, 2048))
    tabs = ((declared == CSV) & looks_tabular(text, ",")) | ((declared == TSV) & looks_tabular(text, "\t"))
    kind = F.when(low.rlike(r"^<(!doctype html|html|\?xml)") | (F.instr(low, "<body") > 0), HTML)
    kind = kind.when(head.rlike(r"^[\[{]") & (extension == "json"), JSON).when(tabs, declared).when(declared == MARKDOWN, MARKDOWN)
    kind = kind.when(looks_markdown(text), MARKDOWN).when(declared.isin(CSV, TSV), TXT).when(looks_tabular(text, ","), CSV)
    return kind.otherwise(TXT)


def with_kind(files: DataFrame, content: str, filename: str, declared: str | None = None, out: str = "kind") -> DataFrame:
    """files with struct(mime, extension, is_supported, detail, mismatch) in out.

    Signatures come first, then what an archive's directory names, then the shape of text; the extension tells what bytes
    don't. mismatch: the declared type, parameters and case apart, is another (an unknown one or none is no mismatch).
    Null or empty bytes are text without a shape. What several rules look at is worked out once, in columns of its own.
    """
    data = F.coalesce(F.col(content), F.lit(b""))
    extension = F.lower(F.regexp_extract(F.coalesce(F.col(filename), F.lit("")), r"[^/\\]\.([^./\\]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    said = F.col(declared) if declared else F.lit(None).cast("string")
    rows = files.withColumns({"_hex": F.hex(F.substring(data, 1, 8)), "_extension": extension, "_declared": F.lower(F.trim(F.get(F.split(F.coalesce(said, F.lit("")), ";"), F.lit(0))))})
    rows = rows.withColumn("_named", F.coalesce(F.try_element_at(kinds, F.col("_extension")), F.lit("")))
    head, extension, named = F.col("_hex"), F.col("_extension"), F.col("_named")
    other = F.lit(None).cast("string")
    for digits, mime in SIGNATURES.items():
        other = F.when(head.startswith(digits), F.lit(mime)).otherwise(other)
    # a directory entry of an archive: its mark, 42 bytes, a name
    entry = lambda name: F.decode(data, "ISO-8859-1").rlike(rf"(?s)PK\x01\x02.{{42}}{name}/")
    archive = F.when(entry("word"), DOCX).when(entry("ppt"), PPTX).when(entry("xl"), XLSX).otherwise(ZIP)
    known = F.when(head.startswith("255044462D"), PDF).when(head.startswith("504B0304"), archive).when(head == "D0CF11E0A1B11AE1", F.when(named == "", DOC).otherwise(named)).when(head.startswith("7B5C727466"), RTF).otherwise(other)
    rows = rows.withColumn("_known", known).withColumn("_sample", F.when(F.col("_known").isNull(), _sample(data)))
    sample = F.col("_sample")
    rows = rows.withColumn("_mime", F.coalesce("_known", F.when(sample.isNull(), F.lit(UNKNOWN)).otherwise(_text_kind(sample, named, extension))))
    m, legacy = F.col("_mime"), head == "D0CF11E0A1B11AE1"
    taken = m.isin(*SUPPORTED) & ~legacy
    detail = F.when(legacy, "an old office format: save it as docx, xlsx or pptx").when(m == ZIP, "an archive: its documents come one by one").when(m == RTF, "rich text: save it as docx").when(m == UNKNOWN, "not readable as a document").otherwise(F.concat(m, F.lit(" is not taken in")))
    mismatch = (F.col("_declared") != "") & (F.col("_declared") != UNKNOWN) & (F.col("_declared") != m)
    kind = F.struct(m.alias("mime"), extension.alias("extension"), taken.alias("is_supported"), F.when(~taken, detail).alias("detail"), mismatch.alias("mismatch"))
    return rows.withColumn(out, kind).drop("_hex", "_extension", "_declared", "_named", "_known", "_sample", "_mime")


def judge(files: DataFrame, filename: str = "path", declared: str | None = None) -> DataFrame:
    """files(filename, content, ...) with kind, text (where they are text) and reason (null, or why a file is turned
    away: without bytes, of white space alone, or of a kind that is not taken in)."""
    rows = with_kind(files, "content", filename, declared)
    texts = F.col("kind.mime").isin(HTML, MARKDOWN, CSV, TSV, JSON, TXT)
    rows = rows.withColumn("text", decode_bytes(F.when(texts, F.col("content"))))
    blank = texts & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    empty = F.coalesce(F.octet_length("content") == 0, F.lit(True)) | blank
    return rows.withColumn("reason", F.when(empty, "empty").when(~F.col("kind.is_supported"), F.col("kind.detail")))


def read_documents(files: DataFrame, filename: str = "path", declared: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): the files of judge() that are taken in, with kind and text, and (filename, reason, retryable)
    of the others. No reject is worth another try, since the same bytes give the same answer; a read error fails the job,
    which is."""
    judged = judge(files, filename, declared)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").select(filename, "reason", F.lit(False).alias("retryable"))
