"""WARC archives from a table of payloads and back, through a chunked record table.

A payload of any size is rows (record, chunk number, bytes); writer and reader hold one chunk at a time and carry the
digest along. Archives are gzip-per-record files in a folder that all executors share, written by pyarrow's file systems
(local, HDFS, S3, ...). Each attempt of a task writes names of its own and the manifest lists those of the attempts that
counted, so a lost executor or a repeated task leaves no wrong archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

CHUNK = 1 << 18
ARCHIVE = 64 << 20
LEAST_REVISIT = 1000
MOST_TASKS = 32_768
NO_ID = -(2**63)
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3


def record_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, n_bytes, sha1, refers_to, chunk_no, data), the chunks of a record in order and together.

    refers_to is null for responses and the responding record's id for revisits: of equal payloads of at least `least`
    bytes the one with the largest id responds; of several rows with that id, the one of the first url. A revisit has one
    chunk without bytes. Only ids and digests are grouped; payloads are dealt by id and digest, so that the copies of one
    page are not brought together. A null payload is an empty one; a null id is less than all others, and where all ids
    of a payload are null each responds. Other columns are not read. An empty table gives no rows.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).withColumn("_id", F.coalesce("page_id", F.lit(NO_ID)))
    slim = rows.filter(F.col("n_bytes") >= least).select("_id", "sha1")
    same = slim.groupBy("sha1").agg(F.max("_id").alias("responds"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("responds") != NO_ID)).select("sha1", "responds")
    copies = slim.join(same.hint("merge"), "sha1").select("_id", "sha1", "responds").distinct()
    rows = rows.join(copies.hint("merge"), ["_id", "sha1"], "left")
    twin = F.row_number().over(Window.partitionBy("_id", "sha1").orderBy("url")) > 1
    rows = rows.withColumn("refers_to", F.when(F.col("responds").isNotNull() & ((F.col("_id") != F.col("responds")) | twin), F.col("responds")))
    last = F.when(F.col("refers_to").isNotNull() | (F.col("n_bytes") == 0), F.lit(0)).otherwise(F.ceil(F.col("n_bytes") / F.lit(chunk)).cast("int") - 1)
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(F.col("refers_to").isNotNull(), F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "n_bytes", "sha1", "refers_to", "chunk_no", data.alias("data"))


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20<>\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def heads(page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None) -> bytes:
    """The WARC header and the HTTP header of a record; the payload of a response follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n_bytes if refers_to is None else 0)}"]
    return "\r\n".join([*lines, "", ""]).encode() + http


def write_archives(records: DataFrame, folder: str | None = None, size: int = ARCHIVE) -> DataFrame:
    """Write a record table's records; the manifest (archive, n_records, n_bytes), one row per archive, is a written table."""
    base = folder or fresh_path(records.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = FileSystem.from_uri(base)
        system.create_dir(top, recursive=True)
        out = name = None
        count = 0
        pack = seen = want = None

        def ended() -> None:
            nonlocal pack
            if pack is not None:
                if seen is not None and seen.hexdigest() != want:
                    raise ValueError("a payload differs from its digest")
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                pack = None

        def closed() -> pa.RecordBatch:
            n = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{base}/{name}"], "n_records": pa.array([count], pa.int64()), "n_bytes": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, n_bytes, sha1, refers_to, chunk_no, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk_no == 0:
                    ended()
                    if out is not None and out.tell() >= size:
                        yield closed()
                        out = None
                    if out is None:
                        name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{top}/{name}", compression=None)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    seen, want = (hashlib.sha1() if refers_to is None else None), sha1
                    count += 1
                    out.write(pack.compress(heads(page_id, url, n_bytes, sha1, refers_to)))
                if seen is not None:
                    seen.update(data)
                    out.write(pack.compress(data))
        ended()
        if out is not None:
            yield closed()

    return written(records.mapInArrow(work, "archive string, n_records long, n_bytes long"), "manifest")


class _Members:
    """Bytes of a multi-member gzip stream, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.unpack, self.raw, self.plain = stream, None, b"", b""

    def more(self) -> bool:
        while True:
            if self.unpack is None or self.unpack.eof:
                self.raw = (self.unpack.unused_data if self.unpack is not None else self.raw) or self.stream.read(CHUNK)
                if not self.raw:
                    return False
                self.unpack = zlib.decompressobj(31)
            elif not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise EOFError("an archive ends inside a record")
            self.raw, got = b"", self.unpack.decompress(self.raw, CHUNK)
            if self.unpack.unconsumed_tail:
                self.raw = self.unpack.unconsumed_tail
            if got:
                self.plain += got
                return True

    def head(self) -> dict[str, str] | None:
        """Header fields up to the blank line; None at the end of the archive."""
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        lines, self.plain = self.plain[:end].decode("utf-8", "replace").split("\r\n"), self.plain[end + 4 :]
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise EOFError("an archive ends inside a record")
            got, self.plain = self.plain[:n], self.plain[n:]
            n -= len(got)
            yield got

    def skip(self, n: int) -> None:
        for _ in self.body(n):
            pass


def _page(urn: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The record table of the archives: one row per chunk, the digest and the size so far carried along.

    Columns page_id, url, record_type, refers_to, chunk_no, last, payload_bytes, payload_digest (hex, on the last chunk)
    and data (null without payloads). A response's digest is of the bytes read, and must equal its header's.
    """
    schema = "page_id long, url string, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary"
    names = ["page_id", "url", "record_type", "refers_to", "chunk_no", "last", "payload_bytes", "payload_digest", "data"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = FileSystem.from_uri(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    members = _Members(stream)
                    while (head := members.head()) is not None:
                        http = members.head()
                        size = int(http["content-length"])
                        named = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                        own = (_page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], _page(head.get("warc-refers-to")))
                        if head["warc-type"] == "revisit":
                            rows.append((*own, 0, True, size, named, None))
                        else:
                            seen, done, k = hashlib.sha1(), 0, 0
                            for piece in members.body(size) if size else [b""]:
                                seen.update(piece)
                                done += len(piece)
                                last = done == size
                                if last and seen.hexdigest() != named:
                                    raise ValueError("a payload differs from its digest")
                                if payloads or last:
                                    rows.append((*own, k, last, done, named if last else None, piece if payloads else None))
                                    held += len(piece) if payloads else 0
                                k += 1
                        members.skip(4)
                        if len(rows) >= 5000 or held > CHUNK * 8:
                            yield table(rows)
                            rows, held = [], 0
        if rows:
            yield table(rows)

    # a task per archive: rows of the manifest are tiny, so their sizes must not decide
    return manifest.repartition(min(max(1, manifest.count()), MOST_TASKS)).mapInArrow(work, schema)
