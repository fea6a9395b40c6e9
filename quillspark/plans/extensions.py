"""Registered queries of plug-ins, SQL functions, sinks and ingestion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import table, with_sql
from ..functions import plugins as P
from ..sources import raw as W
from ..sources import readers as S
from ..streaming import ingest, jobs
from .search import _docs
from .streams import _path
from .texts import TOKENS


def _lengths(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count(" ")] for t in texts], float)


def _embedded(s, d):
    P.register_embedder("lengths", _lengths, 2)
    v = P.embed("lengths", F.col("text"))
    return _docs(s, d).select("chunk_id", v.alias("v")).select("chunk_id", F.col("v")[0].alias("n_chars"), F.col("v")[1].alias("n_spaces"))


def _counted(s, d):
    P.register_token_counter("spaces", lambda texts: [len(t.split(" ")) for t in texts])
    return _docs(s, d).select("chunk_id", P.count_tokens("spaces", F.col("text")).alias("n"))


def _chunked(s, d):
    P.register_chunker("lines", lambda t: t.split("\n"))
    return P.chunk_with("lines", _docs(s, d), "chunk_id", "text").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def _reranked(s, d):
    P.register_reranker("length", lambda q, p: [len(b) - len(a) for a, b in zip(q, p, strict=True)])
    return table(s, d, "hits").join(table(s, d, "asked"), "query_id").select("query_id", "chunk_id", P.rerank_score("length", F.col("query"), F.col("content")).alias("score"))


def _udtf(s, d):
    P.register_sql_functions(s)
    return s.sql("SELECT d.chunk_id, c.ordinal, c.tokens FROM {docs} d, LATERAL chunk(d.text, 200) c", docs=_docs(s, d))


def _sql(s, d):
    P.register_sql_functions(s)
    return s.sql("SELECT document_id, is_in_subtree(department_path, 'company.eng') AS inside, round(rrf_score(CAST(visibility_level AS INT), 60), 6) AS score FROM {docs}", docs=table(s, d, "doc_meta"))


def _tokens_sql(s, d):
    P.register_sql_functions(s)
    return s.sql("SELECT chunk_id, token_estimate(text) AS tokens FROM {docs}", docs=_docs(s, d))


def _appended(s, d):
    path = _path(s)
    S.append_by_month(table(s, d, "trace"), path, "created_at")
    return s.read.parquet(path).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


def _replaced(s, d):
    path = _path(s)
    v = table(s, d, "versions").select("version_no", "version_id", F.lit("first").alias("run"))
    S.overwrite_partitions(v, path, "version_no")
    S.overwrite_partitions(v.filter("version_no = 2").withColumn("run", F.lit("second")), path, "version_no")
    return s.read.parquet(path).groupBy("version_no", "run").agg(F.count(F.lit(1)).alias("n"))


def _exported(s, d):
    path = _path(s)
    S.export(table(s, d, "trace").groupBy("role").agg(F.count(F.lit(1)).alias("n")), "csv", path)
    return s.read.schema("role string, n long").option("header", True).csv(path)


def _stream(s, d):
    path = _path(s)
    schema = s.read.parquet(f"{d}/documents.parquet").schema
    ingest.ingest_stream(s.readStream.schema(schema).parquet(f"{d}/document[s].parquet"), path).awaitTermination()
    return s.read.parquet(f"{path}/status/*").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _outbox(s, d):
    rows = table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("attempts"), F.col("ts").cast("timestamp").alias("next_at"))
    return jobs.publish(rows, rows.filter("id % 5 = 0"), "2024-01-15").select("id")


def _stored(s, d):
    """Every document as a file in one of four encodings, every page, event, order and nation as a file of another kind."""
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    latin = (F.col("doc_id") % 4 == 3) & F.col("text").rlike(r"^[\x01-\x7E\xA0-\xFF]*\z")
    data = F.when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(latin, F.encode(F.when(latin, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    named = lambda df, key, end, content, said: df.select(F.concat(F.col(key).cast("string"), F.lit(end)).alias("name"), content.alias("content"), F.lit(said).cast("string").alias("declared"))
    parts = [
        named(docs, "doc_id", ".md", data, "text/markdown"),
        named(table(s, d, "pages").filter("html <> ''"), "page_id", ".txt", F.encode("html", "UTF-8"), "text/plain; charset=utf-8"),
        named(table(s, d, "events"), "event_id", ".json", F.encode("props", "UTF-8"), None),
        named(table(s, d, "orders"), "o_orderkey", ".txt", F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("o_orderstatus", "UTF-8")), "image/png"),
        named(table(s, d, "nation"), "n_nationkey", ".csv", F.lit(b""), "text/csv"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    path = _path(s)
    every.write.parquet(path)
    return s.read.parquet(path)


def _read(s, d):
    rows = W.judge(_stored(s, d), "name", "declared")
    good = F.col("reason").isNull()
    return rows.select("name", F.when(good, F.md5("text")).alias("digest"), F.when(good, F.col("kind.mime")).alias("mime"), F.when(good, F.col("kind.mismatch")).alias("mismatch"), "reason")


QUERIES = {
    "src1_files": _read,
    "udf1_embedder": _embedded,
    "udf2_reranker": _reranked,
    "udf3_counter": _counted,
    "udf4_chunker": _chunked,
    "udf5_table_function": _udtf,
    "udf7_sql": _sql,
    "udf7_tokens": _tokens_sql,
    "snk2_replace": _replaced,
    "snk5_append": _appended,
    "snk6_export": _exported,
    "str1_ingest": _stream,
    "str11_outbox": _outbox,
}

ORACLES = {
    "src1_files": r"""SELECT doc_id || '.md' AS name, CASE WHEN t THEN md5(text) END AS digest, CASE WHEN t THEN 'text/markdown' END AS mime, CASE WHEN t THEN false END AS mismatch, CASE WHEN NOT t THEN 'empty' END AS reason FROM (SELECT *, regexp_matches(text, '\S') AS t FROM documents WHERE text IS NOT NULL)
UNION ALL SELECT page_id || '.txt', md5(html), 'text/html', true, NULL FROM pages WHERE html <> ''
UNION ALL SELECT event_id || '.json', md5(props), 'application/json', false, NULL FROM events
UNION ALL SELECT o_orderkey || '.txt', NULL, NULL, NULL, 'image/png is not taken in' FROM orders
UNION ALL SELECT n_nationkey || '.csv', NULL, NULL, NULL, 'empty' FROM nation""",
    "udf1_embedder": "SELECT doc_id AS chunk_id, length(text[1:32000])::DOUBLE AS n_chars, (length(text[1:32000]) - length(replace(text[1:32000], ' ', '')))::DOUBLE AS n_spaces FROM documents",
    "udf2_reranker": with_sql("hits", "asked") + "SELECT query_id, chunk_id, (length(content) - length(query))::DOUBLE AS score FROM hits JOIN asked USING (query_id)",
    "udf3_counter": "SELECT doc_id AS chunk_id, len(string_split(text, ' ')) AS n FROM documents",
    "udf4_chunker": "SELECT doc_id AS chunk_id, len(string_split(text, chr(10))) AS n FROM documents",
    "udf7_sql": with_sql("doc_meta") + "SELECT document_id, department_path = 'company.eng' OR starts_with(department_path, 'company.eng.') AS inside, round(1.0::DOUBLE / (60 + visibility_level), 6) AS score FROM doc_meta",
    "udf7_tokens": "SELECT doc_id AS chunk_id, " + TOKENS.format("text") + " AS tokens FROM documents",
    "snk2_replace": with_sql("versions") + "SELECT version_no::INT AS version_no, CASE WHEN version_no = 2 THEN 'second' ELSE 'first' END AS run, count(*) AS n FROM versions GROUP BY 1, 2",
    "snk5_append": with_sql("trace") + "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM trace GROUP BY 1",
    "snk6_export": with_sql("trace") + "SELECT role, count(*) AS n FROM trace GROUP BY 1",
    "str1_ingest": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20 THEN 'indexed' ELSE 'rejected' END AS status FROM documents) GROUP BY 1",
    "str11_outbox": "SELECT event_id AS id FROM events WHERE event_id % 7 < 5 AND ts <= TIMESTAMP '2024-01-15' AND event_id % 5 <> 0",
}
