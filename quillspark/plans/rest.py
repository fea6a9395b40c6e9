"""Registered queries of the remaining chunking, quoting and budget operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import chunking as C
from ..operators import evidence as E
from ..operators import lexical as L
from ..operators import questions as Q
from .chunks import SMALL, _docs, _sentences
from .texts import HITS, PLAN, SENT, TOKENS, _hits, _taken_apart


def _scored(s, d):
    return E.score_sentences(_taken_apart(s, d), F.col("parts"), F.col("query"))


def _vectors(s, d):
    rows = _sentences(s, d).withColumn("id", F.concat_ws(":", "doc_id", "sent_no"))
    return rows.join(L.hash_embed(rows, "id", "text", 32), "id")


def _markdown(s, d):
    return _docs(s, d).withColumn("text", F.regexp_replace("text", r"(?m)^([^\n]{1,40})\n", "## $1\n"))


def _code(s, d):
    return _docs(s, d).withColumn("text", F.regexp_replace("text", r"(?m)^(\S+) ", "# note\ndef $1 "))


def _replies(s, d):
    reply = F.concat(F.lit('Sure: {"intent": "summary", "queries": ["'), F.regexp_replace("text", r'["\\\s]', " "), F.lit('"], "keywords": []} done'))
    return table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, reply).otherwise("none").alias("reply"))


QUERIES = {
    "chk4_truncate": lambda s, d: _docs(s, d).select("doc_id", C.truncate_tokens(F.col("text"), 50).alias("t")).select("doc_id", F.length("t").cast("long").alias("n")),
    "chk9_markdown": lambda s, d: C.chunk(_markdown(s, d), "doc_id", "text", SMALL, C.opens_section).select("doc_id", "ordinal", "tokens"),
    "chk11_embedded": lambda s, d: C.embedded_breaks(_vectors(s, d), "doc_id", "vector"),
    "chk13_code": lambda s, d: C.chunk_code(_code(s, d), "doc_id", "text", SMALL).select("doc_id", "ordinal", "tokens"),
    "cit3_quote": lambda s, d: E.best_quote(_scored(s, d)).select("query_id", "chunk_id", F.md5("quote").alias("digest")),
    "ctx3_stats": lambda s, d: E.compression_stats(E.compress(_taken_apart(s, d), F.col("parts"), F.col("query"))),
    "ctx7_fit": lambda s, d: E.fit_context(_hits(s, d), 3000),
    "qry2_needed": lambda s, d: Q.plan_queries(table(s, d, "conversations")).select("conv_id", "turn", Q.needs_retrieval(F.col("intent")).alias("needed")),
    "qry5_plan": lambda s, d: _replies(s, d).withColumn("p", Q.parse_plan(F.col("reply"))).select("conv_id", "turn", F.col("p.intent").alias("intent"), F.coalesce(F.array_size("p.queries"), F.lit(0)).cast("long").alias("n")),
}

ORACLES = {
    "cit3_quote": SENT + r""", af AS (SELECT *, lead(text) OVER (PARTITION BY query_id, chunk_id ORDER BY sent_no) AS nx FROM sc), b AS (SELECT * FROM af QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(score, 9) DESC, sent_no) = 1),
 j AS (SELECT query_id, chunk_id, CASE WHEN length(text) < 80 AND nx IS NOT NULL AND length(text || ' ' || nx) <= 400 THEN text || ' ' || nx ELSE text END AS q FROM b) SELECT query_id, chunk_id, md5(CASE WHEN length(q) > 400 THEN regexp_replace(q[1:400], ' \S*$', '') || '…' ELSE q END) AS digest FROM j""",
    "ctx7_fit": HITS + ", c AS (SELECT query_id, rank, sum(" + TOKENS.format("content") + ") OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h), k AS (SELECT *, rank = 1 OR NOT bool_or(used > 3000 AND rank > 1) OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM c) SELECT query_id, count(*) FILTER (kept) AS fits FROM k GROUP BY 1",
    "qry2_needed": PLAN + " SELECT conv_id, turn, intent NOT IN ('greeting', 'feedback') AS needed FROM i",
    "qry5_plan": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'summary' END AS intent, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n FROM conversations",
}
