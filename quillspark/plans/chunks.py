"""Registered queries of chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import text as X
from ..operators import assembly as Y
from ..operators import chunking as C
from .texts import LINES, TOKENS, _terms

SMALL = C.Config(60, 20, 120, 0.1)


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _sentence_lists(s, d):
    return _docs(s, d).select("doc_id", F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "").alias("sentences"))


def _sentences(s, d):
    """Sentences as white-space lines: what SQL can split alike."""
    lines = _sentence_lists(s, d).select("doc_id", F.posexplode("sentences").alias("sent_no", "text"))
    return lines.withColumn("sent_no", F.col("sent_no").cast("long"))


def _blocks(s, d):
    """Lines of documents that aren't empty as blocks with places, types, pages, paths, languages and confidences by rule."""
    n = F.col("line_no")
    rows = table(s, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    path = F.when(n % 20 >= 3, F.array(F.concat(F.lit("Doc "), "doc_id"), F.concat(F.lit("Part "), F.floor(n / 20)))).otherwise(F.array().cast("array<string>"))
    kind = F.when(n % 11 == 7, "table").when(n % 13 == 5, "code").when(n % 20 == 0, "heading").otherwise("paragraph")
    return rows.filter("line <> ''").select("doc_id", n.cast("long").alias("block_no"), "start", (F.col("start") + F.length("line")).alias("end"), kind.alias("block_type"), F.floor(n / 30).alias("page"), path.alias("heading_path"), F.when(n % 4 == 1, F.col("lang")).alias("language"), F.when(n % 40 < 20, 0.9).alias("confidence"))


def _spans(s, d):
    """Windows of 900 characters, 700 apart."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("text") - 1, F.lit(0)).cast("long"), F.lit(700).cast("long"))
    rows = _docs(s, d).select("doc_id", F.length("text").alias("n"), F.posexplode(starts).alias("ordinal", "start"))
    return rows.filter("n > 0").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "start", F.least(F.col("start") + 900, F.col("n")).alias("end"))


QUERIES = {
    "chk6_assembled": lambda s, d: Y.assemble(_spans(s, d), _blocks(s, d), "doc_id").withColumn("heading_path", F.array_join("heading_path", " > ")),
    "chk8_recursive": lambda s, d: Y.recursive_chunks(_docs(s, d), "doc_id", "text", SMALL).select("doc_id", "ordinal", "start", "end", "tokens", "block_type", "blocks"),
    "chk1_sentences": lambda s, d: C.split_sentences(_docs(s, d), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends")),
    "chk5_pack": lambda s, d: C.chunk(_docs(s, d), "doc_id", "text", SMALL).select("doc_id", "ordinal", "start", "end", "tokens"),
    "chk6_chunks": lambda s, d: C.chunk(_docs(s, d), "doc_id", "text").select("doc_id", "ordinal", C.chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"), "tokens"),
    "chk7_header": lambda s, d: table(s, d, "doc_meta").select("document_id", C.context_header(F.col("title"), F.split("department_path", r"\.")).alias("header")),
    "chk10_semantic": lambda s, d: C.semantic_breaks(_sentence_lists(s, d), "doc_id", sentences="sentences"),
    "chk12_table": lambda s, d: C.chunk_table(table(s, d, "part").groupBy("p_brand").agg(F.concat(F.lit("| name | size |\n|---|---|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))), lambda x: F.concat(F.lit("| "), x["p_name"], F.lit(" | "), x["p_size"].cast("string"), F.lit(" |"))), "\n")).alias("text")), "p_brand", "text", C.Config(200, 50, 300)).select("p_brand", "part", "parts", F.length("content").cast("long").alias("n_chars")),
    "chk15_config": lambda s, d: C.resolve_config(_docs(s, d), "doc_id", "text").select("doc_id", "target"),
    "chk17_cap": lambda s, d: C.cap_chunks(_sentences(s, d), "doc_id", "sent_no", 10).select("doc_id", "sent_no", "over"),
    "chk20_stats": lambda s, d: C.version_stats(C.chunk(_docs(s, d), "doc_id", "text"), "doc_id"),
}

S = r"s0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents), s AS (SELECT doc_id, unnest(range(len(ls))) AS sent_no, unnest(ls) AS text FROM s0)"
ORACLES = {
    "chk6_assembled": r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
o AS (SELECT *, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b0 FROM l),
b AS (SELECT doc_id, n, b0, b0 + length(line) AS b1, CASE WHEN n % 11 = 7 THEN 'table' WHEN n % 13 = 5 THEN 'code' WHEN n % 20 = 0 THEN 'heading' ELSE 'paragraph' END AS k, n // 30 AS page, CASE WHEN n % 20 >= 3 THEN 'Doc ' || doc_id || ' > Part ' || n // 20 END AS path, CASE WHEN n % 20 >= 3 THEN 'Part ' || n // 20 END AS sec, CASE WHEN n % 4 = 1 THEN lang END AS lang, n % 40 < 20 AS sure FROM o WHERE line <> ''),
s AS (SELECT doc_id, unnest(range(0, (length(text) + 699) // 700)) AS ordinal, length(text) AS len FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, ordinal, ordinal * 700 AS s0, least(ordinal * 700 + 900, len) AS s1 FROM s)
SELECT w.doc_id, ordinal, s0 AS start, s1 AS "end", min(page) AS page_from, max(page) AS page_to, coalesce(arg_min(path, n) FILTER (path IS NOT NULL), '') AS heading_path, arg_min(sec, n) FILTER (sec IS NOT NULL) AS section, arg_min(b.lang, n) FILTER (b.lang IS NOT NULL) AS language,
coalesce(arg_min(k, n) FILTER (k IN ('table', 'code')), CASE WHEN bool_and(sure) THEN 'ocr' END, arg_min(k, n)) AS block_type, count(b.n) AS blocks
FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND b.b0 < w.s1 AND w.s0 < b.b1 GROUP BY 1, 2, 3, 4""",
    "chk7_header": "WITH m AS (SELECT doc_id, CAST(floor(doc_id / 20.0) AS BIGINT) % 5 AS k FROM documents) SELECT doc_id AS document_id, 'Doc ' || doc_id || ' > company > ' || CASE k WHEN 0 THEN 'hr' WHEN 1 THEN 'hr_contractors' WHEN 2 THEN 'eng' WHEN 3 THEN 'eng > platform' ELSE 'finance' END AS header FROM m",
    "chk10_semantic": "WITH " + S + f""", tf AS (SELECT doc_id, sent_no, term, count(*) AS tf FROM (SELECT doc_id, sent_no, unnest({_terms('text')}) AS term FROM s) GROUP BY 1, 2, 3), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 2), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
 w AS (SELECT doc_id, sent_no, term, n, tf * ln(1 + n / df) AS w FROM tf JOIN df USING (doc_id, term) JOIN n USING (doc_id)),
 g AS (SELECT doc_id, n, term, w, sent_no + o.d AS gap, o.side FROM w, (VALUES (0, 1), (1, 1), (-1, 0), (-2, 0)) o(d, side)),
 t AS (SELECT doc_id, gap, term, coalesce(sum(w) FILTER (side = 1), 0) AS l, coalesce(sum(w) FILTER (side = 0), 0) AS r FROM g WHERE gap >= 0 AND gap < n - 1 GROUP BY 1, 2, 3),
 c AS (SELECT doc_id, gap, sum(l * r) AS dot, sum(l * l) AS ll, sum(r * r) AS rr FROM t GROUP BY 1, 2), e AS (SELECT doc_id, unnest(range(n - 1)) AS gap FROM n),
 x AS (SELECT doc_id, gap, round(1 - CASE WHEN coalesce(ll, 0) > 0 AND coalesce(rr, 0) > 0 THEN dot / (sqrt(ll) * sqrt(rr)) ELSE 0 END, 9) AS distance FROM e LEFT JOIN c USING (doc_id, gap)), q AS (SELECT doc_id, round(quantile_cont(distance, 0.9), 9) AS lim FROM x GROUP BY 1)
 SELECT doc_id, gap + 1 AS sent_no FROM x JOIN q USING (doc_id) WHERE distance >= lim AND distance > 0""",
    "chk15_config": f"WITH {LINES}, m AS (SELECT doc_id, avg({TOKENS.format('line')}) AS mean FROM l GROUP BY 1) SELECT doc_id, CASE WHEN mean <= 40 THEN 920 WHEN mean >= 400 THEN 720 ELSE 800 END AS target FROM m",
    "chk17_cap": "WITH " + S + " SELECT doc_id, sent_no, count(*) OVER (PARTITION BY doc_id) > 10 AS over FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) <= 10",
}
