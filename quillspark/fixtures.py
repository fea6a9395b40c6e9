"""Derived tables of FIXTURES.md: one SQL text each, with the same meaning in Spark and in DuckDB.

Tables that a text reads stand in braces; array(...) and sha2(..., 256) are spelled as in Spark and replaced for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "doc_meta": """
SELECT doc_id AS document_id, doc_id % 4 AS collection_id,
  CASE WHEN doc_id % 4 = 3 THEN 'customer' ELSE 'internal' END AS mode,
  CAST(floor(doc_id / 4.0) AS BIGINT) % 5 AS visibility_level,
  CASE CAST(floor(doc_id / 20.0) AS BIGINT) % 5 WHEN 0 THEN 'company.hr' WHEN 1 THEN 'company.hr_contractors' WHEN 2 THEN 'company.eng' WHEN 3 THEN 'company.eng.platform' ELSE 'company.finance' END AS department_path,
  CASE WHEN doc_id % 11 = 0 THEN CAST(946684800 AS DOUBLE) WHEN doc_id % 7 = 0 THEN CAST(4102444800 AS DOUBLE) END AS expires_epoch,
  doc_id % 17 = 0 AS is_archived, doc_id % 13 <> 0 AS is_active,
  array(source, lang) AS tags, doc_id % 15 AS owner_id, source, lang, n_chars,
  date '2024-01-01' + CAST(doc_id % 700 AS INT) AS created_on, 'Doc ' || CAST(doc_id AS VARCHAR(20)) AS title
FROM {documents}""",
    "versions": """
SELECT d.doc_id AS document_id, v.version_no, d.doc_id * 10 + v.version_no AS version_id,
  CASE WHEN v.version_no = 3 THEN sha2(d.text, 256) ELSE sha2(d.text || CAST(v.version_no AS VARCHAR(5)), 256) END AS checksum,
  CASE WHEN d.doc_id % 10 = 0 THEN 'failed' WHEN d.doc_id % 10 = 1 THEN 'processing' WHEN d.doc_id % 10 = 2 THEN 'pending' ELSE 'indexed' END AS status,
  v.version_no = 3 AND d.doc_id % 10 > 2 AS is_active, d.doc_id % 5 AS attempts, d.doc_id % 3 = 0 AS retryable,
  date '2024-06-01' + CAST(d.doc_id % 400 AS INT) AS updated_on
FROM {documents} d CROSS JOIN (SELECT 1 AS version_no UNION ALL SELECT 2 AS version_no UNION ALL SELECT 3 AS version_no) v""",
    "points": """
SELECT e.vec_id AS chunk_id, e.vec_id % n.n AS document_id, e.embedding, e.label
FROM {embeddings} e CROSS JOIN (SELECT count(*) AS n FROM {documents}) n""",
    "trace": """
SELECT event_id, ts AS created_at, user_id, event_type, value,
  'How many ' || event_type || ' events in week ' || CAST(event_id % 12 AS VARCHAR(5)) || '?' AS raw_query,
  CASE WHEN user_id % 2 = 0 THEN 'internal' ELSE 'customer' END AS mode,
  CASE user_id % 5 WHEN 0 THEN 'guest' WHEN 1 THEN 'customer' WHEN 2 THEN 'internal_employee' WHEN 3 THEN 'manager' ELSE 'admin' END AS role,
  CASE user_id % 5 WHEN 0 THEN 'company.hr' WHEN 1 THEN 'company.hr_contractors' WHEN 2 THEN 'company.eng' WHEN 3 THEN 'company.eng.platform' ELSE 'company.finance' END AS department,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'no_answer' WHEN 'purchase' THEN 'refused' ELSE 'ok' END AS answer_status,
  CAST(floor(value * 10) AS BIGINT) AS total_latency_ms, CAST(floor(value * 5) AS BIGINT) AS ttft_ms,
  500 + event_id % 700 AS prompt_tokens, 50 + event_id % 200 AS completion_tokens,
  CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model,
  round(CASE WHEN value / 330 > 1 THEN 1 ELSE value / 330 END, 6) AS top_score
FROM {events}""",
    "citation": """
SELECT e.event_id AS message_id, e.event_id * 7 % n.n AS document_id, 1 + e.event_id % 8 AS marker, e.event_id % 3 <> 0 AS was_used, e.ts AS cited_at
FROM {events} e CROSS JOIN (SELECT count(*) AS n FROM {documents}) n""",
    "feedback": """
SELECT event_id AS message_id, user_id, CASE WHEN value < 60 THEN 'down' ELSE 'up' END AS rating, ts FROM {events} WHERE event_type = 'click'""",
    "departments": """
SELECT 'company.' || lower(r_name) || '.' || lower(n_name) AS path, 'company.' || lower(r_name) AS parent, n_nationkey AS id FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "principals": """
SELECT r.role, m.mode, p.path AS department_path FROM
 (SELECT 'guest' AS role UNION ALL SELECT 'customer' AS role UNION ALL SELECT 'internal_employee' AS role UNION ALL SELECT 'manager' AS role UNION ALL SELECT 'admin' AS role) r
 CROSS JOIN (SELECT 'internal' AS mode UNION ALL SELECT 'customer' AS mode) m
 CROSS JOIN (SELECT 'company.hr' AS path UNION ALL SELECT 'company.hr_contractors' AS path UNION ALL SELECT 'company.eng' AS path UNION ALL SELECT 'company.eng.platform' AS path UNION ALL SELECT 'company.finance' AS path UNION ALL SELECT CAST(NULL AS VARCHAR(40)) AS path) p""",
    "changes": """
SELECT event_id AS seq, event_id * 7 % 90 AS document_id, ts AS changed_at, CASE WHEN event_id % 2 = 0 THEN 'internal' ELSE 'customer' END AS mode, event_id % 5 AS visibility_level,
  CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS VARCHAR(40)) ELSE 'company.eng' END AS department_path
FROM {events}""",
    "asked": "SELECT item_id AS query_id, text AS query FROM {benchmark}",
    "hits": """
SELECT b.item_id AS query_id, d.doc_id AS chunk_id, 'doc ' || CAST(d.doc_id % 50 AS VARCHAR(5)) AS title, d.text AS content,
  round(CAST((d.doc_id * 31 + b.item_id * 17) % 1000 AS DOUBLE) / 1000, 6) AS score
FROM {benchmark} b JOIN {documents} d ON d.doc_id % 40 = b.item_id % 40""",
    "answers": """
SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'Yes [1] and [3].' WHEN 1 THEN 'Range [2-4] then [1].' WHEN 2 THEN 'List [1, 3] again [3].' WHEN 3 THEN 'Wrong [9] and [2].' ELSE 'No marker at all' END AS answer, 5 AS offered
FROM {benchmark}""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = sorted(set(_TABLE.findall(FIXTURES[name])))
    return spark.sql(FIXTURES[name], **{n: table(spark, sf_dir, n) for n in needs})


def with_sql(*names: str) -> str:
    """The WITH clause that gives DuckDB the derived tables."""
    parts = [f"{n} AS ({_TABLE.sub(lambda m: m[1], FIXTURES[n]).replace('array(', 'list_value(').replace('sha2(', 'sha256(').replace(', 256)', ')')})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
