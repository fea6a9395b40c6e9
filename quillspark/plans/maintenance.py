"""Registered queries of versions, upkeep, listings and set operations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..fixtures import table, with_sql
from ..operators import maintenance as M
from ..sources import readers as S
from .streams import _path

DIM = 64


def _v(s, d):
    return table(s, d, "versions")


def _batch(s, d):
    p = table(s, d, "points").filter("chunk_id % 3 = 0")
    return p.withColumns({"label": F.lit(100) + F.col("label"), "seq": F.lit(1)}).unionByName(p.withColumns({"label": F.lit(200) + F.col("label"), "seq": F.lit(2)}))


def _reconcile(s, d):
    p = table(s, d, "points").withColumn("visibility_level", F.col("chunk_id") % 5)
    chunks = p.filter("chunk_id % 11 <> 0").withColumn("visibility_level", F.when(F.col("chunk_id") % 13 == 0, 9).otherwise(F.col("visibility_level")))
    return M.reconcile(chunks, p.filter("chunk_id % 7 <> 0"), DIM)


def _traces_kept(s, d):
    path = _path(s)
    later = F.col("created_at") + F.make_dt_interval((F.col("event_id") % 3 * 20).cast("int"))
    S.append_by_month(table(s, d, "trace").withColumn("created_at", later), path, "created_at")
    M.drop_old_months(s, path, datetime.date(2025, 3, 20))
    return s.read.parquet(path).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "ver1_next": lambda s, d: M.next_version(_v(s, d)),
    "ver2_duplicates": lambda s, d: M.find_duplicates(_v(s, d)).select("version_id", "original"),
    "ver3_activate": lambda s, d: M.activate(_v(s, d), (F.col("version_no") == 2) & (F.col("document_id") % 4 == 0)).select("version_id", "status", "is_active"),
    "ver4_reindex": lambda s, d: M.reindex_candidates(_v(s, d), table(s, d, "doc_meta")),
    "ver5_purge": lambda s, d: M.purge(table(s, d, "points"), table(s, d, "doc_meta").filter("is_archived")).select("chunk_id", "document_id"),
    "ver6_retention": lambda s, d: M.retention(_v(s, d), table(s, d, "citation").filter("marker = 1").select((F.col("document_id") * 10 + 1 + F.col("message_id") % 3).alias("version_id")), keep=1).select("version_id"),
    "ver6_traces": _traces_kept,
    "ver7_reconcile": _reconcile,
    "ver8_stale": lambda s, d: M.stale_pending(_v(s, d), "2025-01-01").select("version_id", "status"),
    "ver9_retry": lambda s, d: M.retryable_jobs(_v(s, d)).select("version_id"),
    "ver10_tags": lambda s, d: table(s, d, "doc_meta").select("document_id", F.array_join(M.normalize_tags(F.concat(F.transform("tags", lambda t: F.concat(F.lit(" "), F.upper(t))), F.col("tags"))), ",").alias("tags")),
    "ver11_point_id": lambda s, d: table(s, d, "points").select("chunk_id", M.point_id(F.col("document_id"), F.col("chunk_id")).alias("point_id"), M.id_timestamp(M.point_id(F.col("document_id"), F.col("chunk_id"))).alias("ms")),
    "ver12_feedback": lambda s, d: M.latest(table(s, d, "feedback"), ["user_id"], ["ts", "message_id"], ["rating"]),
    "ver13_job_state": lambda s, d: M.job_state(table(s, d, "events")).select("user_id", "status", "events", F.round(F.col("metrics")["click"], 6).alias("click")),
    "lst1_documents": lambda s, d: M.list_documents(table(s, d, "doc_meta"), most_level=3, subtree="company.eng", since="2024-03-01", title="doc 1", tags=("en", "fr")).select("document_id", "title"),
    "lst2_page": lambda s, d: M.page(s.read.parquet(f"{d}/orders.parquet"), "o_totalprice", "o_orderkey", 100, (200_000.0, 0)).select("o_orderkey", "o_totalprice"),
    "lst3_conversations": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max(F.col("conv_id") % 10 == 0).alias("pinned")).orderBy(F.desc("pinned"), F.desc_nulls_last("last"), F.desc("conv_id")).limit(50),
    "lst4_audit": lambda s, d: table(s, d, "events").filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")) & (F.col("event_type") == "error")).select("event_id", "ts"),
    "lst5_count": lambda s, d: table(s, d, "lineitem").filter("l_quantity > 25").agg(F.count(F.lit(1)).alias("n")),
    "lst6_messages": lambda s, d: M.messages_with_citations(table(s, d, "events").select(F.col("event_id").alias("message_id")), table(s, d, "citation").filter("was_used")).select("message_id", F.size("citations").cast("long").alias("n"), F.get("citations", F.lit(0))["document_id"].alias("first_document")),
    "set1_union": lambda s, d: table(s, d, "doc_meta").filter("collection_id = 1").select("document_id").union(table(s, d, "doc_meta").filter("owner_id = 2").select("document_id")).distinct(),
    "set2_intersect": lambda s, d: table(s, d, "doc_meta").filter("collection_id = 1").select("document_id").intersect(table(s, d, "doc_meta").filter("owner_id = 2").select("document_id")),
    "set3_except": lambda s, d: table(s, d, "doc_meta").filter("collection_id = 1").select("document_id").exceptAll(table(s, d, "doc_meta").filter("owner_id = 2").select("document_id")),
    "snk1_upsert": lambda s, d: M.upsert(table(s, d, "points"), _batch(s, d), "chunk_id", "seq", DIM).select("chunk_id", "label"),
    "snk3_delete": lambda s, d: M.delete_where(table(s, d, "doc_meta"), F.col("expires_epoch") < 1.7e9).select("document_id"),
    "snk4_set_payload": lambda s, d: M.set_payload(table(s, d, "doc_meta"), F.col("department_path") == "company.hr", {"mode": "internal", "visibility_level": 4}).select("document_id", "mode", "visibility_level"),
    "snk5_months": lambda s, d: table(s, d, "trace").groupBy(F.date_trunc("month", "created_at").alias("month")).agg(F.count(F.lit(1)).alias("n")),
}

V = with_sql("versions")
D = with_sql("doc_meta")
ORACLES = {
    "ver1_next": V + "SELECT document_id, max(version_no) + 1 AS next_version FROM versions GROUP BY 1",
    "ver2_duplicates": V + "SELECT version_id, original FROM (SELECT version_id, min(version_id) OVER (PARTITION BY checksum) AS original FROM versions) WHERE original <> version_id",
    "ver3_activate": V + "SELECT version_id, CASE WHEN document_id % 4 = 0 AND version_no = 2 THEN 'indexed' WHEN document_id % 4 = 0 AND status = 'indexed' THEN 'superseded' ELSE status END AS status, CASE WHEN document_id % 4 = 0 THEN version_no = 2 ELSE is_active END AS is_active FROM versions",
    "ver4_reindex": with_sql("versions", "doc_meta") + "SELECT document_id, version_id FROM versions v JOIN doc_meta d USING (document_id) WHERE v.is_active AND NOT is_archived",
    "ver5_purge": with_sql("points", "doc_meta") + "SELECT chunk_id, document_id FROM points WHERE document_id NOT IN (SELECT document_id FROM doc_meta WHERE is_archived)",
    "ver6_retention": with_sql("versions", "citation") + "SELECT version_id FROM versions WHERE version_no < 3 AND version_id NOT IN (SELECT document_id * 10 + 1 + message_id % 3 FROM citation WHERE marker = 1)",
    # 400 days before 2025-03-20 are 2024-02-14: January is over by then, February isn't
    "ver6_traces": "SELECT strftime(ts + (event_id % 3) * INTERVAL 20 DAY, '%Y-%m') AS month, count(*) AS n FROM events WHERE ts + (event_id % 3) * INTERVAL 20 DAY >= TIMESTAMP '2024-02-01' GROUP BY 1",
    "ver7_reconcile": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'missing_vector' WHEN vec_id % 11 = 0 THEN 'orphan_vector' ELSE 'acl_mismatch' END AS kind FROM embeddings WHERE (vec_id % 7 = 0) <> (vec_id % 11 = 0) OR (vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 = 0)",
    "ver8_stale": V + "SELECT version_id, status FROM versions WHERE status IN ('pending','processing') AND updated_on < DATE '2025-01-01'",
    "ver9_retry": V + "SELECT version_id FROM versions WHERE status = 'failed' AND attempts < 3 AND retryable",
    "ver10_tags": D + "SELECT document_id, array_to_string(list_sort(tags), ',') AS tags FROM doc_meta",
    "ver11_point_id": with_sql("points") + ", h AS (SELECT chunk_id, md5(document_id::VARCHAR || '|' || chunk_id::VARCHAR) AS h FROM points) SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS point_id, ('0x' || h[1:12])::BIGINT AS ms FROM h",
    "ver12_feedback": with_sql("feedback") + "SELECT user_id, first(rating ORDER BY ts DESC, message_id DESC) AS rating FROM feedback GROUP BY 1",
    "ver13_job_state": "SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS status, count(*) AS events, round(first(value ORDER BY ts DESC, event_id DESC) FILTER (event_type = 'click'), 6) AS click FROM events GROUP BY 1",
    "lst1_documents": D + "SELECT document_id, title FROM doc_meta WHERE visibility_level <= 3 AND (department_path = 'company.eng' OR starts_with(department_path, 'company.eng.')) AND created_on >= DATE '2024-03-01' AND contains(lower(title), 'doc 1') AND lang IN ('en', 'fr')",
    "lst2_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey < 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 101",
    "lst3_conversations": "SELECT conv_id, max(turn) AS last, bool_or(conv_id % 10 = 0) AS pinned FROM conversations GROUP BY 1 ORDER BY pinned DESC, last DESC NULLS LAST, conv_id DESC LIMIT 50",
    "lst4_audit": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'error'",
    "lst5_count": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25",
    "lst6_messages": with_sql("citation") + "SELECT e.event_id AS message_id, count(c.message_id) AS n, first(c.document_id ORDER BY marker, document_id) AS first_document FROM events e LEFT JOIN citation c ON e.event_id = c.message_id AND c.was_used GROUP BY 1",
    "set1_union": D + "SELECT document_id FROM doc_meta WHERE collection_id = 1 UNION SELECT document_id FROM doc_meta WHERE owner_id = 2",
    "set2_intersect": D + "SELECT document_id FROM doc_meta WHERE collection_id = 1 INTERSECT SELECT document_id FROM doc_meta WHERE owner_id = 2",
    "set3_except": D + "SELECT document_id FROM doc_meta WHERE collection_id = 1 EXCEPT SELECT document_id FROM doc_meta WHERE owner_id = 2",
    "snk1_upsert": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 200 + label ELSE label END AS label FROM embeddings",
    "snk3_delete": D + "SELECT document_id FROM doc_meta WHERE expires_epoch IS NULL OR expires_epoch >= 1.7e9",
    "snk4_set_payload": D + "SELECT document_id, CASE WHEN department_path = 'company.hr' THEN 'internal' ELSE mode END AS mode, CASE WHEN department_path = 'company.hr' THEN 4 ELSE visibility_level END AS visibility_level FROM doc_meta",
    "snk5_months": with_sql("trace") + "SELECT date_trunc('month', created_at) AS month, count(*) AS n FROM trace GROUP BY 1",
}
