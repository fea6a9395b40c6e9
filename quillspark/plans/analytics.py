"""Registered queries of analytics and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, with_sql
from ..operators import analytics as A

STAGES = {"retrieve": 0.4, "rerank": 0.3, "generate": 0.3}
BOUNDS = [10.0, 50.0, 100.0, 200.0, 400.0]
PRICES = {"small": (0.15, 0.6), "large": (2.5, 10.0)}


def _trace(spark, d):
    return table(spark, d, "trace")


QUERIES = {
    "agg01_query_daily": lambda s, d: A.query_daily(_trace(s, d)),
    "agg02_document_usage": lambda s, d: A.document_usage(table(s, d, "citation")),
    "agg03_top_questions": lambda s, d: A.top_questions(_trace(s, d), "2000-01-01"),
    "agg04_content_gaps": lambda s, d: A.content_gaps(_trace(s, d)),
    "agg05_never_cited": lambda s, d: A.never_cited(table(s, d, "doc_meta"), table(s, d, "citation")).select("document_id", "source"),
    "agg06_stale": lambda s, d: A.stale_documents(table(s, d, "doc_meta"), A.document_usage(table(s, d, "citation")), "2025-06-01").select("document_id", "citations", "last_cited"),
    "agg07_quality_feedback": lambda s, d: A.quality_feedback(_trace(s, d), table(s, d, "feedback")),
    "agg08_cost_rollup": lambda s, d: A.cost_rollup(_trace(s, d)),
    "agg09_timeseries": lambda s, d: A.timeseries(_trace(s, d), "hour"),
    "agg10_overview": lambda s, d: A.overview(_trace(s, d), "2000-01-01", "2100-01-01"),
    "agg11_stage_latency": lambda s, d: A.stage_latency(_trace(s, d), STAGES),
    "agg12_histogram": lambda s, d: A.histogram(table(s, d, "events"), "value", BOUNDS),
    "agg13_counters": lambda s, d: A.count_by(_trace(s, d), ["answer_status", "mode"]),
    "agg14_cost": lambda s, d: A.estimate_cost(_trace(s, d), PRICES, (1.0, 2.0)),
    "agg15_approx_tokens": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", A.approx_tokens(F.col("text")).alias("tokens")),
    "agg16_entity_counts": lambda s, d: A.count_by(table(s, d, "doc_meta"), ["collection_id", "is_archived"]),
    "agg17_user_activity": lambda s, d: A.user_activity(_trace(s, d)),
    "agg18_conversation_stats": lambda s, d: A.conversation_stats(table(s, d, "conversations")),
    "agg20_scoped": lambda s, d: A.count_by(A.scope(_trace(s, d), subtree="company.eng"), ["role", "department"]),
    "agg21_sample": lambda s, d: A.sample_traces(_trace(s, d), table(s, d, "feedback")).select("event_id", "answer_status"),
    "agg22_promote": lambda s, d: A.promote_scores(table(s, d, "trace").groupBy("user_id").agg(F.collect_list("top_score").alias("scores")), "scores").select("user_id", "top_score", "mean_top"),
    "alr1_no_answer": lambda s, d: A.alert_no_answer(_trace(s, d)),
    "alr2_errors": lambda s, d: A.alert_rate(_trace(s, d), F.col("answer_status") == "error", 0.05, 60),
    "alr3_score_drift": lambda s, d: A.alert_score_drift(_trace(s, d)),
    "alr4_cost": lambda s, d: A.alert_cost(_trace(s, d)),
    "alr5_probe": lambda s, d: A.alert_probe(_trace(s, d), F.col("answer_status") == "refused", 1.5),
    "alr6_latency": lambda s, d: A.alert_latency(_trace(s, d), 1800, 60),
}

T, C, M, FB = (with_sql(x) for x in ("trace", "citation", "doc_meta", "feedback"))

ORACLES = {
    "agg01_query_daily": T + """SELECT date_trunc('day', created_at) AS day, mode, role, count(*) AS queries,
 round(avg((answer_status IN ('no_answer','refused'))::INT), 6) AS no_answer_rate, round(quantile_cont(total_latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_latency_ms, 0.95), 6) AS p95_ms,
 round(quantile_cont(ttft_ms, 0.95), 6) AS p95_ttft_ms, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens, round(avg(top_score), 12) AS avg_top_score, count(DISTINCT user_id) AS users FROM trace GROUP BY ALL""",
    "agg02_document_usage": C + "SELECT document_id, count(*) AS citations, count(DISTINCT message_id) AS answers, count(*) FILTER (was_used) AS used, max(cited_at) AS last_cited FROM citation GROUP BY ALL",
    "agg03_top_questions": T + """SELECT lower(regexp_replace(raw_query, '[^a-z0-9 ]', '', 'gi')) AS question, min(raw_query) AS sample, count(*) AS asks, round(avg((answer_status = 'ok')::INT), 6) AS answer_rate, round(avg(total_latency_ms), 6) AS avg_latency
 FROM trace WHERE created_at >= TIMESTAMP '2000-01-01' GROUP BY 1 HAVING count(*) > 2""",
    "agg04_content_gaps": T + """SELECT raw_query, count(*) AS asks, max(top_score) AS best_score, first(event_id ORDER BY top_score DESC, event_id) AS nearest_event FROM trace WHERE answer_status IN ('no_answer','refused') GROUP BY raw_query""",
    "agg05_never_cited": with_sql("doc_meta", "citation") + "SELECT document_id, source FROM doc_meta WHERE document_id NOT IN (SELECT document_id FROM citation)",
    "agg06_stale": with_sql("doc_meta", "citation") + """SELECT document_id, citations, last_cited FROM doc_meta LEFT JOIN (SELECT document_id, count(*) AS citations, max(cited_at) AS last_cited FROM citation GROUP BY 1) USING (document_id)
 WHERE created_on < DATE '2025-06-01' AND (last_cited IS NULL OR last_cited::DATE < DATE '2025-06-01')""",
    "agg07_quality_feedback": with_sql("trace", "feedback") + "SELECT round(floor(top_score / 0.1::DOUBLE) * 0.1::DOUBLE, 6) AS bucket, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down FROM trace JOIN feedback ON event_id = message_id GROUP BY 1",
    "agg08_cost_rollup": T + "SELECT department, role, model, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, grouping(department, role, model)::BIGINT AS level FROM trace GROUP BY ROLLUP (department, role, model)",
    "agg09_timeseries": T + "SELECT date_trunc('hour', created_at) AS bucket, count(*) AS n, round(avg(total_latency_ms), 6) AS avg_latency, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens FROM trace GROUP BY 1",
    "agg10_overview": T + "SELECT count(*) AS queries, count(DISTINCT user_id) AS users, round(avg((answer_status IN ('no_answer','refused'))::INT), 6) AS no_answer_rate, round(quantile_cont(total_latency_ms, 0.95), 6) AS p95_ms FROM trace",
    "agg11_stage_latency": T + " SELECT stage, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS stage, value * {v}::DOUBLE AS ms FROM trace" for k, v in STAGES.items()) + ") GROUP BY stage",
    "agg12_histogram": " UNION ALL ".join(f"SELECT {b}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS n FROM events" for b in BOUNDS) + " UNION ALL SELECT 'inf'::DOUBLE, count(value) FROM events",
    "agg13_counters": T + "SELECT answer_status, mode, count(*) AS n FROM trace GROUP BY ALL",
    "agg14_cost": T + """SELECT model, round(sum((prompt_tokens * CASE model WHEN 'small' THEN 0.15::DOUBLE WHEN 'large' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END + completion_tokens * CASE model WHEN 'small' THEN 0.6::DOUBLE WHEN 'large' THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END) / 1e6), 6) AS cost FROM trace GROUP BY model""",
    "agg15_approx_tokens": "SELECT conv_id, turn, greatest(1, floor(length(coalesce(text, '')) / 3))::BIGINT AS tokens FROM conversations",
    "agg16_entity_counts": M + "SELECT collection_id, is_archived, count(*) AS n FROM doc_meta GROUP BY ALL",
    "agg17_user_activity": T + "SELECT role, count(DISTINCT user_id) AS users, count(*) AS queries, count(DISTINCT (user_id, created_at::DATE)) AS active_days FROM trace GROUP BY role",
    "agg18_conversation_stats": "SELECT conv_id, count(*) AS messages, sum(greatest(1, floor(length(coalesce(text, '')) / 3)))::BIGINT AS tokens, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "agg20_scoped": T + "SELECT role, department, count(*) AS n FROM trace WHERE department = 'company.eng' OR starts_with(department, 'company.eng.') GROUP BY ALL",
    "agg21_sample": with_sql("trace", "feedback") + "SELECT event_id, answer_status FROM trace WHERE answer_status <> 'ok' OR event_id IN (SELECT message_id FROM feedback WHERE rating = 'down') OR ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 100 < 10",
    "agg22_promote": T + "SELECT user_id, round(max(top_score), 6) AS top_score, round(list_sum(list_sort(list(top_score), 'DESC')[1:5]) / least(count(*), 5), 6) AS mean_top FROM trace GROUP BY user_id",
    "alr1_no_answer": T + """, slot AS (SELECT time_bucket(INTERVAL 15 MINUTES, created_at) AS slot, count(*) AS n, count(*) FILTER (answer_status IN ('no_answer','refused')) AS bad FROM trace GROUP BY 1),
 b AS (SELECT *, sum(bad) OVER w AS base_bad, sum(n) OVER w AS base_n FROM slot WINDOW w AS (ORDER BY epoch(slot) RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING))
 SELECT slot, n, round(bad / n, 6) AS rate, round(base_bad / base_n, 6) AS baseline FROM b WHERE base_n > 0 AND bad * base_n > 2 * base_bad * n""",
    "alr2_errors": T + ", slot AS (SELECT time_bucket(INTERVAL 60 MINUTES, created_at) AS slot, count(*) AS n, count(*) FILTER (answer_status = 'error') AS bad FROM trace GROUP BY 1) SELECT slot, n, bad, round(bad / n, 6) AS rate FROM slot WHERE bad > 0.05 * n",
    "alr3_score_drift": T + ", w AS (SELECT date_trunc('week', created_at)::TIMESTAMP AS week, round(median(top_score), 6) AS median FROM trace GROUP BY 1), l AS (SELECT *, lag(median) OVER (ORDER BY week) AS before FROM w) SELECT week, median, before, coalesce(median < before * (1 - 0.2::DOUBLE), false) AS alert FROM l",
    "alr4_cost": T + ", d AS (SELECT created_at::DATE AS day, sum(prompt_tokens + completion_tokens)::BIGINT AS spend FROM trace GROUP BY 1), b AS (SELECT *, round(avg(spend) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS baseline FROM d) SELECT day, spend, baseline, coalesce(spend > 1.5 * baseline, false) AS alert FROM b",
    "alr5_probe": T + ", u AS (SELECT user_id, count(*) FILTER (answer_status = 'refused') AS blocks FROM trace GROUP BY 1), m AS (SELECT *, round(avg(blocks) OVER (), 6) AS mean FROM u) SELECT user_id, blocks, mean FROM m WHERE blocks > 1.5 * mean",
    "alr6_latency": T + ", s AS (SELECT time_bucket(INTERVAL 60 MINUTES, created_at) AS slot, round(quantile_cont(total_latency_ms, 0.95), 6) AS p95 FROM trace GROUP BY 1) SELECT slot, p95 FROM s WHERE p95 > 1800",
}
