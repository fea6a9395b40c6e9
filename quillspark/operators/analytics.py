"""Rollups, series, histograms and alert conditions over trace, citation and feedback tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_ANSWER = ("no_answer", "refused")


def rate(condition: Column, digits: int = 6) -> Column:
    """The share of rows that meet a condition (null counts as not met)."""
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), digits)


def pct(value: str, p: float) -> Column:
    return F.round(F.percentile(value, p), 6)


def query_daily(traces: DataFrame) -> DataFrame:
    """Queries, no-answer rate, latency percentiles, tokens, mean top score and users per day, mode and role."""
    return traces.groupBy(F.date_trunc("day", "created_at").alias("day"), "mode", "role").agg(
        F.count(F.lit(1)).alias("queries"),
        rate(F.col("answer_status").isin(*NO_ANSWER)).alias("no_answer_rate"),
        pct("total_latency_ms", 0.5).alias("p50_ms"),
        pct("total_latency_ms", 0.95).alias("p95_ms"),
        pct("ttft_ms", 0.95).alias("p95_ttft_ms"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round(F.avg("top_score"), 12).alias("avg_top_score"),
        F.countDistinct("user_id").alias("users"),
    )


def document_usage(citations: DataFrame) -> DataFrame:
    """Citations, citing answers, used citations and the last time per document."""
    return citations.groupBy("document_id").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("message_id").alias("answers"), F.count_if("was_used").alias("used"), F.max("cited_at").alias("last_cited"))


def top_questions(traces: DataFrame, since: str, least: int = 2) -> DataFrame:
    """Questions alike but for case and punctuation, asked more than `least` times since a time."""
    norm = F.lower(F.regexp_replace("raw_query", "(?i)[^a-z0-9 ]", ""))
    return (
        traces.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
        .groupBy(norm.alias("question"))
        .agg(F.min("raw_query").alias("sample"), F.count(F.lit(1)).alias("asks"), rate(F.col("answer_status") == "ok").alias("answer_rate"), F.round(F.avg("total_latency_ms"), 6).alias("avg_latency"))
        .filter(F.col("asks") > least)
    )


def content_gaps(traces: DataFrame) -> DataFrame:
    """Unanswered questions: how often, and the event whose top score came nearest."""
    return (
        traces.filter(F.col("answer_status").isin(*NO_ANSWER))
        .groupBy("raw_query")
        .agg(F.count(F.lit(1)).alias("asks"), F.max("top_score").alias("best_score"), F.max(F.struct("top_score", (-F.col("event_id")).alias("e")))["e"].alias("_e"))
        .select("raw_query", "asks", "best_score", (-F.col("_e")).alias("nearest_event"))
    )


def never_cited(docs: DataFrame, citations: DataFrame) -> DataFrame:
    return docs.join(citations.select("document_id").distinct(), "document_id", "left_anti")


def stale_documents(docs: DataFrame, usage: DataFrame, before: str) -> DataFrame:
    """Documents created before a day, never cited or last cited before it, with their use."""
    day = F.lit(before).cast("date")
    return docs.filter(F.col("created_on") < day).join(usage, "document_id", "left").filter(F.col("last_cited").isNull() | (F.col("last_cited").cast("date") < day))


def quality_feedback(traces: DataFrame, feedback: DataFrame, width: float = 0.1) -> DataFrame:
    """Thumbs up and down per bucket of the answer's top score."""
    bucket = F.round(F.floor(F.col("top_score") / width) * width, 6)
    both = traces.join(feedback.select(F.col("message_id").alias("event_id"), "rating"), "event_id")
    return both.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))


def cost_rollup(traces: DataFrame) -> DataFrame:
    """Tokens by department, role and model with subtotals."""
    return traces.rollup("department", "role", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.grouping_id().cast("long").alias("level"))


def timeseries(traces: DataFrame, bucket: str = "hour") -> DataFrame:
    return traces.groupBy(F.date_trunc(bucket, "created_at").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_latency_ms"), 6).alias("avg_latency"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def overview(traces: DataFrame, start: str, end: str) -> DataFrame:
    """One row of figures for start <= created_at < end."""
    inside = traces.filter((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp")))
    return inside.agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("user_id").alias("users"), rate(F.col("answer_status").isin(*NO_ANSWER)).alias("no_answer_rate"), pct("total_latency_ms", 0.95).alias("p95_ms"))


def stage_latency(traces: DataFrame, stages: dict[str, float]) -> DataFrame:
    """Median and 95th percentile per entry of a map of stage latencies (here shares of `value`)."""
    each = F.create_map(*[x for k, v in stages.items() for x in (F.lit(k), F.col("value") * v)])
    return traces.select(F.explode(each).alias("stage", "ms")).groupBy("stage").agg(pct("ms", 0.5).alias("p50"), pct("ms", 0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts per upper bound, and all rows under +Inf; nulls fall in no bucket."""
    totals = df.agg(*[F.count_if(F.col(column) <= b).alias(str(i)) for i, b in enumerate(bounds)], F.count(column).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)]
    return totals.select(F.inline(F.array(*pairs, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))))


def count_by(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def estimate_cost(traces: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> DataFrame:
    """Cost of each model's calls from prices per million tokens; a model without a price has the default."""
    def price(i: int) -> Column:
        found = reduce(lambda c, m: c.when(F.col("model") == m, F.lit(prices[m][i])), prices, F.when(F.lit(False), F.lit(0.0)))
        return found.otherwise(F.lit(default[i]))

    cost = (F.col("prompt_tokens") * price(0) + F.col("completion_tokens") * price(1)) / 1e6
    return traces.select("model", cost.alias("c")).groupBy("model").agg(F.round(F.sum("c"), 6).cast("decimal(12,6)").cast("double").alias("cost"))


def approx_tokens(text: Column) -> Column:
    """Tokens of a text whose usage is missing: a third of its characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 3)).cast("long")


def user_activity(traces: DataFrame) -> DataFrame:
    return traces.groupBy("role").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("queries"), F.countDistinct("user_id", F.to_date("created_at")).alias("active_days"))


def conversation_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(approx_tokens(F.col("text"))).alias("tokens"), F.max("turn").alias("last_turn"))


def scope(traces: DataFrame, subtree: str | None = None, user_id: int | None = None) -> DataFrame:
    """A user's own rows, a department subtree's, or all."""
    if user_id is not None:
        return traces.filter(F.col("user_id") == user_id)
    if subtree is not None:
        return traces.filter((F.col("department") == subtree) | F.col("department").startswith(subtree + "."))
    return traces


def hash_share(key: Column) -> Column:
    """0..2**32-1 from a key, evenly and always the same."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def sample_traces(traces: DataFrame, feedback: DataFrame, share: float = 0.1) -> DataFrame:
    """All errors, refusals and thumbs-down, and a fixed share of the rest, chosen by a hash of the id."""
    down = feedback.filter("rating = 'down'").select(F.col("message_id").alias("event_id"), F.lit(True).alias("down")).distinct()
    return traces.join(down, "event_id", "left").filter((F.col("answer_status") != "ok") | F.coalesce("down", F.lit(False)) | (hash_share(F.col("event_id")) % 100 < int(share * 100))).drop("down")


def promote_scores(df: DataFrame, scores: str, k: int = 5) -> DataFrame:
    """top_score and mean_top of an array of scores."""
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return df.withColumns({"top_score": F.round(F.array_max(scores), 6), "mean_top": F.round(F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best), 6)})


def alert_no_answer(traces: DataFrame, factor: float = 2.0, minutes: int = 15, days: int = 7) -> DataFrame:
    """Time buckets whose no-answer rate is above factor times that of the days before."""
    slot = traces.groupBy(F.window("created_at", f"{minutes} minutes")["start"].alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer_status").isin(*NO_ANSWER)).alias("bad"))
    # one row per bucket and day: a small table, whatever the traces' size
    order = Window.orderBy(F.col("slot").cast("timestamp").cast("long")).rangeBetween(-days * 86400, -1)
    base = slot.withColumns({"base_bad": F.sum("bad").over(order), "base_n": F.sum("n").over(order)})
    return base.filter(F.col("base_n") > 0).withColumns({"rate": F.round(F.col("bad") / F.col("n"), 6), "baseline": F.round(F.col("base_bad") / F.col("base_n"), 6)}).filter(F.col("bad") * F.col("base_n") > factor * F.col("base_bad") * F.col("n")).select("slot", "n", "rate", "baseline")


def alert_rate(df: DataFrame, condition: Column, limit: float, minutes: int) -> DataFrame:
    """Time buckets where the share of rows that meet a condition is above a limit."""
    slot = df.groupBy(F.window("created_at", f"{minutes} minutes")["start"].alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("bad"))
    return slot.filter(F.col("bad") > limit * F.col("n")).withColumn("rate", F.round(F.col("bad") / F.col("n"), 6))


def alert_score_drift(traces: DataFrame, drop: float = 0.2) -> DataFrame:
    """Weeks whose median top score fell by more than a share of the week before's."""
    weeks = traces.groupBy(F.date_trunc("week", "created_at").alias("week")).agg(F.round(F.median("top_score"), 6).alias("median"))
    return weeks.withColumn("before", F.lag("median").over(Window.orderBy("week"))).withColumn("alert", F.coalesce(F.col("median") < F.col("before") * (1 - drop), F.lit(False)))


def alert_cost(traces: DataFrame, factor: float = 1.5) -> DataFrame:
    """Days whose tokens are above factor times the mean of the seven days before."""
    days = traces.groupBy(F.to_date("created_at").alias("day")).agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("spend"))
    base = F.avg("spend").over(Window.orderBy("day").rowsBetween(-7, -1))
    return days.withColumn("baseline", F.round(base, 6)).withColumn("alert", F.coalesce(F.col("spend") > factor * F.col("baseline"), F.lit(False)))


def alert_probe(df: DataFrame, condition: Column, factor: float) -> DataFrame:
    """Users whose count of rows that meet a condition is above factor times the mean user's."""
    users = df.groupBy("user_id").agg(F.count_if(condition).alias("blocks"))
    return users.withColumn("mean", F.round(F.avg("blocks").over(Window.partitionBy()), 6)).filter(F.col("blocks") > factor * F.col("mean"))


def alert_latency(traces: DataFrame, limit_ms: float, minutes: int = 10) -> DataFrame:
    slot = traces.groupBy(F.window("created_at", f"{minutes} minutes")["start"].alias("slot")).agg(pct("total_latency_ms", 0.95).alias("p95"))
    return slot.filter(F.col("p95") > limit_ms)


def entity_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(entity, label, n): rows of several tables by a column each; every table is aggregated before the union."""
    counts = [df.groupBy(F.col(c).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "label", "n") for name, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def priced_rollup(traces: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> DataFrame:
    """Tokens and their cost by department, role and model with subtotals; prices are per million tokens.

    Tokens are summed by model first, so that money is computed once a group and not once a call.
    """
    price = lambda i: reduce(lambda c, m: c.when(F.col("model") == m, F.lit(prices[m][i])), prices, F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(default[i]))
    sums = traces.groupBy("department", "role", "model").agg(F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    paid = sums.withColumn("paid", (F.col("p") * price(0) + F.col("c") * price(1)) / 1e6)
    return paid.rollup("department", "role", "model").agg(F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.round(F.sum("paid"), 8).alias("cost"), F.grouping_id().cast("long").alias("level"))


def alert_queue_age(jobs: DataFrame, queued_at: str, status: str, waiting: tuple[str, ...], now: Column, minutes: int = 15) -> DataFrame:
    """(status, oldest_minutes, n) of the waiting states whose oldest job has waited for longer than `minutes`."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(queued_at).cast("timestamp"))) / 60
    oldest = jobs.filter(F.col(status).isin(*waiting)).groupBy(F.col(status).alias("status")).agg(F.round(F.max(age), 3).alias("oldest_minutes"), F.count(F.lit(1)).alias("n"))
    return oldest.filter(F.col("oldest_minutes") > minutes)
