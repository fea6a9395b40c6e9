"""Structured Streaming jobs: windowed counts, deduplication, sessions, joins and the order of events.

A job is a function of a streaming DataFrame; the same function gives the batch result on a static one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is now, into a Parquet table: appended batch by batch under the batch's number, so
    that a repeated batch replaces itself; in complete mode the last batch stands."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table" if mode == "complete" else f"{path}/table/*")
    return out


def rollup(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type; streaming/rollups.py has quantiles."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_alert(events: DataFrame, limit: float = 0.1) -> DataFrame:
    """Share of errors per sliding window of 15 minutes, every 5."""
    w = F.window("ts", "15 minutes", "5 minutes")
    rows = events.withWatermark("ts", "10 minutes").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return rows.select(F.col("w.start").alias("start"), "n", "bad", (F.col("bad") > limit * F.col("n")).alias("alert"))


def first_wins(events: DataFrame, keys: list[str], keep: str = "24 hours") -> DataFrame:
    """The first row of each key within a time; batch: within the whole table."""
    rows = events.withWatermark("ts", keep)
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", "10 minutes").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def feedback_join(events: DataFrame, feedback: DataFrame, within: str = "1 hour") -> DataFrame:
    """Purchases joined to the same user's clicks in the time after them: an interval join of two streams."""
    a = events.select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("at")).withWatermark("at", "10 minutes")
    b = feedback.select(F.col("user_id").alias("by"), F.col("event_id").alias("click"), F.col("ts").alias("then")).withWatermark("then", "10 minutes")
    return a.join(b, (F.col("user_id") == F.col("by")) & (F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + F.expr(f"INTERVAL {within}"))).select("user_id", "purchase", "click")


#: Kinds of events in the order in which a stream may send them, each with what may follow it.
FOLLOWS = {"": ("meta",), "meta": ("citations", "token", "usage", "done", "error"), "citations": ("token", "usage", "done", "error"), "token": ("token", "usage", "done", "error"), "usage": ("done", "error"), "done": (), "error": ()}


def check_event_order(events: DataFrame, stream: str, order: str, kind: str) -> DataFrame:
    """(stream, n, ok): whether a stream's events are meta, citations, tokens, usage and one done or error, in this order.

    Each event is judged by the one before it, in a window that spills; nothing holds a stream whole. A null kind and an
    unknown one are wrong; a stream must begin with meta and end with done or error.
    """
    w = Window.partitionBy(stream).orderBy(order)
    pair = F.struct(F.coalesce(F.lag(kind).over(w), F.lit("")).alias("before"), F.col(kind).alias("now"))
    rows = events.withColumn("_pair", pair).withColumn("_last", F.lead(F.lit(True)).over(w).isNull())
    legal = F.lit(False)
    for before, after in FOLLOWS.items():
        legal = legal | ((F.col("_pair.before") == before) & F.coalesce(F.col("_pair.now").isin(*after) if after else F.lit(False), F.lit(False)))
    fine = legal & (~F.col("_last") | F.coalesce(F.col(kind).isin("done", "error"), F.lit(False)))
    return rows.groupBy(stream).agg(F.count(F.lit(1)).alias("n"), F.min(fine).alias("ok"))


def publish(batch: DataFrame, done: DataFrame, now: str, most: int = 5) -> DataFrame:
    """Outbox rows to send: not yet done, due, and tried fewer than `most` times; sending twice is harmless by id."""
    return batch.filter((F.col("attempts") < most) & (F.col("next_at") <= F.lit(now).cast("timestamp"))).join(done.select("id"), "id", "left_anti")
