"""Versions, retention, reconciliation, listings and table upkeep."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("document_id").agg((F.max("version_no") + 1).alias("next_version"))


def find_duplicates(versions: DataFrame) -> DataFrame:
    """Versions whose bytes an earlier version has: the least version id of the same checksum is the original."""
    first = F.min("version_id").over(Window.partitionBy("checksum"))
    return versions.withColumn("original", first).filter(F.col("original") != F.col("version_id"))


def activate(versions: DataFrame, target: Column) -> DataFrame:
    """The version that target marks becomes its document's active one; others are off and, if indexed, superseded."""
    chosen = F.max(target.cast("int")).over(Window.partitionBy("document_id")) == 1
    status = F.when(chosen & target, "indexed").when(chosen & (F.col("status") == "indexed"), "superseded").otherwise(F.col("status"))
    return versions.withColumns({"status": status, "is_active": F.when(chosen, target).otherwise(F.col("is_active"))})


def reindex_candidates(versions: DataFrame, docs: DataFrame) -> DataFrame:
    return versions.filter("is_active").join(docs.filter(~F.col("is_archived")).select("document_id"), "document_id").select("document_id", "version_id")


def purge(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("document_id"), "document_id", "left_anti")


def retention(versions: DataFrame, cited: DataFrame, keep: int = 5) -> DataFrame:
    """Versions to drop: not among the newest `keep` of their document, and not themselves cited. cited(version_id): a
    citation holds the version that it saw, not the others of its document."""
    age = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version_no")))
    old = versions.withColumn("age", age).filter(F.col("age") > keep).drop("age")
    return old.join(cited.select("version_id").filter("version_id IS NOT NULL").distinct(), "version_id", "left_anti")


def expired_months(months: list[str], today: datetime.date, days: int = 400) -> list[str]:
    """Of months (yyyy-MM) those of which every day is more than `days` days before today."""
    limit = today - datetime.timedelta(days=days)
    after = lambda m: datetime.date(int(m[:4]) + (m[5:] == "12"), int(m[5:]) % 12 + 1, 1)
    return sorted(m for m in months if after(m) <= limit)


def drop_old_months(spark: SparkSession, path: str, today: datetime.date, days: int = 400) -> list[str]:
    """Delete the month folders of a table that append_by_month() wrote whose rows are all older than `days` days.

    Folders are told by name: no row is read. A repeated call finds nothing more to delete. Gives the months deleted.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {m[1]: s.getPath() for s in store.listStatus(folder) if (m := re.fullmatch(r"month=(\d{4}-\d{2})", s.getPath().getName()))}
    gone = expired_months(list(found), today, days)
    for month in gone:
        store.delete(found[month], True)
    return gone


def reconcile(chunks: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, kind): chunks without a vector, vectors without a chunk, and differing access or dimension."""
    c = chunks.select("chunk_id", F.col("visibility_level").alias("c_level"), F.lit(True).alias("c"))
    p = points.select("chunk_id", F.col("visibility_level").alias("p_level"), F.size("embedding").alias("p_dim"), F.lit(True).alias("p"))
    kind = F.when(F.col("p").isNull(), "missing_vector").when(F.col("c").isNull(), "orphan_vector").when(~F.col("c_level").eqNullSafe(F.col("p_level")), "acl_mismatch").when(F.col("p_dim") != dim, "dim_mismatch")
    return c.join(p, "chunk_id", "full_outer").select("chunk_id", kind.alias("kind")).filter("kind IS NOT NULL")


def stale_pending(versions: DataFrame, before: str) -> DataFrame:
    return versions.filter(F.col("status").isin("pending", "processing") & (F.col("updated_on") < F.lit(before).cast("date")))


def retryable_jobs(jobs: DataFrame, most: int = 3) -> DataFrame:
    return jobs.filter((F.col("status") == "failed") & (F.col("attempts") < most) & F.col("retryable"))


def normalize_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def point_id(*keys: Column) -> Column:
    """A uuid-shaped id that depends on the keys alone."""
    h = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def id_timestamp(uuid7: Column) -> Column:
    """Milliseconds in the first 48 bits of a time-ordered id."""
    return F.conv(F.substring(F.regexp_replace(uuid7, "-", ""), 1, 12), 16, 10).cast("long")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key, the one that comes last in the given order."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_last")).select(*keys, *[F.col("_last")[v].alias(v) for v in values])


def job_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key the latest event type, the number of events of each key and a map of the latest value per event type."""
    last = F.max(F.struct("ts", "event_id", "value"))
    each = events.groupBy(key, "event_type").agg(last.alias("l"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.max(F.struct("l", "event_type"))["event_type"].alias("status"), F.sum("n").alias("events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", F.col("l.value").alias("value"))))).alias("metrics"))


def list_documents(docs: DataFrame, collection: int | None = None, most_level: int | None = None, subtree: str | None = None, owner: int | None = None, since: str | None = None, title: str | None = None, tags: tuple[str, ...] = ()) -> DataFrame:
    """The documents that meet every condition given."""
    out = docs
    if collection is not None:
        out = out.filter(F.col("collection_id") == collection)
    if most_level is not None:
        out = out.filter(F.col("visibility_level") <= most_level)
    if subtree is not None:
        out = out.filter((F.col("department_path") == subtree) | F.col("department_path").startswith(subtree + "."))
    if owner is not None:
        out = out.filter(F.col("owner_id") == owner)
    if since is not None:
        out = out.filter(F.col("created_on") >= F.lit(since).cast("date"))
    if title:
        out = out.filter(F.contains(F.lower("title"), F.lit(title.lower())))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return out


def page(df: DataFrame, sort: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The next rows in descending order of (sort, key) after a cursor, one more than limit to tell if there are more."""
    if after is not None:
        v, i = (F.lit(x) for x in after)
        df = df.filter((F.col(sort) < v) | ((F.col(sort) == v) & (F.col(key) < i)))
    return df.orderBy(F.desc(sort), F.desc(key)).limit(limit + 1)


def upsert(target: DataFrame, batch: DataFrame, key: str, order: str, dim: int, vector: str = "embedding") -> DataFrame:
    """target with the batch's rows in place of those of the same key; of a key's rows in the batch the last one counts.

    A vector of another dimension fails the whole batch.
    """
    checked = batch.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.lit("wrong dimension")).cast(batch.schema[vector].dataType)))
    last = checked.groupBy(key).agg(F.max_by(F.struct(*target.columns), F.col(order)).alias("_r")).select("_r.*")
    return target.join(last.select(key), key, "left_anti").select(*target.columns).unionByName(last)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def set_payload(df: DataFrame, condition: Column, patch: dict[str, object]) -> DataFrame:
    return df.withColumns({k: F.when(F.coalesce(condition, F.lit(False)), F.lit(v)).otherwise(F.col(k)) for k, v in patch.items()})


def messages_with_citations(turns: DataFrame, citations: DataFrame) -> DataFrame:
    """Each message with its citations in order of marker (an empty list where it has none)."""
    lists = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("marker", "document_id"))).alias("citations"))
    return turns.join(lists, "message_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast(lists.schema["citations"].dataType)))
