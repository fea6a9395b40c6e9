"""Ingestion as a stream: new documents are cleaned, chunked, embedded and put in place of their earlier versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import text as X
from ..functions.batches import bounded_batches
from ..operators import chunking, lexical
from . import rollups


def cleaned(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs.select("doc_id", X.clean_text(F.col("text")).alias("text")))


def ingest_batch(docs: DataFrame, config: chunking.Config = chunking.Config()) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ordinal, chunk_id, content, tokens, flagged): the batch form of the stream."""
    return ingest_cleaned(cleaned(docs), config)


def ingest_cleaned(clean: DataFrame, config: chunking.Config = chunking.Config()) -> DataFrame:
    """ingest_batch() of documents whose text is clean already."""
    chunks = chunking.chunk(clean.filter(F.length("text") >= 20), "doc_id", "text", config)
    flagged = F.coalesce(F.array_max(F.transform(X.injection_scan(F.col("content")), lambda f: f["confidence"])) >= 0.8, F.lit(False))
    return chunks.select("doc_id", "ordinal", chunking.chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"), "content", "tokens", flagged.alias("flagged"))


def ingest_stream(source: DataFrame, path: str, config: chunking.Config = chunking.Config()):
    """Start the stream: each micro-batch's chunks and status rows go under its number, so that a repeated batch
    replaces itself; the checkpoint is the retry."""

    def put(batch: DataFrame, number: int) -> None:
        # texts are cleaned once, for chunks and for status
        clean = cleaned(batch).persist(StorageLevel.DISK_ONLY)
        try:
            ingest_cleaned(clean, config).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
            clean.select("doc_id", F.when(F.length("text") >= 20, "indexed").otherwise("rejected").alias("status")).write.mode("overwrite").parquet(f"{path}/status/batch={number}")
        finally:
            clean.unpersist()

    return source.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start()


def embed_batch(batch: DataFrame, number: int, path: str, model: str, dim: int, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Embed the batch's distinct texts whose key no earlier batch has embedded.

    Keys stand apart from vectors, in folders by their hash's first byte: the join prunes the folders that the batch's
    keys don't fall in, and no vector is read. The batch's own earlier attempt is not asked, so a repeated batch makes
    the same rows again, in the same place. A null text has no key and is passed over.
    """
    spark = batch.sparkSession
    key = lexical.cache_key(model, dim, "document", F.col("text"))
    shard = F.substring(F.sha2("text", 256), 1, 2)
    asked = batch.filter(F.col("text").isNotNull()).select(key.alias("key"), shard.alias("shard"), "text").dropDuplicates(["key"])
    known = rollups._parts(spark, path, "keys", "key string, shard string").filter(F.col("batch") < number)
    # a left join lets the scan of the known keys be pruned by the shards asked for; an anti join wouldn't
    met = asked.join(known.select("key", "shard", F.lit(True).alias("known")).distinct(), ["shard", "key"], "left")
    new = met.filter("known IS NULL").select("key", "shard", "text")
    made = embed(new.select("key", "text")) if embed else lexical.hash_embed(new.select("key", "text"), "key", "text", dim)
    made.write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")
    # from the vectors written, so that a key counts as known only where its vector stands
    there = spark.read.parquet(f"{path}/vectors/batch={number}").select("key")
    there.withColumn("shard", F.substring(F.element_at(F.split("key", ":"), -1), 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/keys/batch={number}")


def embed_stream(source: DataFrame, path: str, model: str, dim: int, embed: Callable[[DataFrame], DataFrame] | None = None):
    """Start a stream that embeds every distinct text once, however often and in however many batches it comes."""

    def put(batch: DataFrame, number: int) -> None:
        embed_batch(batch, number, path, model, dim, embed)

    return source.writeStream.option("checkpointLocation", f"{path}/embed-state").foreachBatch(put).trigger(availableNow=True).start()


#: What a change of a document sets on its points.
ACCESS = ("mode", "visibility_level", "department_path")


def patch_batch(changes: DataFrame, number: int, points: DataFrame, path: str) -> None:
    """Apply a batch of changes(document_id, changed_at, seq, ACCESS) to the points of their documents.

    Of a document's changes the last by (changed_at, seq) counts, inside the batch and against all batches before: one
    that comes late is passed over. Written are the changes applied and the points they patch; a repeated batch writes
    the same rows again.
    """
    spark = changes.sparkSession
    order = F.struct("changed_at", "seq")
    last = changes.filter(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max_by(F.struct("changed_at", "seq", *ACCESS), order).alias("c")).select("document_id", "c.*")
    fields = ", ".join(f"{c} {last.schema[c].dataType.simpleString()}" for c in last.columns)
    before = rollups._parts(spark, path, "applied", fields).filter(F.col("batch") < number).groupBy("document_id").agg(F.max(order).alias("_before"))
    fresh = last.join(before, "document_id", "left").filter(F.col("_before").isNull() | (F.struct("changed_at", "seq") > F.col("_before"))).drop("_before")
    fresh.write.mode("overwrite").parquet(f"{path}/applied/batch={number}")
    applied = spark.read.schema(fields).parquet(f"{path}/applied/batch={number}")
    points.select("chunk_id", "document_id").join(applied, "document_id").write.mode("overwrite").parquet(f"{path}/patched/batch={number}")


def acl_patch_stream(changes: DataFrame, points: DataFrame, path: str):
    """Start a stream of document changes, joined to the static points; access_now() reads what holds after it."""

    def put(batch: DataFrame, number: int) -> None:
        patch_batch(batch, number, points, path)

    return changes.writeStream.option("checkpointLocation", f"{path}/acl-state").foreachBatch(put).trigger(availableNow=True).start()


def access_now(points: DataFrame, path: str) -> DataFrame:
    """points(chunk_id, document_id, ACCESS) with the access that the last change of their document set, if any did."""
    spark = points.sparkSession
    applied = spark.read.parquet(f"{path}/applied").groupBy("document_id").agg(F.max_by(F.struct(*ACCESS), F.struct("changed_at", "seq")).alias("_now"))
    rows = points.join(applied, "document_id", "left")
    return rows.withColumns({c: F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)) for c in ACCESS}).drop("_now")
