"""A training corpus from the documents table: judged, without near copies and repeats, mixed, and encoded.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the columns of documents, and any
further ones that come with it. An empty table stays empty. Very long texts are texts like any; a row is held whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, minhash_dedup, mixing, quality, suffix_dedup
from quillspark.llm.common import fresh_path
from quillspark.llm.queries import table, tokenizer_path

def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's own input, doesn't reject; null and empty texts are scored
    like any, repeated rows alike. Without labels of both kinds nothing is rejected."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col="_pipeline_score").filter(F.col("_pipeline_score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of least id; rows that repeat its id and text leave one.

    A null or empty text is a text; of rows that share an id and differ in text each is judged by its own.
    """
    return minhash_dedup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat earlier ones; a character of which a part goes, goes as a whole.

    Null texts become empty, texts of under 100 bytes stay as they are. n_chars counts what is left.
    """
    kept = suffix_dedup.strip_repeats(docs, whole=True)
    return kept.withColumn("text", F.col("_kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; repeated rows are repeated alike, a null source is one."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): the token ids of every text, none for a null or empty one."""
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("source mixing", mixed_sources),
    ("bpe encoding", encoded),
]

#: A trained classifier and suffix arrays are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
