from pyspark.sql import functions as F

from quillspark.operators import blocks as B


def test_blocks_of_a_large_table_are_numbered_without_gaps(spark):
    for kind in ("long", "string"):
        df = spark.range(0, 300_000, 1, 7).select(F.format_string("%09d", F.col("id") * 7919 % 300_000).cast(kind).alias("k"))
        rows = B.table_blocks(df, "k", ["k"], 100).collect()
        for r in rows:
            assert [int(x[3:]) for x in r.text.split("\n")] == list(range(r.block_no * 100, r.block_no * 100 + 100))
        assert sorted(r.block_no for r in rows) == list(range(3000))


def test_blocks_of_wide_rows_whose_shuffles_are_coalesced_apart(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spark.range(0, 60_000, 1, 8).select((F.col("id") * 7919 % 60_000).alias("k"), *[F.sha2(F.concat("id", F.lit(str(i))).cast("string"), 512).alias(f"w{i}") for i in range(8)]).write.parquet(f"{tmp_path}/t")
        rows = B.table_blocks(spark.read.parquet(f"{tmp_path}/t"), "k", ["k", *[f"w{i}" for i in range(8)]], 100).select("block_no", F.regexp_count("text", F.lit("k: ")).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, rows)) == [(i, 100) for i in range(600)]


def test_blocks_with_null_keys_and_of_no_rows(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k long").withColumn("v", F.coalesce("k", F.lit(0)))
    assert [tuple(r) for r in B.table_blocks(df, "k", ["v"]).collect()] == [(0, "v: 0\nv: 1\nv: 2")]
    assert B.table_blocks(df.filter("false"), "k", ["v"]).collect() == []
