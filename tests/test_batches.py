import pytest

from quillspark.operators import chunking as C
from quillspark.operators import structure as S
from quillspark.sources import readers as H


@pytest.mark.parametrize("of", [C.split_sentences, C.chunk, S.delimited_blocks, S.json_to_lines, H.html_to_blocks])
def test_whole_texts_pass_in_bounded_batches(spark, of):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        of(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t")
        assert spark.conf.get(key).rstrip("b") == str(8 << 20)
    finally:
        spark.conf.set(key, before)
