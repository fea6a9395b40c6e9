"""The size of Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to 8 MB unless the session has a smaller bound: rows are whole texts,
    and 10,000 of them at once would fill an executor's memory on both sides of the exchange with Python."""
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    # other units than bytes are larger or rare enough to be set anew
    now = re.fullmatch(r"(\d+)b?", df.sparkSession.conf.get(key).strip().lower())
    if not now or int(now[1]) not in range(1, most + 1):
        df.sparkSession.conf.set(key, str(most))
    return df
