"""What the corpus operators share: a folder that every executor sees, and text as flat byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.batches import bounded_batches as bounded_batches

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master (tests, one machine) gets a temporary
    folder; on a cluster, whose machines don't share one, that is an error."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        there = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quill-"))
    return there.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy of each text; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int):
    """Row ranges (first, last) whose texts hold about `most` bytes together; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Roll:
    """Hashes of any stretch of a byte array from prefix sums: polynomials over random byte values, modulo two primes.

    The moduli are primes, so no family of structured strings (as there are for powers of two) shares a hash by rule;
    two given strings of n bytes do with a chance of about (n / 2**32)**2.
    """

    PRIMES = (4294967291, 4294967279)
    BASES = (2654435769, 1597334677)
    _power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    _inverse = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    _value = [np.random.default_rng(20240229 + i).integers(1, p, 256, dtype=np.uint64) for i, p in enumerate(PRIMES)]

    def __init__(self, data: np.ndarray):
        n = data.size + 1
        self.sums = []
        for i, prime in enumerate(self.PRIMES):
            for held, base in ((Roll._power, self.BASES[i]), (Roll._inverse, pow(self.BASES[i], -1, prime))):
                while held[i].size < n:
                    held[i] = np.concatenate([held[i], rest(held[i] * np.uint64(pow(base, held[i].size, prime)), prime)])
            sums = np.zeros(n, np.uint64)
            np.cumsum(rest(Roll._value[i][data] * Roll._power[i][: n - 1], prime), out=sums[1:])
            self.sums.append(sums)

    def _joined(self, parts: list[np.ndarray], size: np.ndarray | int) -> np.ndarray:
        return mixed((parts[0] << np.uint64(32) | parts[1]) + np.asarray(size, np.uint64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = [rest(rest(s[end] - s[start], p) * inv[start], p) for s, p, inv in zip(self.sums, self.PRIMES, Roll._inverse, strict=True)]
        return self._joined(parts, end - start)

    def fixed(self, k: int) -> np.ndarray:
        """The hash of the k bytes from every position."""
        parts = [rest(rest(s[k:] - s[:-k], p) * inv[: s.size - k], p) for s, p, inv in zip(self.sums, self.PRIMES, Roll._inverse, strict=True)]
        return self._joined(parts, k)


def rest(x: np.ndarray, prime: int) -> np.ndarray:
    """x modulo prime; the quotient by one number is a vector operation, the remainder is not."""
    return x - x // np.uint64(prime) * np.uint64(prime)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input moves every bit of the output (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
