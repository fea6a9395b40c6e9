"""Quality by compression: dictionaries of good and of bad text, and the difference of the sizes they give.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is compressed
in pieces of 4 KB with either dictionary and with none. Differences of these sizes, divided by the text's size, say
which kind it resembles and how much it repeats itself; a logistic curve fitted on other labelled texts turns their
mean and lower quartile into a probability; neither moves with the number of pieces as the least would. Whole texts are
fitted and scored; the model is a few hundred KB at any corpus size.

The difference of the two dictionaries alone tells kinds of writing apart; text that repeats itself or is noise is told
by its own compressed size, which no dictionary changes much. The README has the accuracy with and without the latter.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, flat

PIECE = 4096
DICTIONARY = 64 << 10
LEVEL = 3
#: Most labelled texts of either class to train a dictionary on, to calibrate on, and most pieces for the dictionary,
#: drawn evenly from all over each text.
TRAIN, CALIBRATE, TRAIN_PIECES = 800, 1200, 8
LOW = 0.25
THRESHOLD = 0.3


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.packs = []
        for raw in (good, bad, b""):
            own = zstandard.ZstdCompressionDict(raw) if raw else None
            if own is not None:
                own.precompute_compress(level=LEVEL)
            self.packs.append(zstandard.ZstdCompressor(dict_data=own, **plain) if own is not None else zstandard.ZstdCompressor(**plain))
        self.weights = weights

    def features(self, text: bytes | memoryview) -> list[float]:
        """1; mean and LOW quantile of (bad size - good size) / size; the same of compressed / size, over the pieces."""
        n = len(text)
        if not n:
            return [1.0, 0.0, 0.0, 1.0, 1.0]
        sizes = []
        count = -(-n // PIECE)
        for i in range(count):
            piece = text[n * i // count : n * (i + 1) // count]
            sizes.append((len(piece), *(len(p.compress(piece)) for p in self.packs)))
        s = np.array(sizes, float)
        lean = (s[:, 2] - s[:, 1]) / s[:, 0]
        own = np.minimum((s[:, 3] - 9) / s[:, 0], 1.0)
        w = s[:, 0] / n
        return [1.0, float(lean @ w), float(np.quantile(lean, LOW)), float(own @ w), float(np.quantile(own, LOW))]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms(rows) @ self.weights, -30, 30)))


def _terms(f: np.ndarray) -> np.ndarray:
    """The curve's terms: the features and the squares of the self-compression, which is odd at both ends."""
    return np.column_stack([f[:, 0], f[:, 1] * 10, f[:, 2] * 10, f[:, 3], f[:, 4], f[:, 3] ** 2, f[:, 4] ** 2])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def spread_pieces(text: bytes | memoryview) -> list[bytes]:
    """At most TRAIN_PIECES pieces from all over a text, its first and last among them."""
    count = -(-len(text) // PIECE)
    some = range(count) if count <= TRAIN_PIECES else [i * (count - 1) // (TRAIN_PIECES - 1) for i in range(TRAIN_PIECES)]
    return [bytes(text[i * PIECE : (i + 1) * PIECE]) for i in some]


def _per_text(rows: DataFrame, columns: list[str], schema: str, of) -> DataFrame:
    """columns of rows(*columns, _t) and x, which of(text as a memoryview) gives for each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = of()
        for batch in batches:
            data, offsets = flat(batch.column(len(columns)))
            view = memoryview(np.ascontiguousarray(data))
            x = [call(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kind = pa.list_(pa.binary() if "binary" in schema else pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], pa.array(x, kind)], [*columns, "x"])

    own = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return bounded_batches(rows).select(*columns, "_t").mapInArrow(work, f"{own}, {schema}")


def train_dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary from pieces of texts; where they are too few for the trainer, their tails themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(pieces))[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on a bounded sample of labelled rows that are not held out; None if a class has no such row.

    The sample is the TRAIN + CALIBRATE rows of each class with the least md5 of the id. Features are those of whole
    texts, computed in tasks; pieces for the dictionaries and five numbers a text come to the driver. Class sizes in the
    whole label table weigh the calibration. Of rows that share an id the text of least md5 is taken, so repeats do not
    widen the sample; labels other than 0 and 1 and null ids are passed over; an id with both labels counts for both.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(~held_out(F.col("_id"))).filter("_y IN (0, 1)").distinct()
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    picks = [rows.filter(F.col("_y") == y).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(TRAIN + CALIBRATE) for y in (0, 1)]
    sample = picks[0].unionByName(picks[1])
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    # at most 2 * (TRAIN + CALIBRATE) ids: a broadcast of proven size
    found = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_doc", "_y").agg(F.min(F.struct(F.md5("_t").alias("_k"), "_t")).alias("_one")).select("_doc", "_y", "_one._k", "_one._t")
    got = _per_text(found, ["_doc", "_y", "_k"], "x array<binary>", lambda: spread_pieces).orderBy(F.md5(F.col("_doc").cast("string")), "_doc", "_k").toLocalIterator()
    own: dict[int, list[tuple]] = {0: [], 1: []}
    for r in got:
        if len(own[r["_y"]]) < TRAIN + CALIBRATE:
            own[r["_y"]].append((r["_doc"], r["_k"], [bytes(p) for p in r["x"]]))
    if not own[0] or not own[1]:
        return None
    # of few texts a third trains the dictionary
    cut = {y: min(TRAIN, max(1, len(t) * TRAIN // (TRAIN + CALIBRATE))) for y, t in own.items()}
    good, bad = (train_dictionary([p for _, _, pieces in own[y][: cut[y]] for p in pieces]) for y in (1, 0))
    rest = {y: [(doc, k) for doc, k, _ in t[cut[y] :] or t] for y, t in own.items()}
    asked = docs.sparkSession.createDataFrame([(doc, y, k) for y, t in rest.items() for doc, k in sorted(set(t))], T.StructType([T.StructField("_doc", found.schema["_doc"].dataType), T.StructField("_y", T.IntegerType()), T.StructField("_k", T.StringType())]))
    whole = _per_text(found.join(F.broadcast(asked), ["_doc", "_y", "_k"], "left_semi"), ["_doc", "_y", "_k"], "x array<double>", lambda: Scorer(good, bad).features)
    features = {(r["_y"], r["_doc"], r["_k"]): list(r["x"]) for r in whole.dropDuplicates(["_doc", "_y", "_k"]).collect()}
    x, y, weight = [], [], []
    for k, t in rest.items():
        x += [features[(k, *key)] for key in t]
        y += [float(k)] * len(t)
        weight += [counts[k] / len(t)] * len(t)
    weight = np.array(weight) * len(weight) / sum(weight)
    return Model(good, bad, logistic(_terms(np.array(x)), np.array(y), weight))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) and the probability that label 1 is right, of each whole text.

    Null reads as empty; an empty text has the score of one without any resemblance. Equal texts have equal scores. A
    column already named score_col is replaced; others pass as they are. Without a model (there were no labels of both
    kinds to learn from) all scores are 1, with a warning. An empty table gives no rows.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c != score_col]
    fields = [docs.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType())])
    if model is None:
        warnings.warn("no labels of both kinds to learn from: every score is 1", stacklevel=2)
        return docs.select(*names, F.lit(1.0).alias(score_col))
    parts = (model.good, model.bad, model.weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*parts)
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            data, offsets = flat(batch.column(at["_text"]))
            view = memoryview(np.ascontiguousarray(data))
            f = np.array([scorer.features(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(at[f"_own_{c}"]) for c in names], pa.array(scorer.scores(f) if len(f) else [], pa.float64())], [*names, score_col])

    return bounded_batches(docs).select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"_own_{c}") for c in names]).mapInArrow(work, schema)
