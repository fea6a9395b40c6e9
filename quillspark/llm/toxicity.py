"""Toxicity by subword-bag embeddings: character n-grams that share vectors, averaged into a linear softmax.

A word, in lower case between two blanks, is the mean of the vectors of its n-grams of 3 to 6 bytes, hashed into BUCKETS;
so a misspelling, an inflection or a compound that training never saw shares most of its vector with the words it comes
from. A passage of some PASSAGE words is the mean of its words, and a softmax over two classes reads it. Vectors and
softmax are trained jointly, in numpy, by gradient descent on a bounded sample of labelled texts. A
text is labelled as a whole though few of its words may be meant: of a toxic text the passage that scores most is taught,
of others too, so the clean passages that look worst are corrected. Passages are short, so that one word is heard in them.

A text's score is its worst passage's, on a logistic curve fitted on labelled texts that training did not see. Since the
softmax is linear, the two class weights fold with the vectors into one number a bucket; scoring is a sum of table lookups
over whole texts, without a shuffle.
"""

from __future__ import annotations

import warnings
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, flat, mixed
from .quality import logistic

SIZES = (3, 4, 5, 6)
BUCKETS, WIDTH = 1 << 17, 12
PASSAGE = 2
#: Most labelled texts of either class to train on and to calibrate on, and most passages of a text that training sees,
#: from all over it.
TRAIN, CALIBRATE, PASSAGES = 1200, 400, 2048
EPOCHS, BATCH, STEP, DECAY = 24, 32, 0.2, 0.003
#: Factor of a passage's mean before the softmax, share of a step that the softmax itself takes, epochs led by counts.
SHARP, SLOW, COUNTED = 4.0, 0.02, 2
#: Bytes hashed at once.
BLOCK = 256 << 10
THRESHOLD = 0.3
#: Words whose n-grams are worked out at once in training.
VOCABULARY = 20_000
SPACE = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Letters, digits, bytes of characters beyond ASCII, and marks that stand for letters in masked words.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b"@$*'"]] = True


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2 (a null id is held out)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


@dataclass
class Model:
    """One number a bucket, the softmax's own, and the curve from the worst passage's log-odds to a probability."""

    table: np.ndarray
    bias: float
    curve: np.ndarray


def normal(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts of texts) in lower case: each text begins with a blank, words are divided by one, and one ends all."""
    data, at = flat(pc.utf8_lower(column))
    n = len(at) - 1
    text = np.full(data.size + n + 1, SPACE, np.uint8)
    where = np.ones(text.size, bool)
    where[at[:-1] + np.arange(n)] = False
    where[-1] = False
    text[where] = np.where(_INSIDE[data], data, SPACE)
    starts = at + np.arange(n + 1)
    kept = text != SPACE
    kept[1:] |= text[:-1] != SPACE
    kept[starts] = True
    # a blank that ends one text and the blank that begins the next both stand, around no word
    count = np.add.reduceat(kept, starts, dtype=np.int64) if n else np.zeros(1, np.int64)
    return text[kept], np.concatenate([[0], np.cumsum(count[:-1])])


def cuts(text: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last): stretches of about `most` bytes, each from a blank to a blank that the next one begins with; a word
    that is longer stands whole."""
    first, end = 0, text.size - 1
    while first < end:
        last = min(first + most, end)
        if text[last] != SPACE:
            back = np.flatnonzero(text[first + 1 : last] == SPACE)
            if back.size:
                last = first + 1 + int(back[-1])
            else:
                ahead, step = last, 1 << 16
                while not (found := np.flatnonzero(text[ahead : ahead + step] == SPACE)).size:
                    ahead += step
                last = ahead + int(found[0])
        yield first, last
        first = last


def grams(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, valid) of the n-grams at every position, size by size. text begins and ends with a blank; n-grams hold
    blanks at their ends only, so they belong to the word whose blank or letter they begin with."""
    n = text.size
    blanks = np.flatnonzero(text == SPACE)
    # of every position but the last, the next blank behind it
    following = blanks[np.searchsorted(blanks, np.arange(n - 1), side="right")]
    reach = following - np.arange(n - 1)
    h = np.zeros(n, np.uint64)
    wide = text.astype(np.uint64) + np.uint64(1)
    for size in range(1, SIZES[-1] + 1):
        if n - size <= 0:
            return
        h = h[: n - size + 1] * _BASE + wide[size - 1 :]
        if size in SIZES:
            yield (mixed(h + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int64), reach[: n - size + 1] >= size - 1


def word_scores(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean of the table over the n-grams of each word; a blank followed by a blank is a word without any."""
    out = []
    for first, last in cuts(text, BLOCK):
        part = text[first : last + 1]
        total, count = np.zeros(part.size), np.zeros(part.size)
        for bucket, valid in grams(part):
            total[: bucket.size] += np.where(valid, table[bucket], 0.0)
            count[: bucket.size] += valid
        starts = np.flatnonzero(part[:-1] == SPACE)
        out.append(np.add.reduceat(total[:-1], starts) / np.maximum(np.add.reduceat(count[:-1], starts), 1))
    return np.concatenate(out) if out else np.zeros(0)


def words_of(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words are real, the text each belongs to) for every blank but the last."""
    blanks = np.flatnonzero(text[:-1] == SPACE)
    return text[blanks + 1] != SPACE, np.searchsorted(starts, blanks, side="right") - 1


def passages(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each passage: a text's words in even parts of PASSAGE to twice as many."""
    count = np.bincount(owner, minlength=texts)
    parts = np.maximum(count // PASSAGE, count > 0)
    text = np.repeat(np.arange(texts), parts)
    nth = np.arange(text.size) - np.repeat(np.cumsum(parts) - parts, parts)
    return (np.cumsum(count) - count)[text] + nth * count[text] // np.maximum(parts[text], 1), text


def worst(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds of the worst passage of every text; those of no words at all for a text without any."""
    text, starts = normal(column)
    real, owner = words_of(text, starts[: len(column)])
    scores = word_scores(text, table)[real]
    owner = owner[real]
    first, of = passages(owner, len(column))
    out = np.full(len(column), -np.inf)
    if first.size:
        length = np.diff(np.append(first, scores.size))
        np.maximum.at(out, of, np.add.reduceat(scores, first) / length)
    return np.where(np.isinf(out), 0.0, out) + bias


def sample_passages(text: str | None) -> str:
    """The words of at most PASSAGES passages from all over a text, its first and last among them, a line each."""
    data, starts = normal(pa.array([text or ""]))
    words = bytes(data).split()
    first, _ = passages(np.zeros(len(words), np.int64), 1)
    ends = [*first[1:].tolist(), len(words)]
    pick = range(first.size) if first.size <= PASSAGES else [i * (first.size - 1) // (PASSAGES - 1) for i in range(PASSAGES)]
    return b"\n".join(b" ".join(words[int(first[i]) : ends[i]]) for i in pick).decode("utf-8", "ignore")


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of count[0] numbers, then those from first[1], and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Trainer:
    """Vectors and softmax, trained on passages of labelled texts, a line each. Words are held as numbers and n-grams once
    a word, so the driver holds some 30 bytes for each word of the sample and 4 for each n-gram of its vocabulary."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.rng = labels, rng
        numbers: dict[str, int] = {}
        text_of, size, words = array("i"), array("i"), array("i")
        for i, text in enumerate(texts):
            for passage in filter(None, text.split("\n")):
                own = passage.split(" ")
                text_of.append(i)
                size.append(len(own))
                words.extend(numbers.setdefault(w, len(numbers)) for w in own)
        self.text_of, self.size, self.words = (np.array(a, np.int64) for a in (text_of, size, words))
        self.first = np.cumsum(self.size) - self.size
        vocabulary = list(numbers)
        parts = [self._ids(np.frombuffer(f" {' '.join(vocabulary[a : a + VOCABULARY])} ".encode(), np.uint8), len(vocabulary[a : a + VOCABULARY])) for a in range(0, len(vocabulary), VOCABULARY)]
        self.ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]) if parts else [])]).astype(np.int64)
        # n-grams that training never meets say nothing
        self.vectors = np.zeros((BUCKETS, WIDTH), np.float32)
        self.softmax = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    @staticmethod
    def _ids(text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of words' n-grams in one array, and how many each word has."""
        owner = np.cumsum(text == SPACE) - 1
        parts = [(owner[: b.size][v], b[v]) for b, v in grams(text)]
        own = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(own, kind="stable")
        return ids[order].astype(np.int32), np.bincount(own, minlength=words)[:words]

    def table(self) -> tuple[np.ndarray, float]:
        """The difference of the two classes' weights, one number a bucket, and its bias."""
        lean = SHARP * (self.softmax[:, 1] - self.softmax[:, 0])
        return (self.vectors @ lean).astype(np.float64), float(self.bias[1] - self.bias[0])

    def counted(self) -> np.ndarray:
        """The log-odds that a text of an n-gram is labelled 1, one number a bucket, from the texts that hold it."""
        held = np.ones((2, BUCKETS))
        bounds = np.flatnonzero(np.diff(self.text_of, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            words = np.unique(self.words[self.first[a] : self.first[b - 1] + self.size[b - 1]])
            held[self.labels[self.text_of[a]], np.unique(self.ids[_runs(self.at[words], np.diff(self.at)[words])])] += 1
        totals = np.maximum(np.bincount(self.labels, minlength=2), 1)
        return np.log(held[1] / totals[1]) - np.log(held[0] / totals[0])

    def scores(self, by: np.ndarray | None = None) -> np.ndarray:
        """The log-odds of every passage, or the mean of another table over its words."""
        table, bias = self.table() if by is None else (by, 0.0)
        words = np.zeros(self.at.size - 1)
        for a in range(0, words.size, VOCABULARY):
            at = self.at[a : a + VOCABULARY + 1]
            # every word has an n-gram, since blanks stand around it
            words[a : a + VOCABULARY] = np.add.reduceat(table[self.ids[at[0] : at[-1]]], at[:-1] - at[0]) / np.diff(at)
        return np.add.reduceat(words[self.words], self.first) / self.size + bias

    def step(self, chosen: np.ndarray, target: np.ndarray, step: float) -> None:
        """One gradient step on some passages: through the softmax into the vectors of every n-gram."""
        lengths = self.size[chosen]
        row = np.repeat(np.arange(len(chosen)), lengths)
        word = self.words[_runs(self.first[chosen], lengths)]
        grams_of = np.diff(self.at)[word]
        ids = self.ids[_runs(self.at[word], grams_of)]
        share = (1 / (np.repeat(np.maximum(grams_of, 1), grams_of) * np.repeat(lengths[row], grams_of))).astype(np.float32)
        rows = np.repeat(row, grams_of)
        used, place = np.unique(ids, return_inverse=True)
        # the bag as a dense matrix of passages by the buckets used
        bag = np.zeros((len(chosen), used.size), np.float32)
        np.add.at(bag, (rows, place), share)
        mean = SHARP * (bag @ self.vectors[used])
        logits = mean @ self.softmax + self.bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        slope = odds / odds.sum(1, keepdims=True)
        slope[np.arange(len(chosen)), target] -= 1
        by_vector = SHARP * (bag.T @ (slope @ self.softmax.T))
        self.softmax -= step * SLOW * (mean.T @ slope)
        self.bias -= step * SLOW * slope.sum(0)
        self.vectors[used] -= step * (by_vector + DECAY * self.vectors[used])

    def run(self) -> None:
        if not self.size.size:
            return
        for epoch in range(EPOCHS):
            # a text's worst passage stands for it, at first by counts; and any other passages of clean texts
            rank = self.scores(self.counted() if epoch < COUNTED else None)
            order = np.lexsort((rank, self.text_of))
            last = order[np.append(self.text_of[order][1:] != self.text_of[order][:-1], True)]
            clean = np.flatnonzero(self.labels[self.text_of] == 0)
            more = self.rng.choice(clean, min(clean.size, last.size // 2), replace=False) if clean.size else clean
            chosen = self.rng.permutation(np.concatenate([last, more]))
            for i in range(0, chosen.size, BATCH):
                part = chosen[i : i + BATCH]
                self.step(part, self.labels[self.text_of[part]], STEP * (1 - epoch / EPOCHS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on a bounded sample of labelled rows that are not held out; None if a class has no such row.

    The sample is the TRAIN + CALIBRATE rows of each class with the least md5 of the id; the last CALIBRATE (a quarter of
    fewer) fit the curve, weighed by the class sizes in the whole label table, on whole texts scored in tasks. Of a
    training text at most PASSAGES passages from all over it come to the driver. Of rows that share an id the text of
    least md5 is taken; labels other than 0 and 1 and null ids are passed over; an id with both labels counts for both.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(~held_out(F.col("_id"))).filter("_y IN (0, 1)").distinct()
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    mark = F.md5(F.col("_id").cast("string"))
    picks = [rows.filter(F.col("_y") == y).orderBy(mark, "_id").limit(TRAIN + CALIBRATE) for y in (0, 1)]
    # at most 2 * (TRAIN + CALIBRATE) ids: a broadcast of proven size
    sample = F.broadcast(picks[0].unionByName(picks[1]))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = texts.join(sample, F.col("_doc") == F.col("_id")).groupBy("_doc", "_y").agg(F.min(F.struct(F.md5("_t").alias("_k"), "_t")).alias("_one")).select("_doc", "_y", F.col("_one._t").alias("_t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([sample_passages(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], ["_doc", "_y", "parts"])

    kind = found.schema["_doc"].dataType
    schema = T.StructType([T.StructField("_doc", kind), T.StructField("_y", T.IntegerType()), T.StructField("parts", T.StringType())])
    got: dict[int, list] = {0: [], 1: []}
    for r in bounded_batches(found).mapInArrow(work, schema).orderBy(F.md5(F.col("_doc").cast("string")), "_doc", "_y").toLocalIterator():
        got[r["_y"]].append((r["_doc"], r["parts"]))
    if not got[0] or not got[1]:
        return None
    cut = {y: min(TRAIN, max(1, len(t) * 3 // 4)) for y, t in got.items()}
    taught = [(parts, y) for y in (0, 1) for _, parts in got[y][: cut[y]]]
    trainer = Trainer([t for t, _ in taught], np.array([y for _, y in taught]))
    trainer.run()
    table, bias = trainer.table()
    rest = [(doc, y) for y in (0, 1) for doc, _ in got[y][cut[y] :] or got[y]]
    asked = docs.sparkSession.createDataFrame(rest, T.StructType([T.StructField("_doc", kind), T.StructField("_y", T.IntegerType())]))
    odds = _with_odds(found.join(F.broadcast(asked), ["_doc", "_y"], "left_semi").select("_doc", "_y", "_t"), "_t", ["_doc", "_y"], table, bias)
    held = sorted((r["_odds"], r["_y"]) for r in odds.select("_y", "_odds").collect())
    y = np.array([k for _, k in held], float)
    weight = np.array([counts[k] / max(1, int((y == k).sum())) for _, k in held])
    x = np.column_stack([np.ones(len(held)), np.array([o for o, _ in held])])
    curve = logistic(x, y, weight * len(held) / weight.sum())
    if curve[1] <= 0:
        warnings.warn("held-in texts of both kinds score alike", stacklevel=2)
    return Model(table, bias, curve)


def _with_odds(docs: DataFrame, text_col: str, keep: list[str], table: np.ndarray, bias: float) -> DataFrame:
    """keep and _odds, the worst passage's log-odds of each whole text; a null text is empty."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_odds", T.DoubleType())])
    own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(keep)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(len(keep)), "")
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(worst(column, table, bias) if len(column) else [], pa.float64())], [*keep, "_odds"])

    return bounded_batches(docs).select(*own, F.col(text_col).alias("_text")).mapInArrow(work, schema)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in keep) and the probability that label 1 is right, of each whole text.

    Null reads as empty; an empty text, or one without words, has the score of the softmax's bias. Equal texts have equal
    scores. A column already named score_col is replaced; others pass as they are. Without a model (there were no labels
    of both kinds to learn from) all scores are 0, with a warning. An empty table gives no rows.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c != score_col]
    if model is None:
        warnings.warn("no labels of both kinds to learn from: every score is 0", stacklevel=2)
        return docs.select(*names, F.lit(0.0).alias(score_col))
    a, b = map(float, model.curve)
    odds = _with_odds(docs, text_col, names, model.table, model.bias)
    p = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.lit(a) + F.lit(b) * F.col("_odds")))))
    return odds.select(*names, p.alias(score_col))
