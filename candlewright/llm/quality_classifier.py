"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, pairs of words, and the same of their shapes (which keep case, digits and
signs), hashed into 2**18 places; each counts 1 + log2 of its occurrences, and the vector has length one.
Pairs that recur are counted once more under the power of two below their number, so that repetition shows. A score is the sparse
dot product with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD_OUT, WordHashes, fold, mix, stored, table, text_chunks, utf8

BITS = 18
#: Labelled rows that training takes at most (in expectation), and passes over them.
TRAIN_ROWS, PASSES = 6000, 3
#: Features of these rows that come to the driver at most (in expectation), 8 bytes each; of long texts fewer rows are taken.
TRAIN_FEATURES = 20_000_000
#: Step size, its offset, and the weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7

_RUNS = ((re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[0-9]+"), b"9"))


def shape(word: bytes) -> bytes:
    """The word with each run of small letters, capitals and digits as one character, signs as they are."""
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word


class Shapes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(shape(word), seed=7)
        return value


def features(text: bytes, words: WordHashes, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; none where it has no word."""
    split = text.split()
    if not split:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    one = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    form = np.fromiter(map(shapes.__getitem__, split), np.uint64, len(split))
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    form_two = mix(form[:-1] * np.uint64(5) + form[1:])
    pair, times = np.unique(two, return_counts=True)
    again = times[times > 1]
    repeats = mix(np.repeat(np.log2(again).astype(np.uint64), again) + np.uint64(0x5EED))
    place = (np.concatenate([one, two, form, form_two, repeats]) >> np.uint64(64 - BITS)).astype(np.int64)
    place, count = np.unique(place, return_counts=True)
    value = 1 + np.log2(count)
    return place, (value / np.sqrt((value**2).sum())).astype(np.float32)


class Leader:
    """Follow-the-regularised-leader, one coordinate step size each; the last weight is the bias."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, features_: int = TRAIN_FEATURES) -> np.ndarray:
    """Weights learnt from at most about ``rows`` labelled rows of the training folds, drawn by a hash of doc_id.

    Features come to the driver, at most about ``features_`` of them: where the rows have more, an equal share of all
    rows, drawn by another hash, is left out. Without labelled rows all weights are zero. Columns but doc_id, text
    and ``label`` are not looked at.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", 4) != HELD_OUT))
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40)) < int((1 << 40) * share)).select("doc_id", F.col(label).cast("int").alias("label"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn) if total * share <= 2 * rows else drawn, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = WordHashes(), Shapes()
        for chunk in text_chunks(batches):
            got = [features(t, words, shapes) for t in utf8(chunk)]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("label"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                ["doc_id", "label", "place", "value"],
            )

    made = stored(joined.mapInArrow(run, "doc_id long, label int, place array<int>, value array<float>"))
    size = made.agg(F.coalesce(F.sum(F.size("place")), F.lit(0))).first()[0]
    got = made.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, features_ / max(size, 1)))).toArrow()
    order = np.argsort(mix(got.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
    label_of = got.column("label").to_numpy()
    place, value = got.column("place").combine_chunks(), got.column("value").combine_chunks()
    leader = Leader()
    for _ in range(PASSES):
        for i in order.tolist():
            leader.learn(place[i].values.to_numpy(), value[i].values.to_numpy(), int(label_of[i]))
    return leader.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row; texts that are null or empty get the score of the bias alone.

    The weights have a fixed size and travel with the tasks. Whole texts are scored; repeated rows score alike; an
    empty table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = WordHashes(), Shapes()
        for chunk in text_chunks(batches):
            out = []
            for text in utf8(chunk):
                place, value = features(text, words, shapes)
                out.append(float(sigmoid(float(weights[place] @ value) + float(weights[-1]))))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
