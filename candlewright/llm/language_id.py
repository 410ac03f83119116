"""Language identification with a convolutional network over bytes.

Filters of several widths slide over windows of a fixed number of bytes; each keeps its highest response; a
softmax layer names the language. A filter over one-hot bytes is a table of 256 rows for each of its
positions, so a response is a sum of table rows. Everything is trained here, in numpy, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD_OUT, fold, table, text_chunks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled documents of each language that training takes at most, in expectation, and windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 1200, 3
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: Labelled documents that training takes at most of all languages together, in expectation; of many languages each has fewer.
TRAIN_ALL = 60_000

#: A character of a letter category; numbers in other forms, as one half, are none.
_LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW bytes, the last one filled with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """tables: for each width and position 256 x FILTERS; bias of the filters; softmax layer."""

    names: list[str]
    tables: list[list[np.ndarray]]
    bias: np.ndarray
    layer: np.ndarray
    shift: np.ndarray

    def pooled(self, x: np.ndarray, want_at: bool = False):
        """Highest responses over each window, and where they are."""
        tops, ats = [], []
        for rows in self.tables:
            span = WINDOW - len(rows) + 1
            total = rows[0][x[:, :span]]
            for k in range(1, len(rows)):
                total += rows[k][x[:, k : k + span]]
            if want_at:
                at = total.argmax(axis=1)
                ats.append(at)
                tops.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
            else:
                tops.append(total.max(axis=1))
        return np.concatenate(tops, axis=1) + self.bias, ats

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.names)), np.float32)
        for i in range(0, len(x), 128):
            top, _ = self.pooled(x[i : i + 128])
            out[i : i + 128] = _softmax(np.maximum(top, 0) @ self.layer + self.shift)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted cross entropy, by tables, bias, layer and shift."""
    top, ats = net.pooled(x, True)
    act = np.maximum(top, 0)
    error = _softmax(act @ net.layer + net.shift)
    error[np.arange(len(y)), y] -= 1
    error *= weight[:, None]
    back = (error @ net.layer.T) * (top > 0)
    grads = []
    for j, rows in enumerate(net.tables):
        own = back[:, j * FILTERS : (j + 1) * FILTERS]
        for k in range(len(rows)):
            g = np.zeros((256, FILTERS), np.float32)
            np.add.at(g, (np.take_along_axis(x, ats[j] + k, axis=1), np.arange(FILTERS)[None, :]), own)
            grads.append(g)
    return [*grads, back.sum(axis=0), act.T @ error, error.sum(axis=0)]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 11) -> Network:
    """Trains by Adam on windows ``x`` of language numbers ``y``, classes weighted to equal shares."""
    rng = np.random.default_rng(seed)
    tables = [[rng.normal(0, 0.1, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
    width = FILTERS * len(WIDTHS)
    net = Network(names, tables, np.zeros(width, np.float32), rng.normal(0, 0.1, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    flat = [t for rows in tables for t in rows] + [net.bias, net.layer, net.shift]
    first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    weight = (len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1))).astype(np.float32)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            grads = gradients(net, x[at], y[at], weight[y[at]] / len(at))
            step += 1
            for p, g, m, v in zip(flat, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, docs_each: int = TRAIN_DOCS) -> Network | None:
    """A network for the languages of the training folds, or None where no row has one.

    About ``docs_each`` documents of each language, or an equal share of TRAIN_ALL if that is less, are drawn by a hash
    of doc_id, and up to TRAIN_WINDOWS windows of each, anywhere in its text. Every language is learnt.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold("doc_id", 4), F.lit(0)) != HELD_OUT))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    names = sorted(counts)
    each = min(docs_each, max(TRAIN_ALL // len(names), 1))
    shares = docs.sparkSession.createDataFrame([(name, min(1 << 40, (each << 40) // counts[name])) for name in names], "lang string, share long")
    # A row for each language, which the driver has counted.
    drawn = usable.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            out = []
            for doc, text, lang in zip(*(chunk.column(c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                if _LETTER.search(text):
                    all_ = windows(text.encode())
                    rng = np.random.default_rng(abs(doc or 0))
                    picks = rng.choice(len(all_), min(TRAIN_WINDOWS, len(all_)), replace=False)
                    out += [(doc, lang, all_[p].tobytes()) for p in sorted(picks.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())], ["doc_id", "lang", "bytes"]
            )

    got = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, "doc_id long, lang string, bytes binary").toArrow().sort_by([("doc_id", "ascending"), ("bytes", "ascending")])
    if got.num_rows == 0:
        return None
    x = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[v] for v in got.column("lang").to_pylist()])
    return fit(x, y, names)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text).

    Every window of the text counts by its bytes; the score is the mean probability of the language. A null
    text, or one without a letter, is `und` with score 0, as is every text where nothing was learnt. Of languages
    with equal scores the first by name is taken; repeated rows are alike; an empty table gives an empty result.
    Nothing but the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, size=1 << 18):
            texts = chunk.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            has = [i for i, t in enumerate(texts) if network and t and _LETTER.search(t)]
            if has:
                parts = [texts[i].encode() for i in has]
                cut = [windows(p) for p in parts]
                weight = np.concatenate([np.minimum(WINDOW, len(p) - WINDOW * np.arange(len(w))) for p, w in zip(parts, cut, strict=True)])
                starts = np.cumsum([0, *(len(w) for w in cut[:-1])])
                sums = np.add.reduceat(network.probabilities(np.concatenate(cut)) * weight[:, None], starts, axis=0)
                mean = sums / np.array([len(p) for p in parts])[:, None]
                for i, k, p in zip(has, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                    names[i], scores[i] = network.names[k], min(1.0, p)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
