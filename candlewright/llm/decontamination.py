"""Benchmark decontamination by SimHash over item-sized windows.

Benchmark items get a 64-bit SimHash of their weighted word shingles. Around every shingle that a document
shares with an item (no other place can match), all windows of the lengths of the items with that shingle get
theirs from prefix sums. Four 16-bit blocks index the items of a length: each block lists the items within 4
bits of every value, so that every item within RADIUS = 19 bits is found (of 19 differing bits, some block
holds at most 4). An exact weighted similarity of the shingles then decides. Two texts of similarity 0.8 differ
in about 10 of 64 bits; tests measure how many lie beyond 19.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, map_arrow, mix, shingles, stored, table, text_chunks

SIZE = 5
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
SIMILARITY = 0.8
#: Items, and words of items, that one pass over the documents takes; more items make more passes.
ITEMS_A_PASS, WORDS_A_PASS = 500, 100_000
#: Shingles of items, 8 bytes each, that the first look at the documents takes, and one pass more.
LOOK_SHINGLES = 1 << 24
#: Windows whose fingerprints are held at once.
STRETCH = 4096

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DROP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def normal(text: str) -> bytes:
    """Lower case, without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(None, _DROP)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 64 bits of each hash."""
    return np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


class Items:
    """Items of one shingle size and, for each length that an item has, the index over their fingerprints."""

    def __init__(self, ids: list[int], grams: list[np.ndarray], size: int):
        self.ids, self.size = ids, size
        self.lengths = np.array([len(g) for g in grams])
        self.names, first = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), self.lengths)
        held, holder = np.unique(np.stack([first, owner]), axis=1)
        # Whole-number weights: a shingle of one item weighs most, one of all items least.
        self.weights = np.rint(16 * np.log2(2 + len(ids) / np.bincount(held, minlength=len(self.names)))).astype(np.int64)
        self.unknown = int(np.rint(16 * np.log2(2 + len(ids))))
        self.counts = [np.unique(g, return_counts=True) for g in grams]
        self.totals = np.array([self.weight(g).sum() for g in grams])
        self.prints = np.concatenate([_fingerprints((_bits(g) * self.weight(g)[:, None]).sum(axis=0, keepdims=True)) for g in grams])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.names & np.uint64((1 << 20) - 1)] = True
        # Items by length, and for each shingle the lengths of the items that have it.
        self.sizes, by_size = np.unique(self.lengths, return_inverse=True)
        self.lists = [[self._list(np.flatnonzero(by_size == k), b) for b in range(BLOCKS)] for k in range(len(self.sizes))]
        name, self.name_sizes = np.unique(np.stack([held, by_size[holder]]), axis=1)
        self.name_starts = np.searchsorted(name, np.arange(len(self.names) + 1))

    def _list(self, items: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of the block within RADIUS // BLOCKS bits of one of the items, sorted, and the item of each."""
        values = np.arange(1 << BLOCK_BITS)
        near = values[np.bitwise_count(values) <= RADIUS // BLOCKS]
        value = (self._block(self.prints[items], block)[:, None] ^ near[None, :]).ravel()
        order = np.argsort(value, kind="stable")
        return value[order], np.repeat(items, len(near))[order]

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def weight(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, grams), len(self.names) - 1)
        return np.where(self.names[at] == grams, self.weights[at], self.unknown)

    def seeds(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that an item has, and their places in ``names``."""
        at = np.flatnonzero(self.seen[grams & np.uint64((1 << 20) - 1)])
        where = np.minimum(np.searchsorted(self.names, grams[at]), len(self.names) - 1)
        hit = self.names[where] == grams[at]
        return at[hit], where[hit]

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) pairs within RADIUS bits, of the items of length ``sizes[size]``."""
        pairs = []
        for block, (values, items) in enumerate(self.lists[size]):
            value = self._block(prints, block)
            start = np.searchsorted(values, value)
            n = np.searchsorted(values, value, side="right") - start
            row = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(row))]
            close = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
            pairs.append(row[close] * len(self.ids) + item[close])
        pair = np.unique(np.concatenate(pairs))
        return pair // len(self.ids), pair % len(self.ids)

    def similarity(self, window: np.ndarray, total: int, item: int) -> float:
        """Weighted Jaccard similarity of the shingle counts; ``total`` is the weight of the window."""
        have, times = np.unique(window, return_counts=True)
        want, n = self.counts[item]
        at = np.minimum(np.searchsorted(want, have), len(want) - 1)
        both = want[at] == have
        shared = (self.weight(have[both]) * np.minimum(times[both], n[at[both]])).sum()
        return float(shared / (total + self.totals[item] - shared))

    def matches(self, grams: np.ndarray, seeds: np.ndarray, names: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, first, last shingle, similarity, distance) in one document, the best of overlapping ones.

        Only the stretches around shingles that an item has are looked at, in parts of at most STRETCH.
        """
        n = self.name_starts[names + 1] - self.name_starts[names]
        place = np.repeat(seeds, n)
        of = self.name_sizes[np.repeat(self.name_starts[names] - np.cumsum(n) + n, n) + np.arange(len(place))]
        scored: dict[int, list[tuple[float, int, int, int]]] = {}
        for size in np.unique(of).tolist():
            length = min(int(self.sizes[size]), len(grams))
            marks = place[of == size]
            # Starts of the windows that hold a mark: those of a mark up to the next one's first.
            first = np.maximum(marks - length + 1, 0)
            last = np.minimum(marks, len(grams) - length)
            first[1:] = np.maximum(first[1:], last[:-1] + 1)
            n = np.maximum(last - first + 1, 0)
            starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > length) + 1):
                for low in range(0, len(part), STRETCH):
                    self._score(grams, part[low : low + STRETCH], length, size, scored)
        found: list[tuple[int, int, int, float, int]] = []
        for item, windows in scored.items():
            taken: list[tuple[int, int]] = []
            for score, a, b, distance in sorted(windows, key=lambda x: (-x[0], x[1])):
                at = bisect.bisect(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    shared = a + np.flatnonzero(np.isin(grams[a:b], self.counts[item][0]))
                    found.append((item, int(shared[0]), int(shared[-1]), score, distance))
        return found

    def _score(self, grams: np.ndarray, start: np.ndarray, length: int, size: int, scored: dict) -> None:
        """Adds (similarity, start, end, distance) of the windows that match an item of this size, by item."""
        low = int(start[0])
        here = grams[low : int(start[-1]) + length]
        weight = self.weight(here)
        sums = np.zeros((len(here) + 1, 64), np.int64)
        np.cumsum(_bits(here) * weight[:, None], axis=0, out=sums[1:])
        mass = np.concatenate([[0], np.cumsum(weight)])
        begin = start - low
        prints = _fingerprints(sums[begin + length] - sums[begin])
        for row, item in zip(*(x.tolist() for x in self.near(prints, size)), strict=True):
            a = int(begin[row])
            score = self.similarity(here[a : a + length], int(mass[a + length] - mass[a]), item)
            if score >= SIMILARITY:
                scored.setdefault(item, []).append((score, low + a, low + a + length, int(np.bitwise_count(prints[row] ^ self.prints[item]))))


def _index(items: list[tuple[int, str]]) -> list[Items]:
    """One index for each shingle size: SIZE, or less for items of fewer words."""
    hashes, by_size = WordHashes(), {}
    for item_id, text in items:
        words = hashes.of(normal(text or ""))
        if len(words):
            ids, grams = by_size.setdefault(min(SIZE, len(words)), ([], []))
            ids.append(item_id)
            grams.append(shingles(words, SIZE))
    return [Items(ids, grams, size) for size, (ids, grams) in sorted(by_size.items())]


def _found(texts: list[str | None], hashes: WordHashes, indexes: list[Items]) -> list[tuple[int, int, int, int, float, int]]:
    """(text, item_id, first word, last word, similarity, distance) of all matches in some texts."""
    words = [hashes.of(normal(t)) if t else np.empty(0, np.uint64) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat, rows = np.concatenate(words), []
    for index in indexes:
        if len(flat) < index.size:
            continue
        grams = shingles(flat, index.size)
        seeds, names = index.seeds(grams)
        doc = np.searchsorted(ends, seeds, side="right")
        inside = seeds + index.size <= ends[doc]
        seeds, names, doc = seeds[inside], names[inside], doc[inside]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for at, name in zip(np.split(seeds, cuts), np.split(names, cuts), strict=True) if len(seeds) else ():
            d = int(np.searchsorted(ends, at[0], side="right"))
            begin = int(ends[d]) - len(words[d])
            own = grams[begin : int(ends[d]) - index.size + 1]
            for i, a, b, score, distance in index.matches(own, at - begin, name):
                rows.append((d, index.ids[i], a, b + index.size - 1, score, distance))
    return rows


def _spans(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Matches of a bounded number of items, which travel with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, indexes = WordHashes(), _index(items)
        for chunk in text_chunks(batches):
            texts = chunk.column("text").to_pylist()
            rows = _found(texts, hashes, indexes)
            if not rows:
                continue
            spans = {d: [m.span() for m in _WORD.finditer(texts[d]) if normal(m[0])] for d in {r[0] for r in rows}}
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id").take(pa.array([r[0] for r in rows])),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([spans[r[0]][r[2]][0] for r in rows], pa.int64()),
                    pa.array([spans[r[0]][r[3]][1] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.float64()),
                    pa.array([r[5] for r in rows], pa.int32()),
                ],
                ["doc_id", "item_id", "start", "end", "similarity", "distance"],
            )

    columns = "doc_id long, item_id long, start long, end long, similarity double, distance int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns)


def _without(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Rows that match none of a bounded number of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, indexes = WordHashes(), _index(items)
        for chunk in text_chunks(batches):
            bad = {r[0] for r in _found(chunk.column("text").to_pylist(), hashes, indexes)}
            yield chunk.filter(pa.array([i not in bad for i in range(chunk.num_rows)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with a text in parts of a bounded expected size, one after another."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    n, words = items.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()
    parts = max(1, math.ceil(n / ITEMS_A_PASS), math.ceil(words / WORDS_A_PASS))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text")
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def _groups(benchmark: DataFrame) -> Iterator[tuple[list[list[tuple[int, str]]], dict[int, np.ndarray]]]:
    """Passes that share a first look at the documents, with the hashes of all their items' shingles by size."""
    passes, grams, n = [], {}, 0
    for items in _passes(benchmark):
        passes.append(items)
        hashes = WordHashes()
        for _, text in items:
            words = hashes.of(normal(text or ""))
            if len(words):
                own = np.unique(shingles(words, SIZE))
                grams.setdefault(min(SIZE, len(words)), []).append(own)
                n += len(own)
        if n >= LOOK_SHINGLES:
            yield passes, {size: np.unique(np.concatenate(g)) for size, g in grams.items()}
            passes, grams, n = [], {}, 0
    if passes:
        yield passes, {size: np.unique(np.concatenate(g)) for size, g in grams.items()}


def _looked(docs: DataFrame, grams: dict[int, np.ndarray], near: bool) -> DataFrame:
    """The rows that share a shingle with an item, which alone can match, or those that share none."""
    sent = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            words = [hashes.of(normal(t)) if t else np.empty(0, np.uint64) for t in chunk.column("text").to_pylist()]
            ends, flat = np.cumsum([len(w) for w in words]), np.concatenate(words)
            shares = np.zeros(chunk.num_rows, bool)
            for size, known in sent.value.items():
                if len(flat) >= size:
                    own = shingles(flat, size)
                    seeds = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
                    doc = np.searchsorted(ends, seeds, side="right")
                    shares[doc[seeds + size <= ends[doc]]] = True
            yield chunk.filter(pa.array(shares == near))

    return map_arrow(docs, run, docs.schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, similarity, distance): windows of ``docs`` that hold a benchmark item.

    start and end are code points of what the window shares with the item, from its first shingle to its last,
    end exclusive; distance is that of the fingerprints. A window
    has as many words as its item. Of overlapping windows of one item the most similar stays, then the first.
    Null and empty texts match nothing; repeated documents and items match alike; a document shorter than an
    item is compared whole. Items are taken in passes of at most ITEMS_A_PASS expected items, so that what a
    task holds is bounded however many there are; where there are several, one look at all documents leaves them
    those that share a shingle with an item. An empty benchmark gives an empty result.
    """
    found = []
    for passes, grams in _groups(benchmark):
        near = docs.select("doc_id", "text")
        near = near if len(passes) == 1 else stored(_looked(near, grams, True))
        found += [_spans(near, items) for items in passes]
    return reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item, columns unchanged. Rows go where they lie, without a shuffle.

    Where items take several passes, only rows that share a shingle with an item go through them.
    """
    for passes, grams in _groups(benchmark):
        near = docs if len(passes) == 1 else stored(_looked(docs, grams, True))
        kept = reduce(_without, passes, near)
        docs = kept if len(passes) == 1 else _looked(docs, grams, False).union(kept)
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
