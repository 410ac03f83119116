"""Ranked lexical search: exact inner products of sparse integer vectors through ball trees.

A document's vector holds, for each term that some item of the pass asks for, the term's weight times its damped
frequency; an item's vector holds how often it says a term; the score is their inner product. Tasks pack documents
into shards and build a tree over each: rows are split at the middle of their projection on the line between two
that lie far apart. A node keeps its centroid and its radius, of all terms and of each of many groups of terms, and
bounds an item's score by centroid and radius, rounded upwards. Subtrees are opened best bound first until no bound
reaches the score to beat; leaves are scored in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_chunks, utf8

#: Distinct terms of the items that one pass over the documents takes, unless one item has more; and those that one tree takes.
PASS_TERMS, TREE_TERMS = 200_000, 16_384
#: Documents of a shard, cells of a shard unless one document has more, and documents of a leaf at most.
SHARD_ROWS, SHARD_CELLS, LEAF_ROWS = 8192, 1 << 20, 32
#: Groups of terms that have a radius of their own.
GROUPS = 2048
#: Bounds are raised by this share; rounding of a sum of n positive doubles loses less than n / 2**52.
SAFE = 1 + 1e-9
_NO_ID = np.iinfo(np.int64).max
#: Characters that are no part of a term become blanks, capital letters small ones.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and all that is not ASCII; A-Z as a-z."""
    return text.translate(_TERMS).split()


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


class Tree:
    """A balanced ball tree over rows of non-negative whole cells."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, columns: np.ndarray, cells: np.ndarray, width: int):
        """Row i has ``cells`` at ``columns`` below ``width``, from ends[i - 1] to ends[i]."""
        n = len(ids)
        depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF_ROWS)))
        starts = ends - np.diff(ends, prepend=0)
        order = np.arange(n)
        for level in range(depth):
            order = self._split(order, level, starts, ends, columns, cells, width)
        lengths = (ends - starts)[order]
        self.ids, self.ends = ids[order], np.append(0, np.cumsum(lengths))
        at = np.arange(self.ends[-1]) + np.repeat(starts[order] - self.ends[:-1], lengths)
        self.columns, self.cells = columns[at], cells[at]
        self.levels = sorted({depth, *range(2, depth, 3)})  # levels whose nodes have bounds; the leaves are the last
        self.cuts = {level: n * np.arange((1 << level) + 1) // (1 << level) for level in self.levels}
        self.group = np.arange(width) * min(GROUPS, width) // max(width, 1)
        self.first = np.flatnonzero(np.diff(self.group, prepend=-1))
        self.centre, self.radius, self.whole = {}, {}, {}
        for level in self.levels:
            self._bound(level, width)

    @staticmethod
    def _split(order, level, starts, ends, columns, cells, width):
        """The rows of each node of a level ordered by their projection on the line between two far ones."""
        nodes, n = 1 << level, len(order)
        cuts = n * np.arange(nodes + 1) // nodes
        node = np.repeat(np.arange(nodes), np.diff(cuts))
        lengths = (ends - starts)[order]
        row = np.repeat(np.arange(n), lengths)
        at = np.arange(len(row)) + np.repeat(starts[order] - (np.cumsum(lengths) - lengths), lengths)
        column, cell = columns[at], cells[at].astype(float)
        place = node[row] * width + column
        norms = np.bincount(row, cell * cell, n)

        def far(points):
            away = norms - 2 * np.bincount(row, cell * points.ravel()[place], n)
            return np.array([a + np.argmax(away[a:b]) if b > a else a for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

        def rows_at(chosen):
            out = np.zeros((nodes, width))
            held = np.isin(row, chosen)
            out[node[row[held]], column[held]] = cell[held]
            return out

        centre = np.bincount(place, cell, nodes * width).reshape(nodes, width) / np.maximum(np.diff(cuts), 1)[:, None]
        one = rows_at(far(centre))
        line = one - rows_at(far(one))
        return order[np.lexsort((np.bincount(row, cell * line.ravel()[place], n), node))]

    def _bound(self, level: int, width: int) -> None:
        """Centroids, and radii of all terms and of the groups, of a level's nodes."""
        cuts = self.cuts[level]
        nodes = len(cuts) - 1
        centre, radius, whole = np.zeros((nodes, width)), np.zeros((nodes, len(self.first))), np.zeros(nodes)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                continue
            at = slice(self.ends[a], self.ends[b])
            column, cell = self.columns[at], self.cells[at].astype(float)
            centre[i] = np.bincount(column, cell, width) / (b - a)
            for c in range(a, b, 64):  # a few dense rows at a time
                d = min(c + 64, b)
                at = slice(self.ends[c], self.ends[d])
                dense = np.zeros((d - c, width))
                dense[np.repeat(np.arange(d - c), np.diff(self.ends[c : d + 1])), self.columns[at]] = self.cells[at]
                square = np.add.reduceat((dense - centre[i]) ** 2, self.first, axis=1) if width else np.zeros((d - c, 0))
                radius[i] = np.maximum(radius[i], square.max(axis=0))
                whole[i] = max(whole[i], square.sum(axis=1).max(initial=0))
        self.centre[level], self.radius[level], self.whole[level] = centre, np.sqrt(radius), np.sqrt(whole)

    def search(self, columns: np.ndarray, counts: np.ndarray, k: int, beat: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of rows that may be among the k best: all that are, of ``beat`` or more; and how many leaves were scored."""
        group, of = np.unique(self.group[columns], return_inverse=True)
        share, norm = np.sqrt(np.bincount(of, counts.astype(float) ** 2, len(group))), math.sqrt(float((counts.astype(float) ** 2).sum()))
        asked = np.zeros(len(self.group), np.int64)
        asked[columns] = counts
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        heap: list[tuple[float, int, int]] = []
        leaves = 0

        def open_(step: int, a: int, b: int) -> None:
            level = self.levels[step]
            inner = self.centre[level][a:b, columns] @ counts
            reach = np.minimum(self.radius[level][a:b, group] @ share, self.whole[level][a:b] * norm)
            for i, top in enumerate((inner + reach) * SAFE, a):
                if top >= beat:
                    heapq.heappush(heap, (-top, step, i))

        open_(0, 0, 1 << self.levels[0])
        while heap:
            top, step, i = heapq.heappop(heap)
            if -top < beat:
                break
            if step + 1 < len(self.levels):
                wider = self.levels[step + 1] - self.levels[step]
                open_(step + 1, i << wider, (i + 1) << wider)
                continue
            leaves += 1
            a, b = self.cuts[self.levels[-1]][i : i + 2]
            at = slice(self.ends[a], self.ends[b])
            total = np.append(0, np.cumsum(self.cells[at] * asked[self.columns[at]]))
            found = np.diff(total[self.ends[a : b + 1] - self.ends[a]])
            fit = found >= beat
            if fit.any():
                ids, scores = np.append(ids, self.ids[a:b][fit]), np.append(scores, found[fit])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    beat = max(beat, int(scores.min()))
        return ids, scores, leaves


class Pass:
    """Items of one pass: their terms by number, and the items in groups that share a tree."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        said = [(item, Counter(terms((text or "").encode("utf-8", "replace")))) for item, text in items]
        self.terms = {t: i for i, t in enumerate(sorted({t for _, c in said for t in c}))}
        self.items = [(item, np.array([self.terms[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for item, c in said if c]
        self.groups: list[tuple[np.ndarray, list[int]]] = []
        held: set[int] = set()
        members: list[int] = []
        for i, (_, own, _) in enumerate(self.items):
            if members and len(held | set(own.tolist())) > TREE_TERMS:
                self.groups.append((np.array(sorted(held)), members))
                held, members = set(), []
            held |= set(own.tolist())
            members.append(i)
        if members:
            self.groups.append((np.array(sorted(held)), members))


def passes(items: DataFrame) -> Iterator[Pass]:
    """Distinct items in passes of PASS_TERMS terms; one pass is held at a time."""
    part: list[tuple[int | None, str | None]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        part.append((row[0], row[1]))
        size += len(set(terms((row[1] or "").encode("utf-8", "replace"))))
        if size >= PASS_TERMS:
            yield Pass(part)
            part, size = [], 0
    if part:
        yield Pass(part)


def vectors(docs: DataFrame, names: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term: all its terms, and those among ``names`` with their frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, width = sent.value.get, max(len(sent.value), 1)
        for chunk in text_chunks(batches):
            split = [terms(t) for t in utf8(chunk)]
            lengths = np.array([len(w) for w in split], np.int64)
            found = np.fromiter((x for w in split for x in map(number, w, repeat(-1))), np.int64, int(lengths.sum()))
            key = np.repeat(np.arange(len(split)), lengths) * width + found
            key, tf = np.unique(key[found >= 0], return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(key // width, minlength=len(split)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (key % width, tf)]
            whole = pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(lengths), *lists], ["doc_id", "n", "terms", "tf"])
            yield whole.filter(pa.array(lengths > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, lengths, words, terms and frequencies of as many documents as a shard takes."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = cells = 0
    for batch in batches:
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy()
        lists = [batch.column(c) for c in ("terms", "tf")]
        ends = lists[0].offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        flat = [x.flatten().to_numpy() for x in lists]
        start = 0
        while start < len(ids):
            stop = int(np.searchsorted(ends, ends[start] + SHARD_CELLS - cells, side="right")) - 1
            stop = min(max(stop, start + (not rows)), start + SHARD_ROWS - rows)
            at = slice(ends[start], ends[min(stop, len(ids))])
            held.append((ids[start:stop], np.diff(ends[start : min(stop, len(ids)) + 1]), n[start:stop], flat[0][at], flat[1][at]))
            rows, cells, start = rows + stop - start, cells + at.stop - at.start, stop
            if start < len(ids):
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, rows, cells = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _ranked(held: DataFrame, asked: Pass, k: int) -> DataFrame:
    """(item, item_id, doc_id, score) of what may be among the k best documents of each item of a pass."""
    spark = held.sparkSession
    # One row for all terms of a document, under -1, beside those that are asked for: N, L and every df from one count.
    counted = held.select("n", F.explode(F.concat("terms", F.array(F.lit(-1)))).alias("term"))
    counts = {r.term: (r.df, r.n) for r in counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")).collect()}
    documents, length = counts.get(-1, (0, 0))
    weights = np.array([weight(documents, counts.get(t, (0, 0))[0]) for t in range(len(asked.terms))], np.int64)
    sent = spark.sparkContext.broadcast((asked.items, asked.groups, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, groups, weights = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2 for _ in items]
        for ids, lengths, n, terms_, tf in _shards(batches):
            tf = tf.astype(np.int64)
            m = np.repeat(75 + 25 * n * documents // length, lengths)
            value = weights[terms_] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            row = np.repeat(np.arange(len(ids)), lengths)
            for own, members in groups:
                place = np.full(len(weights), -1)
                place[own] = np.arange(len(own))
                column = place[terms_]
                fit = (column >= 0) & (value > 0)
                rows, back = np.unique(row[fit], return_inverse=True)  # rows without a cell score 0
                if not len(rows):
                    continue
                tree = Tree(ids[rows], np.cumsum(np.bincount(back)), column[fit], value[fit], len(own))
                for i in members:
                    before, scores = best[i]
                    beat = int(scores.min()) if len(scores) == k else 1
                    more, found, _ = tree.search(place[items[i][1]], items[i][2], k, beat)
                    both = np.append(before, more), np.append(scores, found)
                    order = np.lexsort((both[0], -both[1]))[:k]
                    best[i] = both[0][order], both[1][order]
        item = np.repeat(np.arange(len(items)), [len(x) for x, _ in best])
        ids, scores = (np.concatenate([b[c] for b in best]) if best else np.empty(0, np.int64) for c in (0, 1))
        names = pa.array([x for x, _, _ in items], pa.int64()).take(pa.array(item, pa.int64()))
        columns = [pa.array(item, pa.int64()), names, pa.array(ids, mask=ids == _NO_ID), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return held.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k documents of greatest score above 0 for each item: (item_id, rank, doc_id, score).

    ``docs`` has doc_id and text, ``items`` item_id and text. Null and empty texts have no terms: such documents are not
    counted and such items find nothing. Equal scores go by doc_id, a null one last. Each row of ``docs`` is a document;
    equal rows of ``items`` count once, and different texts of one item_id are ranked each for itself. Items travel
    with the tasks in passes of PASS_TERMS terms; more make more passes.
    """
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = [_ranked(stored(vectors(docs, asked.terms)), asked, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) for asked in passes(items)]
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, [x.select("item_id", "rank", "doc_id", "score") for x in out])


OP12_SQL = r"""with d as (select row_number() over () as r, doc_id, text from documents),
t as (select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
i as (select distinct item_id, text from benchmark),
a as (select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from i),
q as (select item_id, text, term, count(*) as times from a group by all),
s as (select count(distinct r) as docs, count(*) as len from t),
n as (select r, doc_id, 75 + (25 * count(*) * (select docs from s)) // (select len from s) as m from t group by all),
f as (select r, term, count(*) as tf from t where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * (select docs from s) + 2) / (2 * count(*) + 1))) as bigint) as w from f group by term),
p as (select item_id, text, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as score
    from q join f using (term) join w using (term) join n using (r) group by all),
o as (select item_id, row_number() over (partition by item_id, text order by score desc, doc_id nulls last, r) as rank, doc_id, score from p where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from o where rank <= 20"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of greatest score for each benchmark item, over all documents: (item_id, rank, doc_id, score)."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
