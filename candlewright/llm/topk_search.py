"""Exact top-k search by inner product: MaxScore over shards of sparse integer vectors.

Rows are packed into shards, queries into packs, and each shard meets each pack. A shard keeps a posting list
for each term with its greatest and least value, so that a query's terms have score bounds. Terms whose bounds
together stay below the score to beat are non-essential: only postings of the others are traversed, and what they
find is completed from the non-essential ones, greatest bound first, while it can still compete. The score to beat
starts from a few rows of the shard, or from what the task has found for the query in shards before. Each task
emits its best rows for a query once; a ranked window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, table

#: Rows in a shard and queries in a pack, in expectation, and cells (terms of rows) that a shard holds unless one row has more.
SHARD_ROWS, PACK_QUERIES, SHARD_CELLS = 8192, 1024, 1 << 19
#: Packed queries of so many bytes in all are sent to every task; more are shuffled with the shards.
BROADCAST_BYTES = 64 << 20
#: Rows of a shard that are scored first for a score to beat.
SEEDS = 128
_NO_ID = np.iinfo(np.int64).max


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as whole doubles; null where the vector or a component is null, or one is not finite."""
    whole = F.transform(vector, lambda x: F.call_function("floor", x.cast("double") * scale).cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, whole)


class Shard:
    """Posting lists over some rows: for each term its rows, their values, and the extremes of these."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray):
        """Row i has ``terms`` and ``values`` from ends[i - 1] to ends[i], each term at most once."""
        self.ids, self.n = ids, len(ids)
        row = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))
        held = values != 0
        row, terms, values = row[held], terms[held], values[held]
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        self.rows, self.values = row[order], values[order]
        if len(self.terms):
            self.greatest = np.maximum.reduceat(self.values, starts)
            self.least = np.minimum.reduceat(self.values, starts)
        else:
            self.greatest = self.least = self.values
        sample = np.unique(np.linspace(0, self.n - 1, min(SEEDS, self.n)).astype(np.int64))
        place = np.full(self.n, -1)
        place[sample] = np.arange(len(sample))
        found = place[row] >= 0
        self.seeds, self.seed_of = sample, place[row[found]]
        self.seed_term, self.seed_value = np.searchsorted(self.terms, terms[found]), values[found]

    def posting(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.bounds[t], self.bounds[t + 1])
        return self.rows[at], self.values[at]

    def _seeded(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of the seed rows."""
        dense = np.zeros(len(self.terms), weights.dtype)
        dense[at] = weights
        out = np.zeros(len(self.seeds), weights.dtype)
        np.add.at(out, self.seed_of, self.seed_value * dense[self.seed_term])
        return out

    def _add(self, t: int, weight, rows: np.ndarray, scores: np.ndarray) -> None:
        """Adds a term's share to the scores of some rows, which rise."""
        holders, values = self.posting(t)
        if len(holders) == self.n:
            scores += weight * values[rows]
        else:
            place = np.minimum(np.searchsorted(holders, rows), len(holders) - 1)
            scores += np.where(holders[place] == rows, weight * values[place], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None, beat: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best scores that are at least ``beat``, and these scores; ties go to the smaller id.

        Rows with the id ``but`` take no part. Rows without a term in common score 0 and take part as well.
        """
        known = np.isin(terms, self.terms)
        at, weights = np.searchsorted(self.terms, terms[known]), weights[known]
        bound = np.maximum(np.maximum(weights * self.greatest[at], weights * self.least[at]), 0)
        order = np.argsort(-bound, kind="stable")
        at, weights, bound = at[order], weights[order], bound[order]
        allowed = np.ones(self.n, bool) if but is None else self.ids != but
        if beat == -np.inf:
            beat = self._kth(self._seeded(at, weights)[allowed[self.seeds]], k)
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # rest[i]: bound of the terms from i on
        first = int(np.searchsorted(-rest, -beat, side="right")) if beat > 0 else len(at)
        first = min(first, len(at))  # terms before it are essential: those from it on stay below what is to be beaten
        scores = np.zeros(self.n, self.values.dtype)
        for t, w in zip(at[:first], weights[:first], strict=True):
            rows, values = self.posting(t)
            if len(rows) == self.n:
                scores += w * values
            else:
                scores[rows] += w * values
        rows = np.flatnonzero(allowed & (scores + rest[first] >= beat))
        scores = scores[rows]
        if first < len(at) and len(rows) > 8 * k:
            best = np.sort(np.argpartition(-scores, 4 * k)[: 4 * k])
            some, full = rows[best], scores[best].copy()
            for t, w in zip(at[first:], weights[first:], strict=True):
                self._add(t, w, some, full)
            beat = max(beat, self._kth(full, k))
        for i in range(first, len(at)):
            fit = scores + rest[i] >= beat
            if not fit.all():
                rows, scores = rows[fit], scores[fit]
            self._add(at[i], weights[i], rows, scores)
        return self._best(rows, scores, k)

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> float:
        return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > k:
            fit = scores >= self._kth(scores, k)
            rows, scores = rows[fit], scores[fit]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


_PACKED = ("ids", "lengths", "terms", "vals")


def _columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Ids, lengths, terms and values of rows (id, terms, vals); a null id as the greatest number."""
    ids = batch.column("id").fill_null(_NO_ID).to_numpy()
    lengths = pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64)
    return [ids, lengths, *(pc.list_flatten(batch.column(c)).to_numpy() for c in ("terms", "vals"))]


def _row(parts: list[list[np.ndarray]], **more) -> pa.RecordBatch:
    columns = {c: pa.array([np.concatenate(x).tobytes()], pa.binary()) for c, x in zip(_PACKED, zip(*parts, strict=True), strict=True)}
    return pa.RecordBatch.from_pydict({c: pa.array([v]) for c, v in more.items()} | columns)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that each hold as many of (id, terms, vals) as a shard takes."""
    held: list[list[np.ndarray]] = []
    rows = cells = 0
    for batch in batches:
        ids, lengths, terms, values = _columns(pa.Table.from_batches([batch]))
        ends, start = np.append(0, np.cumsum(lengths)), 0
        while start < len(ids):
            stop = int(np.searchsorted(ends, ends[start] + SHARD_CELLS - cells, side="right")) - 1
            stop = min(max(stop, start + (not rows)), start + SHARD_ROWS - rows)
            at = slice(ends[start], ends[min(stop, len(ids))])
            held.append([ids[start:stop], lengths[start:stop], terms[at], values[at]])
            rows, cells, start = rows + stop - start, cells + at.stop - at.start, stop
            if start < len(ids):
                yield _row(held)
                held, rows, cells = [], 0, 0
    if held:
        yield _row(held)


def _opened(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, ...]:
    """Ids, ends, terms and values of row i."""
    ids, lengths, terms, values = (np.frombuffer(batch.column(prefix + c)[i].as_buffer(), t) for c, t in zip(_PACKED, "qqqd", strict=True))
    return ids, np.cumsum(lengths), terms, values


def _exact(shard_values: np.ndarray, query_values: np.ndarray, cells: int) -> type:
    """The type in which all sums of products are exact: doubles below 2**53, else longs below 2**63."""
    most = float(np.abs(shard_values).max(initial=0)) * float(np.abs(query_values).max(initial=0)) * max(cells, 1)
    if most < 2**53:
        return np.float64
    if most < 2**62:
        return np.int64
    raise OverflowError(f"scores may reach {most:.3g}, which a long cannot hold")


class Best:
    """The k best rows of each query of a pack so far, best first."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.rows: list[list[tuple[float, int]]] = [[] for _ in ids]

    def beat(self, j: int) -> float:
        return -self.rows[j][-1][0] if len(self.rows[j]) == self.k else -np.inf

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.rows[j] = sorted([*self.rows[j], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]

    def emitted(self) -> pa.RecordBatch:
        query = np.repeat(self.ids, [len(r) for r in self.rows])
        flat = [x for r in self.rows for x in r]
        ids = pa.array([None if i == _NO_ID else i for _, i in flat], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), ids, pa.array([int(-s) for s, _ in flat], pa.int64())], ["query_id", "id", "score"])


def _searched(k: int, own: bool):
    """Pairs of a shard and a pack to the k best rows of each query, over all the shards that the task meets it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        at: tuple | None = None
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                pack, number = batch.column("pack")[i].as_py(), batch.column("shard")[i].as_py()
                q_ids, q_ends, q_terms, q_values = _opened(batch, i, "q_")
                ids, ends, terms, values = _opened(batch, i, "")
                kind = _exact(values, q_values, int(np.diff(q_ends, prepend=0).max(initial=0)))
                if at != (number, kind):
                    shard, at = Shard(ids, ends, terms, values.astype(kind)), (number, kind)
                found = best.setdefault(pack, Best(q_ids.copy(), k))
                for j, query in enumerate(q_ids):
                    of = slice(q_ends[j - 1] if j else 0, q_ends[j])
                    rows, scores = shard.search(q_terms[of], q_values[of].astype(kind), k, None if own else query, found.beat(j))
                    found.add(j, shard.ids[rows], scores)
        for found in best.values():
            yield found.emitted()

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, own: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k rows of greatest inner product with each query: (query_id, rank, id, score), ties to the smaller id.

    ``rows`` and ``queries`` are (id long, terms array<long>, vals array<double>): terms of a row at most once, values
    whole numbers; a term that is absent counts 0. Every row of ``rows`` can be found, repeated ones as often as they
    stand there, a null id last among equal scores; with ``own`` false those of the query's id are left out. Equal
    queries count once, different ones of one id share one list, and those without an id are left out. Scores that a
    long cannot hold raise an OverflowError in the task.
    """
    queries = queries.where("id is not null").distinct()
    n, cells = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    parts = 1 + n // PACK_QUERIES
    keyed = queries.withColumn("pack", F.pmod(F.xxhash64("id", "vals"), F.lit(parts)))

    def pack(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row([_columns(group)], pack=group.column("pack")[0].as_py())])

    schema = ", ".join(f"{c} binary" for c in _PACKED)
    packs = keyed.groupBy("pack").applyInArrow(pack, "pack long, " + schema).select("pack", *(F.col(c).alias("q_" + c) for c in _PACKED))
    shards = rows.select("id", "terms", "vals").mapInArrow(_shards, schema).withColumn("shard", F.monotonically_increasing_id())
    met = shards.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    small = 16 * (cells + n) <= broadcast_bytes
    pairs = met.join(F.broadcast(packs) if small else packs.hint("merge"), "pack")
    found = pairs.mapInArrow(_searched(k, own), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def dense(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, terms, vals) of vectors quantized to whole numbers, a term for each component; without those that take no part."""
    whole = vectors.select(named(vec_id).cast("long").alias("id"), quantized(named(vector), scale).alias("vals")).where("vals is not null")
    place = F.when(F.size("vals") > 0, F.sequence(F.lit(0), F.size("vals") - 1).cast("array<long>")).otherwise(F.array().cast("array<long>"))
    return whole.select("id", place.alias("terms"), "vals")


OP13_SQL = """with e as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from e q join e c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors nearest by inner product to each whose vec_id is divisible by 50: (query_id, rank, vec_id, score).

    Vectors that are null or hold a null or non-finite component take no part; see top_k for repeats and null ids.
    """
    rows = dense(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")
