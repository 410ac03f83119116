"""Language-model scoring by prediction by partial matching over bytes, and a word-count base score.

Training texts are counted over all documents: words for the base, and runs of ORDER + 1 bytes, whose shorter
contexts follow by adding up. No run is left out: runs are dealt out by the three bytes before the last, so that
each task has all followers of its contexts of three bytes and more; shorter contexts, of which there are at
most 2^24 whatever the corpus, travel with the tasks. Prices go back to the chunks of text that asked for them.
A byte's probability comes from the longest context that has seen it; each longer context that was seen without
it passes on its escape probability, the number of its distinct followers over that number plus its total, and
the followers of a longer context are excluded from a shorter one. What a byte costs thus depends on ORDER bytes
before it alone, so that each distinct run of a chunk is priced once. Texts end with a zero byte, which is priced
too; a zero byte inside a text is the same symbol.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fold, mix, stored, table, text_chunks, utf8

#: Bytes of context.
ORDER = 5
#: Bytes of the longest context that travels with the tasks.
LOW = 2
#: Bytes of text whose runs are priced together, and bytes of all texts for each bucket of contexts.
CHUNK = 12 << 20
#: Frequent words that a task holds at most, by 64-bit hashes.
FREQUENT_WORDS = 400_000
#: Distinct words and runs of bytes that a counting task holds before it passes them on.
HELD = 150_000
#: Runs that are packed at once, and that are gathered before they are sorted.
STEP, GATHERED = 1 << 18, 1 << 20


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each byte of the texts and their end with its context, packed high byte first, and the number of its text; in steps."""
    data = np.frombuffer(b"".join(bytes(ORDER) + t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 + ORDER for t in texts])
    for low in range(0, len(data) - ORDER, STEP):
        count = min(STEP, len(data) - ORDER - low)
        one = data[low : low + count + ORDER].astype(np.uint16)
        two = (one[:-1] << 8) | one[1:]
        four = (two[:-2].astype(np.uint32) << 16) | two[2:]
        packed = (four[:-2].astype(np.int64) << 16) | two[4:]
        first, last = np.searchsorted(ends, [low, low + count - 1], side="right")
        cuts = np.clip(ends[first : last + 1], low, low + count)
        own = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate([[low], cuts])))
        inside = np.arange(low, low + count) < ends[own] - ORDER
        yield packed[inside], own[inside]


def _counted(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, and how often each occurs."""
    runs = np.sort(runs)
    first = np.flatnonzero(np.diff(runs, prepend=-1))  # they are 0 or more
    return runs[first], np.diff(np.append(first, len(runs)))


def _merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of two sorted arrays, and the sums of their counts."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    return both[first], np.add.reduceat(np.concatenate([n, m])[order], first) if len(first) else n


class Places:
    """Where each of some distinct 64-bit numbers stands, by open addressing in arrays: cheaper than binary search."""

    def __init__(self, numbers: np.ndarray):
        self.mask = (1 << (2 * len(numbers) + 1).bit_length()) - 1
        self.numbers, self.table = numbers.view(np.uint64), np.full(self.mask + 1, -1, np.int32)
        open_, slot = np.arange(len(numbers), dtype=np.int32), self._slot(self.numbers)
        while len(open_):
            free = self.table[slot] < 0
            self.table[slot[free]] = open_[free]
            left = self.table[slot] != open_
            open_, slot = open_[left], (slot[left] + 1) & self.mask

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, -1 of those that are not there."""
        wanted = wanted.view(np.uint64)
        slot = self._slot(wanted)
        out = self.table[slot]
        if not len(self.numbers):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.numbers[out] != wanted))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = found = self.table[slot[open_]]
            open_ = open_[(found >= 0) & (self.numbers[found] != wanted[open_])]
        return out


def _packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Numbers, or where they rise their differences, compressed byte by byte of their places."""
    plain = np.diff(numbers, prepend=numbers.dtype.type(0)) if rising else numbers
    return pa.compress(np.ascontiguousarray(plain.view(np.uint8).reshape(len(plain), -1).T).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int, kind: type, rising: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, size * width, "zstd", asbytes=True), np.uint8).reshape(width, size)
    plain = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(plain, dtype=kind) if rising else plain


class WordNumbers(WordHashes):
    """The 64-bit hashes of words that Spark's xxhash64 gives."""

    def __init__(self, limit: int = 100_000):
        super().__init__(limit)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, seed=42)
        return value


def _chunked(docs: DataFrame) -> DataFrame:
    """(chunk, n_trains, n_bytes, rows): ``docs`` in chunks of about CHUNK bytes of text, or of one longer text.

    A chunk is cut into rows of about a megabyte, compressed, for large values are hard on memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for part in text_chunks(batches, size=min(CHUNK, 1 << 20)):
            size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and held + size > CHUNK:
                number, held = number + 1, 0
            held += size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            trains = pc.sum(part.column("trains")).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([trains], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()])], ["chunk", "n_trains", "n_bytes", "rows"])

    return docs.mapInArrow(run, "chunk long, n_trains long, n_bytes long, rows binary")


def _bucketed(runs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the runs by bucket, that is by the LOW + 1 bytes before their last, the buckets, and where each starts."""
    bucket = (mix((runs >> 8 & ((1 << 8 * (LOW + 1)) - 1)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, *np.unique(bucket[order], return_index=True)


_COUNTS = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("held_n", pa.int64()), ("n", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("size", pa.int64()), ("runs", pa.binary()), ("times", pa.binary())])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Number and rows, in parts, of each chunk; of a chunk that two tasks read, each gives its own parts."""
    rows = ((number, row) for batch in batches for number, row in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True))
    for number, own in groupby(rows, key=lambda x: x[0]):
        yield number, (part for _, row in own for part in pa.ipc.open_stream(row.as_buffer()))


def _counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """Partial counts of the tasks; n counts training documents, held_n the others.

    Rows (word, held_n, n); rows (gram, n) of runs of LOW + 1 bytes; and rows (chunk, bucket, size, runs, times) with
    the distinct runs of a chunk, those that only other documents have included, as packed numbers.
    """

    def batch(rows: int, **columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _COUNTS], schema=_COUNTS)

    def word_rows(words: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        every = list(words[0].keys() | words[1].keys())
        for low in range(0, len(every), 50_000):
            part = every[low : low + 50_000]
            yield batch(len(part), word=part, held_n=[words[0][w] for w in part], n=[words[1][w] for w in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        words, grams = (Counter(), Counter()), (none, none)
        for number, parts in _opened(batches):
            runs, gathered, size = (none, none), ([], []), 0

            def sort(runs: tuple[np.ndarray, np.ndarray], gathered: tuple[list, list]) -> tuple[np.ndarray, np.ndarray]:
                held, learnt = (_counted(np.concatenate([none, *g])) for g in gathered)
                return _merged(*_merged(*runs, *learnt), held[0], np.zeros(len(held[0]), np.int64))

            for part in parts:
                texts, trains = [t.lower() for t in utf8(part)], part.column("trains").to_pylist()
                for text, own in zip(texts, trains, strict=True):
                    words[own].update(text.split())
                own = np.array(trains, bool)
                for packed, at in _runs(texts):
                    learns = own[at]
                    gathered[0].append(packed[~learns])
                    gathered[1].append(packed[learns])
                    size += len(packed)
                    if size > GATHERED:
                        runs, gathered, size = sort(runs, gathered), ([], []), 0
                if len(words[0]) + len(words[1]) > HELD:
                    yield from word_rows(words)
                    words = (Counter(), Counter())
            runs = sort(runs, gathered)
            learnt = runs[1] > 0
            low_runs = runs[0][learnt] & ((1 << 8 * (LOW + 1)) - 1)
            by_low = np.argsort(low_runs, kind="stable")
            grams = _merged(*grams, low_runs[by_low], runs[1][learnt][by_low])
            order, names, starts = _bucketed(runs[0], buckets)
            cut = [np.split(c[order].astype(t), starts[1:]) for c, t in zip(runs, (np.int64, np.uint32), strict=True)]
            for low in range(0, len(names), 256):
                at = slice(low, low + 256)
                yield batch(
                    len(names[at]), chunk=np.full(len(names[at]), number), bucket=names[at], size=[len(c) for c in cut[0][at]],
                    runs=[_packed(c, True) for c in cut[0][at]], times=[_packed(c) for c in cut[1][at]],
                )
            del runs, gathered, learnt, low_runs, by_low, order, cut
            pa.default_memory_pool().release_unused()
            if len(grams[0]) > 2 * HELD:
                yield batch(len(grams[0]), gram=grams[0], n=grams[1])
                grams = (none, none)
        yield from word_rows(words)
        yield batch(len(grams[0]), gram=grams[0], n=grams[1])

    return chunks.select("chunk", "rows").mapInArrow(run, "word binary, gram long, held_n long, n long, chunk long, bucket long, size long, runs binary, times binary")


def _at_most(counted: DataFrame, column: str, limit: int) -> int:
    """The least count such that at most ``limit`` rows have it or more, to a 16th of a power of two.

    The histogram has a row for each such step, so it is small whatever the table.
    """
    step = F.floor(F.log2(column) * 16).cast("int")
    total, least = 0, 1
    for row in sorted(counted.where(F.col(column) > 0).groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > limit:
            return math.floor(2 ** ((row["step"] + 1) / 16)) + 1
        least = max(1, math.ceil(2 ** (row["step"] / 16)))
    return least


class Trie:
    """Contexts of ``order`` bytes and less in sorted arrays, with what each adds to the log probability.

    With ``low``, the contexts that it has are its, and longer ones are learnt from the runs.

    Every follower of a context is one of its shorter contexts' too, so an escape excludes just the
    followers of the context it leaves.
    """

    def __init__(self, runs: np.ndarray, n: np.ndarray, least: int = 1, order: int = ORDER, low: Trie | None = None):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = list(low.grams) if low else []
        self.contexts = list(low.contexts) if low else []
        known = len(self.grams)
        self.grams += [()] * (order + 1 - known)
        for k in range(order, known - 1, -1):
            keep = n >= least
            self.grams[k] = runs[keep], n[keep].astype(np.float64)
            if k > known:
                runs, where = np.unique(runs & ((1 << 8 * k) - 1), return_inverse=True)
                n = np.bincount(where, n, len(runs))
        for k in range(known, order + 1):
            keys, count = self.grams[k]
            context, where = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(where, count, len(context))
            kinds = np.bincount(where, minlength=len(context)).astype(np.float64)
            excluded = np.zeros(len(context))
            if k:
                # What the followers of this context weigh in the context one byte shorter.
                low_keys, low_count = self.grams[k - 1]
                at = np.searchsorted(low_keys, keys & ((1 << 8 * k) - 1))
                excluded = np.bincount(where, low_count[at], len(context))
            self.contexts.append((context, total, kinds, excluded))

    @staticmethod
    def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(sorted_) == 0:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
        return at, sorted_[at] == wanted

    def log10(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run, given the bytes before."""
        out, open_ = np.zeros(len(runs)), np.arange(len(runs))
        above = np.full(len(runs), -1)  # the context just left, by its place in the order above
        for order in range(len(self.grams) - 1, -1, -1):
            if not len(open_):
                break
            key = runs[open_] & ((1 << 8 * (order + 1)) - 1)
            context, total, kinds, _ = self.contexts[order]
            c, seen = self._find(context, key >> 8)
            g, hit = self._find(self.grams[order][0], key)
            n, d = (total[c], kinds[c]) if len(context) else (np.zeros(len(c)), np.zeros(len(c)))
            left = above[open_] >= 0
            if left.any():
                _, _, up_kinds, up_excluded = self.contexts[order + 1]
                u = above[open_][left]
                n, d = n.copy(), d.copy()
                n[left] -= up_excluded[u]
                d[left] -= up_kinds[u]
            whole = np.maximum(n + d, 1e-12)
            hit &= seen
            out[open_[hit]] += np.log10(self.grams[order][1][g[hit]] / whole[hit]) if hit.any() else 0
            escapes = seen & ~hit & (d > 0)
            out[open_[escapes]] += np.log10(d[escapes] / whole[escapes])
            above[open_] = np.where(seen, c, -1)
            open_ = open_[~hit]
        if len(open_):
            kinds = self.contexts[0][2]
            out[open_] -= math.log10(256 - (kinds[0] if len(kinds) else 0))
        return out


def learn(chunks: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all words, (word, n, every) in training and in all documents, and the prices of all runs.

    Prices are (chunk, size, runs, prices): log10 probabilities of the last bytes of a chunk's distinct runs, to seven
    digits. Counts cover all documents, however rare a run is.
    """
    partial = stored(_counts(chunks, buckets))
    words = stored(partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") + F.col("held_n")).alias("every")))
    got = partial.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(got.column("gram").to_numpy())
    low = chunks.sparkSession.sparkContext.broadcast(Trie(got.column("gram").to_numpy()[order], got.column("n").to_numpy()[order], order=LOW))

    def price(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_pylist()
        runs, times = (np.concatenate([_unpacked(b, k, t, t is np.int64) for b, k in zip(group.column(c).to_pylist(), sizes, strict=True)]) for c, t in (("runs", np.int64), ("times", np.uint32)))
        runs, where = np.unique(runs, return_inverse=True)
        n = np.bincount(where, times, len(runs)).astype(np.int64)
        prices = Trie(runs[n > 0], n[n > 0], low=low.value).log10(runs)[where].astype(np.float32)
        cut = np.split(prices, np.cumsum(sizes)[:-1])
        return group.select(["chunk", "size", "runs"]).append_column("prices", pa.array([_packed(c) for c in cut], pa.binary()))

    asked = partial.where("runs is not null").select("bucket", "chunk", "size", "runs", "times")
    return words, asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(price, "chunk long, size long, runs binary, prices binary")


_SCORED = "chunk long, i long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,times:long>>"


def _scored(chunks: DataFrame, prices: DataFrame, buckets: int, frequent: Broadcast) -> DataFrame:
    """A row for each text: its place, tokens, what its frequent words add to the base, its score, and its other words."""

    def rows(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        words_, known, price_of = frequent.value
        number, at, hashes = left.column("chunk")[0].as_py(), 0, WordNumbers()
        sizes = right.column("size").to_pylist()
        price = np.concatenate([_unpacked(p, k, np.float32) for p, k in zip(right.column("prices").to_pylist(), sizes, strict=True)])
        runs = Places(np.concatenate([_unpacked(p, k, np.int64, True) for p, k in zip(right.column("runs").to_pylist(), sizes, strict=True)]))
        for part in (part for _, parts in _opened(left.to_batches()) for part in parts):
            texts, size = [t.lower() for t in utf8(part)], part.num_rows
            scores = np.zeros(size)
            for packed, own in _runs(texts):
                scores += np.bincount(own, price[runs.of(packed)], size)
            split = [t.split() for t in texts]
            own = np.repeat(np.arange(size), [len(w) for w in split])
            words = [w for ws in split for w in ws]
            place = words_.of(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            hit = place >= 0
            base = np.bincount(own[hit], price_of[place[hit]], size).astype(np.float64)
            seen = np.bincount(own[hit], known[place[hit]], size).astype(np.int64)
            rare = Counter((int(own[k]), words[k]) for k in np.flatnonzero(~hit).tolist())  # in order of the texts
            ends = np.cumsum([0, *np.bincount([i for i, _ in rare] or np.empty(0, int), minlength=size)])
            pairs = pa.StructArray.from_arrays([pa.array([w for _, w in rare], pa.binary()), pa.array(list(rare.values()), pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * size, pa.int64()), pa.array(np.arange(at, at + size)), part.column("doc_id"), pa.array(np.array([len(w) + 1 for w in split], np.int64)),
                 pa.array(seen), pa.array(base), pa.array(scores), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                [f.split()[0] for f in _SCORED.split(", ")],
            )
            at += size

    texts = chunks.select("chunk", "rows").repartition(buckets, "chunk")
    return texts.groupBy("chunk").cogroup(prices.repartition(buckets, "chunk").groupBy("chunk")).applyInArrow(lambda left, right: pa.Table.from_batches(rows(left, right)), _SCORED)


def lm_scores(docs: DataFrame, trains: Column, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    Rows where ``trains`` is true are learnt from. Null texts read as empty: one token, the end. Repeated
    rows are learnt from as often as they occur and scored alike. With nothing to learn from, every byte
    has probability 1/256; an empty table gives an empty result. Frequent words, at most ``frequent_words``, travel
    with the tasks by their hashes; the others, each with few occurrences, are joined by word. A text of any length is
    counted and scored in steps; other columns are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    chunks = stored(_chunked(plain))
    ends, size = chunks.agg(F.coalesce(F.sum("n_trains"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    buckets = 1 + size // CHUNK
    words, prices = learn(chunks, buckets)
    in_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    total, distinct = in_words + ends, kinds + (ends > 0)
    scale = math.log10(total + 0.1 * (distinct + 1))
    least = _at_most(words, "every", frequent_words)
    got = words.where(F.col("every") >= least).select(F.xxhash64("word").alias("name"), "n").toArrow()
    n = got.column("n").to_numpy()
    frequent = spark.sparkContext.broadcast((Places(got.column("name").to_numpy()), (n > 0).astype(np.float32), np.log10(n + 0.1) - scale))
    texts = stored(_scored(chunks, prices, buckets, frequent))
    asked = texts.select("chunk", "i", F.explode("rare").alias("r")).select("chunk", "i", "r.word", "r.times")
    joined = asked.join(words.where(F.col("every") < least).select("word", "n"), "word")
    price = F.col("times") * (F.log10(F.col("n") + 0.1) - scale)
    more = joined.groupBy("chunk", "i").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(price).alias("more"))
    whole = texts.drop("rare").join(more, ["chunk", "i"], "left")
    end_cost = math.log10(ends + 0.1) - scale
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end_cost).alias("base_score"), "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those outside the tenth fold, by the contract of this query."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    scored = lm_scores(docs, ~held)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
