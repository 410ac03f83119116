"""Chosen-path similarity join on word n-grams: all links of Jaccard similarity 0.8 or more, as classes.

Texts with equal sets of five-word windows share one ``sid`` (63 bits of a hash of the set) and are handled
once. Each set is embedded as 128 minima of hash functions. A run starts with all sets in one node; a node
picks one or two of the 128 positions, and a set follows it to the child named by its minimum there, that is,
by a sampled token that the sets of a child share. After four levels small buckets are compared by brute
force. Of large ones each set is held against one of its bucket by their minima; where half of them agree, the
whole bucket is dense. Other large ones are split two levels further; what is still large then holds sets that
are alike and is dense too. What dense buckets connect forms dense groups, whose sets are compared block by
block, all with all, so that a group of any size spreads over many tasks;
what travels to the blocks is how each set differs from one of its group. Runs repeat until a pair at the
threshold has met, in the deepest buckets and over the binomial spread of the 128 minima, with the target
probability. Every candidate pair is verified on its whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, components, mix, shingles, stored, table, text_chunks, utf8

POSITIONS = 128
#: Levels of the first split, and further ones of large buckets.
LEVELS, DEEPER = 4, 2
SMALL = 16
BLOCK = 512
#: Equal minima of sets that may form a dense group. It decides only what is compared where, never a link.
CLOSE = 77
#: Share of the sets whose bucket keys are counted to find hot buckets.
SHARE = 64

_SEEDS = mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64))
_XOR = (_SEEDS[:POSITIONS] >> np.uint64(32)).astype(np.uint32)
_MULTIPLY = (_SEEDS[POSITIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def runs_for(recall: float, similarity: float, levels: int = LEVELS + DEEPER) -> int:
    """Runs after which a pair of this similarity has met with probability ``recall``, in the deepest buckets.

    A node has one child position, or two with probability 1/4; a pair follows each with the share of the
    POSITIONS minima that its sets have in common, which is binomial about the similarity.
    """
    shared = np.arange(POSITIONS + 1) / POSITIONS
    ways = np.array([math.comb(POSITIONS, k) for k in range(POSITIONS + 1)], float)
    weight = ways * similarity ** np.arange(POSITIONS + 1) * (1 - similarity) ** np.arange(POSITIONS, -1, -1)
    lost = np.zeros(POSITIONS + 1)
    for _ in range(levels):
        miss = 1 - shared + shared * lost
        lost = 0.75 * miss + 0.25 * miss * miss
    runs = 1
    while weight @ lost**runs > 1 - recall:
        runs += 1
    return runs


def token_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the windows of five words."""
    return np.unique(shingles(hashes.of(text)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more, in whole numbers."""
    low, high = sorted((len(a), len(b)))
    if 5 * low < 4 * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    x = (tokens >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sid, sketch) of each row; sid and sketch are null where the text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for chunk in text_chunks(batches):
            sids, sketches = [], []
            for text in utf8(chunk):
                tokens = token_set(text, hashes)
                if len(tokens) == 0:
                    sids.append(None)
                    sketches.append(None)
                    continue
                whole = mix(np.bitwise_xor.reduce(mix(tokens), keepdims=True) + mix(np.array([len(tokens)], np.uint64)))
                sids.append(int(whole[0] >> np.uint64(1)))
                sketches.append(_sketch(tokens).tobytes())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("text_hash"), pa.array(sids, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "text_hash", "sid", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, sid long, sketch binary")


def _split(nodes: np.ndarray, rows: np.ndarray, sketches: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children, ``levels`` below, of (node, row); a child's name is a hash of its path."""
    for _ in range(levels):
        drawn = mix(nodes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        first = drawn % np.uint64(POSITIONS)
        twice = np.flatnonzero((drawn >> np.uint64(20)) & np.uint64(3) == 0)
        second = (first[twice] + np.uint64(1) + (drawn[twice] >> np.uint64(32)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
        at = np.concatenate([first, second])
        nodes, rows = np.concatenate([nodes, nodes[twice]]), np.concatenate([rows, rows[twice]])
        token = (at << np.uint64(32)) | sketches[rows, at.astype(np.int64)].astype(np.uint64)
        nodes = mix(nodes * np.uint64(0x9E3779B97F4A7C15) + mix(token))
    return nodes, rows


def _keys(df: DataFrame, runs: int | None, hot: list[int]) -> DataFrame:
    """(key, sid, hot) of the buckets LEVELS below the roots of ``runs`` runs, or DEEPER below column ``key``."""
    known = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, POSITIONS)
                sid = batch.column("sid").to_numpy()
                if runs is None:
                    nodes, rows = batch.column("key").to_numpy().view(np.uint64), np.arange(len(sid))
                else:
                    nodes, rows = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64)), len(sid)), np.tile(np.arange(len(sid)), runs)
                nodes, rows = _split(nodes, rows, sketches, DEEPER if runs is None else LEVELS)
                key = nodes.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid[rows]), pa.array(np.isin(key, known))], ["key", "sid", "hot"])

    return df.mapInArrow(run, "key long, sid long, hot boolean")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: pairs of ids (small, a, b) in buckets of 2 to SMALL rows, else rows (large, key, id).

    At most SMALL rows of an unfinished bucket are held between batches.
    """

    def out(large: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a), pa.array(b)], ["large", "a", "b"])

    def settled(key: np.ndarray, sid: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for size in range(2, SMALL + 1):
            at = starts[sizes == size]
            if len(at):
                i, j = np.triu_indices(size, 1)
                a, b = sid[(at[:, None] + i).ravel()], sid[(at[:, None] + j).ravel()]
                yield out(False, np.minimum(a, b), np.maximum(a, b))
        rows = np.flatnonzero(np.repeat(sizes > SMALL, sizes))
        if len(rows):
            yield out(True, key[rows], sid[rows])

    key, sid, open_key = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        k, s, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid", "hot"))
        direct = hot.astype(bool) if open_key is None else hot.astype(bool) | (k == open_key)
        if direct.any():
            yield out(True, k[direct], s[direct])
            k, s = k[~direct], s[~direct]
        key, sid = np.concatenate([key, k]), np.concatenate([sid, s])
        if len(key) == 0:
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        yield from settled(key[: starts[-1]], sid, starts[:-1], sizes[:-1])
        key, sid = key[starts[-1] :], sid[starts[-1] :]
        if len(key) > SMALL:
            yield out(True, key, sid)
            open_key, key, sid = int(key[0]), key[:0], sid[:0]
    if len(key):
        yield from settled(key, sid, np.array([0]), np.array([len(key)]))


def _buckets(df: DataFrame, runs: int | None, total: int) -> DataFrame:
    """Stored rows of _scan over the buckets of ``df`` (sid, sketch and, below the first levels, key).

    Hot buckets are found on one in SHARE sets: those with over 1/500 of these, so at most 500 times the
    buckets of one set. Their rows need no gathering, and are dealt out by id.
    """
    counted = _keys(df.where(F.pmod("sid", F.lit(SHARE)) == 0), runs, []).groupBy("key").count()
    hot = [r[0] for r in counted.where(F.col("count") > max(32, total // SHARE // 500)).select("key").collect()]
    keys = _keys(df, runs, hot)
    salt = F.when(F.col("hot"), F.pmod("sid", F.lit(4096))).otherwise(0)
    dealt = keys.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key").select("key", "sid", "hot")
    return stored(dealt.mapInArrow(_scan, "large boolean, a long, b long"))


def _close(pairs: DataFrame) -> DataFrame:
    """Of rows (sid, rep, sketch, other), sketches of both: (sid, rep) with CLOSE equal minima or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, POSITIONS) for c in ("sketch", "other"))
            yield batch.select(["sid", "rep"]).filter(pa.array((own == other).sum(axis=1) >= CLOSE))

    return pairs.select("sid", "rep", "sketch", "other").mapInArrow(run, "sid long, rep long")


def _grouped(large: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, sid) of large buckets: edges (a, b) of dense groups, and the rows of the other buckets.

    The set that is in most large buckets stands for those it is in, so that the buckets of near copies have few
    such sets between them. A bucket is dense if half of its sets, and over SMALL, agree with the one that stands
    for it. A set has at most as many pairs as buckets.
    """
    often = large.withColumn("n", F.count("*").over(Window.partitionBy("sid")))
    # Stored before the join, so that Spark can cut a bucket that many sets share.
    reps = stored(often.groupBy("key").agg(F.max(F.struct("n", "sid")).alias("most")).select("key", F.col("most.sid").alias("rep")))
    named = stored(large.join(reps, "key").select("key", "sid", "rep"))
    other = sketches.select(F.col("sid").alias("rep"), F.col("sketch").alias("other"))
    close = stored(_close(named.select("sid", "rep").distinct().join(sketches, "sid").join(other, "rep")).withColumn("close", F.lit(1)))
    agreed = named.join(close, ["sid", "rep"], "left").groupBy("key").agg(F.count("*").alias("n"), F.count("close").alias("k"))
    dense = stored(agreed.where((F.col("k") > SMALL) & (2 * F.col("k") >= F.col("n"))).select("key"))
    edges = stored(named.join(dense, "key", "left_semi").select(F.col("sid").alias("a"), F.col("rep").alias("b")).distinct())
    return edges, stored(named.join(dense, "key", "left_anti").select("key", "sid"))


def _verified(pairs: DataFrame) -> DataFrame:
    """Rows of (a, b, text_a, text_b) that are alike, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), (None, None)
        for chunk in text_chunks(text_chunks(batches, "text_a"), "text_b"):
            keep = []
            for a, x, y in zip(chunk.column("a").to_pylist(), utf8(chunk, "text_a"), utf8(chunk, "text_b"), strict=True):
                if seen[0] != a:
                    seen = (a, token_set(x, hashes))
                keep.append(alike(seen[1], token_set(y, hashes)))
            yield pa.RecordBatch.from_arrays([chunk.column("a"), chunk.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _differences(members: DataFrame) -> DataFrame:
    """Of rows (root, part, sid, copies, text, like): how the set of ``text`` differs from that of ``like``.

    Returns (root, part, sid, copies, size, whole, off): the sizes of the set and of that of ``like``, and the hashes
    that only one of them has, those of ``like`` first, with how many these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), (None, np.empty(0, np.uint64))
        for chunk in text_chunks(text_chunks(batches, "text"), "like"):
            size, whole, lacks, off = [], [], [], []
            for text, like in zip(utf8(chunk), utf8(chunk, "like"), strict=True):
                if seen[0] != like:
                    seen = (like, token_set(like, hashes))
                own = token_set(text, hashes)
                lack, more = np.setdiff1d(seen[1], own, assume_unique=True), np.setdiff1d(own, seen[1], assume_unique=True)
                size.append(len(own))
                whole.append(len(seen[1]))
                lacks.append(len(lack))
                off.append(lack.tobytes() + more.tobytes())
            made = [pa.array(size, pa.int64()), pa.array(whole, pa.int64()), pa.array(lacks, pa.int64()), pa.array(off, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("root", "part", "sid", "copies")), *made], ["root", "part", "sid", "copies", "size", "whole", "lacks", "off"])

    return members.select("root", "part", "sid", "copies", "text", "like").mapInArrow(run, "root long, part int, sid long, copies long, size long, whole long, lacks long, off binary")


def _block(left: pa.Table) -> pa.Table:
    """Links of one pair of blocks: per set the copies it is linked to, and a spanning forest of the links.

    Sets A and B that lack a and b hashes of R and have others besides share |R| - a - b hashes, and those that
    both lack, and those that both have besides.
    """
    order = np.argsort(left.column("sid").to_numpy(), kind="stable")
    sid, part, copies, sizes, lacks = (left.column(c).to_numpy()[order] for c in ("sid", "part", "copies", "size", "lacks"))
    whole, off = int(left.column("whole")[0].as_py()), left.column("off").to_pylist()
    off = [np.frombuffer(off[i], np.uint64) for i in order]
    names, where = np.unique(np.concatenate(off), return_inverse=True)
    owner = np.repeat(np.arange(len(off)), [len(x) for x in off])
    by_name = np.argsort(where, kind="stable")
    where, owner = where[by_name], owner[by_name]
    both = np.zeros((len(off), len(off)), np.float32)
    for low in range(0, len(names), 4096):
        at = slice(*np.searchsorted(where, [low, low + 4096]))
        has = np.zeros((len(off), min(4096, len(names) - low)), np.float32)
        has[owner[at], where[at] - low] = 1
        both += has @ has.T
    shared = whole - lacks[:, None] - lacks[None, :] + both.astype(np.int64)
    linked = 5 * shared >= 4 * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, False)
    if part.min() != part.max():
        linked &= part[:, None] != part[None, :]
    root = np.arange(len(off))
    while True:  # the least index that each can reach
        low = np.minimum(root, np.where(linked, root[None, :], len(off)).min(axis=1))
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    return pa.table({"a": sid, "b": sid[root], "n": (linked * copies[None, :]).sum(axis=1)})


def near_duplicates(docs: DataFrame, recall: float = 0.999999) -> DataFrame:
    """(doc_id, text_hash, sid, root, class_id, n_links) of each row of ``docs`` (doc_id, text).

    root is the same for the rows of a class, and no others; it is null where sid is.
    class_id is the least doc_id of the class, a connected component of the links; n_links counts the other
    rows linked to this one, exact copies included. A text of one to four words is one window. A null or
    empty text has no links, a null sid and its own doc_id as class. Repeated rows are copies of each other.
    A null doc_id takes part; its class is named by the others'. An empty table gives an empty result. Other
    columns of ``docs`` are not looked at.
    """
    sig = stored(signatures(docs))
    sets = stored(sig.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("first")))
    total = sets.count()
    # One sketch for each set: that of its first row. Rows with the same id and text are equal, so any will do.
    first = sets.select("sid", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    same = [sig[c].eqNullSafe(first[c]) for c in ("doc_id", "text_hash")]
    sketches = stored(
        sig.join(first, [sig["sid"] == first["sid"], *same]).select(sig["sid"], "sketch").dropDuplicates(["sid"])
    )
    runs = runs_for(recall, 0.8)
    found = _buckets(sketches, runs, total)
    large = found.where("large").select(F.col("a").alias("key"), F.col("b").alias("sid"))
    edges, mixed = _grouped(large, sketches)
    deeper = _buckets(mixed.join(sketches, "sid"), None, total)
    # Negative names are buckets, others are sets.
    dense = components(
        deeper.where("large").select(F.col("b").alias("a"), (-F.shiftrightunsigned("a", 1) - 1).alias("b")).union(edges)
    ).where("id >= 0")
    dense = stored(dense.withColumnRenamed("id", "sid"))
    in_group = dense.select(F.col("sid").alias("a"), F.col("root").alias("ra")), dense.select(F.col("sid").alias("b"), F.col("root").alias("rb"))
    pairs = stored(
        found.where("not large").union(deeper.where("not large")).select("a", "b").where("a <> b").distinct()
        .join(in_group[0], "a", "left").join(in_group[1], "b", "left")
        .where("ra is null or rb is null or ra <> rb").select("a", "b")
    )
    wanted = stored(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).union(dense.select("sid")).distinct())
    where = wanted.join(first, "sid").select("sid", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    texts = stored(
        plain.join(where, plain["doc_id"].eqNullSafe(where["_id"]) & (plain["text_hash"] == where["_hash"]))
        .select("sid", "text").dropDuplicates(["sid"])
    )
    links = stored(
        _verified(
            pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
        )
    )
    group_size = dense.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"), F.min("sid").alias("like_sid"))
    group_size = stored(group_size.select("root", "m", "like_sid"))
    copies = sets.select("sid", "copies")
    member = dense.join(group_size, "root").join(copies, "sid").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int"))
    # Each member meets one text of its group, once; a copy of that for each part, so that large groups spread.
    like = group_size.join(texts.withColumnsRenamed({"sid": "like_sid", "text": "like"}), "like_sid")
    like = like.select("root", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"), "like")
    apart = stored(_differences(member.join(texts, "sid").join(like, ["root", "part"])))
    paired = apart.join(group_size.select("root", "m"), "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    paired = paired.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    blocks = stored(paired.select("root", "i", "j", *apart.columns[1:]).groupBy("root", "i", "j").applyInArrow(_block, "a long, b long, n long"))
    ends = links.select(F.col("a").alias("sid"), F.col("b").alias("other")).union(links.select(F.col("b").alias("sid"), F.col("a").alias("other")))
    gained = ends.join(copies.withColumnRenamed("sid", "other"), "other").select("sid", F.col("copies").alias("n"))
    gained = gained.union(blocks.select(F.col("a").alias("sid"), "n")).groupBy("sid").agg(F.sum("n").alias("n"))
    classes = components(links.union(blocks.where("a <> b").select("a", "b")))
    labelled = sets.join(classes.withColumnRenamed("id", "sid"), "sid", "left").join(gained, "sid", "left")
    labelled = stored(
        labelled.select("sid", F.coalesce("root", "sid").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("first.doc_id").alias("doc_id"))
    )
    named = stored(labelled.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    known = stored(labelled.join(named, "root").select("sid", "root", "class_id", "n_links"))
    rows = sig.select("doc_id", "text_hash", "sid").join(known, "sid", "left")
    return rows.select("doc_id", "text_hash", "sid", "root", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, recall: float = 0.999999) -> DataFrame:
    """Rows of ``docs`` with one of each class of near-duplicates: that of the least doc_id, then of the least text hash.

    A null doc_id comes last. Of repeated rows one stays. Texts without a word have no class and stay. Columns
    are unchanged, whatever their names; an empty table stays empty.
    """
    found = near_duplicates(docs.select("doc_id", "text"), recall)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least")
    stay = found.where("sid is not null").groupBy("root").agg(least).select("least.doc_id", "least.text_hash", F.lit(False).alias("bare"))
    bare = found.where("sid is null").select("doc_id", "text_hash", F.lit(True).alias("bare")).distinct()
    stay = stay.union(bare)
    # Numbers instead of the names of the columns, which might be those used here.
    keyed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    joined = keyed.withColumn("own_hash", F.xxhash64(text)).join(stay, own.cast("long").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    once = joined.where("not bare").dropDuplicates(["doc_id", "own_hash"])
    return once.unionByName(joined.where("bare")).select(*keyed.columns).toDF(*docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and its number of links."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links")
