"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Documents whose crc32(doc_id as text) mod 4 is this are held out of training.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a temporary folder does, one for the process, but only on a local master.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _MADE:
        _MADE.append("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return _MADE[0]


_MADE: list[str] = []
_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that stored() has written in this process, and returns their number.

    For long-lived sessions: results that have not been read or written yet need them, so call it afterwards.
    """
    gone = 0
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``size`` bytes of text, or of one row if that is longer."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null reads as empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, kept for repeated words; emptied when ``limit`` words are held."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words `[^\\x20\\x09-\\x0D]+` of a text; bytes.split() cuts at exactly those characters."""
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of each window of n words, in order; a text of 1 to n-1 words is one window, an empty text none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
    return mix(out + np.uint64(n))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(quoted(name))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for any column names; Spark itself sees numbers only, so a dot in a name is no field."""
    names, fields = df.columns, [StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f.name for f in fields])

    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(numbered, StructType(fields)).toDF(*schema.names)


def with_field(df: DataFrame, name: str, kind: str) -> tuple[DataFrame, StructType]:
    """``df`` without column ``name``, and its schema with ``name`` of this type at the end."""
    kept = df.select(*(named(c) for c in df.columns if c != name))
    return kept, StructType([*kept.schema.fields, *StructType.fromDDL(f"{quoted(name)} {kind}").fields])


#: Edges that a task of forest() reads, and nodes that it holds at most.
FOREST_EDGES, FOREST_NODES = 400_000, 1_000_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) that connect what the edges read connect: each node and the least of its local group."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, top(x)) for x in up]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            up.setdefault(x, x)
            up.setdefault(y, y)
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST_NODES:
            yield stars()
            up.clear()
    yield stars()


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: tasks that read FOREST_EDGES each keep a star for each local group."""
    edges = stored(edges.select("a", "b"))
    parts = 1 + edges.count() // FOREST_EDGES
    return edges.coalesce(parts).mapInArrow(_forest, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id over undirected edges (a, b) of longs; returns (id, root).

    Each round takes the least label among neighbours and then the label's own label, so that chains
    shorten by more than half. Labels live in the shared folder; only counts come to the driver.
    """
    edges = forest(edges)
    both = stored(
        edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
        .where("id <> other")
        .distinct()
    )
    labels = stored(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("root")))
    for _ in range(rounds):
        heard = (
            both.join(labels.select(F.col("id").alias("other"), "root"), "other")
            .groupBy("id")
            .agg(F.min("root").alias("heard"))
        )
        lower = labels.join(heard, "id").select("id", "root", F.least("root", "heard").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("far"))
        after = stored(lower.join(jump, "low", "left").select("id", F.col("root").alias("was"), F.least("low", F.coalesce("far", "low")).alias("root")))
        changed = after.where("was <> root").limit(1).count()
        labels = after.select("id", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
