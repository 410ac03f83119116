"""Streaming forms: sources, de-duplication, candles with the late rule, tickers, fan-out and the candle sink."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candlewright.functions.numbers import scale_volume
from candlewright.operators.aggregate import PRICES, expand_intervals, with_bucket
from candlewright.operators.late import KEEP, TTL_MS
from candlewright.operators.reconcile import VALUES

MICROS = Decimal(1_000_000)
#: Revisions that a state function gathers before it passes them on.
PART = 50_000
REVISION = (
    "symbol string, interval string, start_s bigint, seq bigint, kind string, open bigint, high bigint, low bigint, close bigint, volume bigint, trades bigint"
)


def file_stream(spark: SparkSession, path: str, schema, files_a_trigger: int | None = None, bytes_a_trigger: int = 256 << 20) -> DataFrame:
    """A replayable stream of Parquet files, oldest first; offsets are kept by the query's checkpoint.

    A micro-batch takes so many files, or where that is not given about so many bytes, of one file at least.
    """
    bound = ("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else ("maxBytesPerTrigger", bytes_a_trigger)
    return spark.readStream.schema(schema).option(*bound).parquet(path)


def message_stream(spark: SparkSession, path: str, files_a_trigger: int | None = None, bytes_a_trigger: int = 256 << 20) -> DataFrame:
    """A replayable stream of messages, one a line of text files: value, and arrival_ms, when its file was complete.

    Put read_trade_json or classify_messages behind it. A file is one arrival: lines of a file share its time.
    """
    bound = ("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else ("maxBytesPerTrigger", bytes_a_trigger)
    lines = spark.readStream.option(*bound).text(path)
    return lines.select("value", F.unix_millis("_metadata.file_modification_time").alias("arrival_ms"))


def in_order(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    """Rows of these columns, all without nulls in 64 bits, by the first of them; what is held are these bits and the order.

    No column of a key is kept, and a frame goes as soon as it is read.
    """
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for frame in frames:
        for part, name in zip(parts, names, strict=True):
            part.append(frame[name].to_numpy(np.int64, copy=True))
    columns = [np.concatenate(parts.pop(0)) for _ in names]
    order = np.argsort(columns[0], kind="stable")
    for at in range(0, len(order), PART):
        here = order[at : at + PART]
        yield from zip(*(c[here].tolist() for c in columns), strict=True)


def dedupe_ticks(stream: DataFrame, within: str = "1 minute") -> DataFrame:
    """One tick for each record_id within a time; ``stream`` has the timestamp column arrived. A batch keeps one of all."""
    if not stream.isStreaming:
        return stream.dropDuplicates(["record_id"])
    return stream.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["record_id"])


class RecentIds:
    """The ids seen within a time, the newest ``most`` of them at most, oldest first."""

    def __init__(self, ids: list[str], at: list[int], within_ms: int, most: int):
        self.seen, self.now = OrderedDict(zip(ids, at, strict=True)), at[-1] if at else -(1 << 62)
        self.within_ms, self.most = within_ms, most

    def is_new(self, record_id: str | None, arrival_ms: int) -> bool:
        """Remembers an id that is new, from its arrival on; one that is known keeps its time. A null id always is new."""
        self.now = max(self.now, arrival_ms)
        while self.seen and self.now - next(iter(self.seen.values())) >= self.within_ms:
            self.seen.popitem(last=False)
        if record_id is None:
            return True
        if record_id in self.seen:
            return False
        self.seen[record_id] = self.now
        if len(self.seen) > self.most:
            self.seen.popitem(last=False)
        return True


def dedupe_recent(ticks: DataFrame, key: str = "symbol", within_ms: int = 60_000, most: int = 100_000) -> DataFrame:
    """Ticks whose record_id was not among those that arrived for ``key`` in the last ``within_ms``, the newest ``most`` of them.

    In the order of seq, with a memory of its own for each key; what its arrival clock or its number pushes out is new
    again when it comes. A stream keeps the memory as typed state, at most ``most`` ids a key; a batch reads each key in
    order and holds its memory alone.
    """
    names = ticks.columns

    def fit(frame: pd.DataFrame, recent: RecentIds) -> pd.DataFrame:
        ids = frame["record_id"].astype(object)
        return frame[[recent.is_new(i, a) for i, a in zip(ids.where(ids.notna(), None).tolist(), frame["arrival_ms"].astype("int64").tolist(), strict=True)]]

    if ticks.isStreaming:

        def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            ids, at = state.get if state.exists else ([], [])
            recent = RecentIds(list(ids), list(at), within_ms, most)
            yield fit(pd.concat(frames).sort_values("seq"), recent)[names]
            state.update((list(recent.seen), list(recent.seen.values())))

        return ticks.groupBy(key).applyInPandasWithState(run, ticks.schema, "ids array<string>, at array<long>", "append", GroupStateTimeout.NoTimeout)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, recent = None, RecentIds([], [], within_ms, most)
        for frame in frames:
            for value, part in frame.groupby(key, sort=False, dropna=False):
                value = None if pd.isna(value) else value
                if value != own:
                    own, recent = value, RecentIds([], [], within_ms, most)
                yield fit(part, recent)

    return ticks.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(scan, ticks.schema)


def revisions(key: tuple, kinds: list[str], rows: list[tuple]) -> pd.DataFrame:
    """A frame of REVISION from the kind, and (start_s, seq, values) in whole numbers, of each revision of a symbol and interval."""
    names = [f.split()[0] for f in REVISION.split(", ")]
    numbers = dict(zip([n for n in names if n not in ("symbol", "interval", "kind")], np.array(rows, np.int64).reshape(len(rows), 8).T, strict=True))
    words = {"symbol": [key[0]] * len(rows), "interval": [key[1]] * len(rows), "kind": kinds}
    return pd.DataFrame({n: numbers[n] if n in numbers else np.array(words[n], object) for n in names})


class CandleState:
    """Candle of the current bucket, and the last closed ones with the time each was closed."""

    def __init__(self, saved: str | None, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms
        self.current, self.closed = json.loads(saved) if saved else (None, [])

    def saved(self) -> str:
        return json.dumps([self.current, self.closed])

    @staticmethod
    def _add(candle: list, price: int, units: int) -> None:
        candle[2], candle[3], candle[4] = max(candle[2], price), min(candle[3], price), price
        candle[5] += units
        candle[6] += 1

    def tick(self, start: int, price: int, units: int, arrival: int) -> Iterator[tuple[str, list]]:
        """(kind, candle) rows that a tick gives rise to; candles are [start, open, high, low, close, volume, trades]."""
        if self.current is None or start > self.current[0]:
            if self.current is not None:
                yield "closed", list(self.current)
                self.closed = [*self.closed, [arrival, self.current]][-self.keep :]
            self.current = [start, price, price, price, price, units, 1]
            yield "live", list(self.current)
        elif start == self.current[0]:
            self._add(self.current, price, units)
            yield "live", list(self.current)
        else:
            for at, candle in self.closed:
                if candle[0] == start and arrival - at <= self.ttl_ms:
                    self._add(candle, price, units)
                    yield "late", list(candle)


def stream_candles(ticks: DataFrame, intervals: tuple[str, ...], keep: int = KEEP, ttl_ms: int = TTL_MS) -> DataFrame:
    """Changelog of candles of a tick stream, with the exact late rule; the same rows as the batch changelog.

    State is one bounded object for each symbol and interval. Within a micro-batch ticks go by seq; batches must
    come in order of seq. Clocks are columns, so no timers are needed. The rule is sequential, so one task sorts and
    reads the ticks that one symbol and interval have in a micro-batch: bound that by what the source gives a trigger.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = CandleState(state.get[0] if state.exists else None, keep, ttl_ms)
        rows, kinds = [], []
        for seq, *tick in in_order(frames, ["seq", "start_s", "micros", "units", "arrival_ms"]):
            for kind, c in own.tick(*tick):
                kinds.append(kind)
                rows.append((c[0], seq, *c[1:]))
            if len(rows) > PART:
                yield revisions(key, kinds, rows)
                rows, kinds = [], []
        state.update((own.saved(),))
        yield revisions(key, kinds, rows)

    bucketed = with_bucket(expand_intervals(ticks, intervals)).select(
        "symbol", "interval", "start_s", "seq", "arrival_ms", (F.col("price") * F.lit(MICROS)).cast("bigint").alias("micros"), scale_volume(F.col("quantity")).alias("units")
    )
    out = bucketed.groupBy("symbol", "interval").applyInPandasWithState(run, REVISION, "saved string", "append", GroupStateTimeout.NoTimeout)
    price = lambda c: (F.col(c) * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)").alias(c)
    return out.select("symbol", "interval", "start_s", "seq", "kind", *(price(c) for c in PRICES), "volume", "trades")


def stream_candles_windowed(ticks: DataFrame, interval: str, delay: str = "2 minutes") -> DataFrame:
    """Tumbling event-time candles under Spark's own watermark: cheaper, but another late rule than stream_candles."""
    timed = ticks.withColumn("event_time", F.timestamp_millis("event_ms")).withWatermark("event_time", delay)
    span = {"1m": "1 minute", "5m": "5 minutes", "30m": "30 minutes"}[interval]
    out = timed.groupBy("symbol", F.window("event_time", span).alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum(scale_volume(F.col("quantity"))).alias("volume"), F.count("*").alias("trades"),
    )
    return out.select("symbol", F.lit(interval).alias("interval"), F.unix_timestamp("w.start").alias("start_s"), *PRICES, "volume", "trades")


def stream_ticker(ticks: DataFrame) -> DataFrame:
    """(seq, symbol, event_ms) of ticks not older than the newest so far of their symbol."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, rows = state.get[0] if state.exists else -(1 << 62), []
        for seq, event_ms in in_order(frames, ["seq", "event_ms"]):
            if event_ms >= high:
                high = event_ms
                rows.append((seq, key[0], event_ms))
            if len(rows) > PART:
                yield pd.DataFrame(rows, columns=["seq", "symbol", "event_ms"])
                rows = []
        state.update((high,))
        yield pd.DataFrame(rows, columns=["seq", "symbol", "event_ms"])

    plain = ticks.select("seq", "symbol", "event_ms")
    return plain.groupBy("symbol").applyInPandasWithState(run, "seq bigint, symbol string, event_ms bigint", "high bigint", "append", GroupStateTimeout.NoTimeout)


class CandleTable:
    """A candle table on files: every batch adds one folder of revisions, and the last revision of a key counts.

    Writing a batch again replaces its folder, so replays leave no trace. compact() folds all batches into one. Every read
    folds all batches: for a stream that goes on see store.CandleStore.
    """

    SCHEMA = (
        "symbol string, start_s bigint, seq bigint, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume bigint, "
        "batch int, interval string, day bigint"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, candles: DataFrame, batch: int) -> None:
        rows = candles.select("symbol", "interval", "start_s", "seq", *VALUES)
        rows.withColumn("day", F.expr("start_s div 86400")).write.mode("overwrite").partitionBy("interval", "day").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        """Newest revision of each key with its version: the number of batches that rewrote it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)  # no batch has been written yet
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = F.max_by(F.struct(*VALUES), F.struct("batch", "seq")).alias("r")
        out = rows.groupBy("symbol", "interval", "start_s").agg(last, (F.count_distinct("batch") - 1).alias("version"))
        return out.select("symbol", "interval", "start_s", "r.*", "version")

    def compact(self, target: CandleTable) -> None:
        """Writes the current rows as batch 0 of another table."""
        target.write(self.read().withColumn("seq", F.lit(0).cast("long")), 0)


def candle_sink(table: CandleTable, publish=None):
    """A foreachBatch function: persists the last revision of each candle, then hands it to ``publish``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("symbol", "interval", "start_s").agg(F.max_by(F.struct("seq", *VALUES), F.struct("seq", F.col("kind") != "closed")).alias("r"))
        table.write(last.select("symbol", "interval", "start_s", "r.*"), batch_id)
        if publish is not None:
            publish(batch, batch_id)

    return sink


def run_to_end(stream: DataFrame, checkpoint: str, sink=None, path: str | None = None, mode: str = "append") -> None:
    """Runs a stream over all input there is, into a foreachBatch function or Parquet files."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink is not None else writer.format("parquet").option("path", path)
    query = writer.start()
    query.awaitTermination()


__all__ = ["CandleState", "CandleTable", "RecentIds", "candle_sink", "dedupe_recent", "dedupe_ticks", "file_stream", "message_stream", "run_to_end", "stream_candles", "stream_candles_windowed", "stream_ticker"]
