"""Candles with the late rule in typed state on RocksDB, and the whole way from binary frames to the stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewright.functions.numbers import scale_volume, try_scale_volume
from candlewright.operators.aggregate import PRICES, expand_intervals, with_bucket
from candlewright.operators.late import KEEP, TTL_MS
from candlewright.sources.ticks import decode_tick_frames, validate_ticks

from .candles import MICROS, PART, REVISION, CandleState, dedupe_recent, in_order, revisions

_CANDLE = "start_s bigint, open bigint, high bigint, low bigint, close bigint, volume bigint, trades bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB: on disk, so that state may exceed an executor's heap."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class CandleProcessor(StatefulProcessor):
    """The current candle of a symbol and interval as a value, its last closed ones with their closing time as a list."""

    def __init__(self, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", _CANDLE)
        self.closed = handle.getListState("closed", f"closed_ms bigint, {_CANDLE}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = CandleState(None, self.keep, self.ttl_ms)
        own.current = list(self.current.get()) if self.current.exists() else None
        own.closed = [[c[0], list(c[1:])] for c in self.closed.get()] if self.closed.exists() else []
        before, rows_out, kinds = [c[0] for c in own.closed], [], []
        late = False
        for seq, *tick in in_order(rows, ["seq", "start_s", "micros", "units", "arrival_ms"]):
            for kind, c in own.tick(*tick):
                late |= kind == "late"
                kinds.append(kind)
                rows_out.append((c[0], seq, *c[1:]))
            if len(rows_out) > PART:
                yield revisions(key, kinds, rows_out)
                rows_out, kinds = [], []
        self.current.update(tuple(own.current))
        if late or [c[0] for c in own.closed] != before:  # most micro-batches close nothing: only the value is written then
            self.closed.put([(int(at), *map(int, c)) for at, c in own.closed])
        yield revisions(key, kinds, rows_out)

    def close(self) -> None:
        pass


def stream_candles_typed(ticks: DataFrame, intervals: tuple[str, ...], keep: int = KEEP, ttl_ms: int = TTL_MS) -> DataFrame:
    """The changelog of candles of a tick stream, as candles.stream_candles; start it within rocksdb().

    State has a schema of its own and is written as it changes: the current candle always, the closed ones when one is
    closed or revised. As there, one task reads what a symbol and interval have in a micro-batch.
    """
    return _revisions(ticks, (F.col("price") * F.lit(MICROS)).cast("bigint"), scale_volume(F.col("quantity")), intervals, keep, ttl_ms)


def _revisions(ticks: DataFrame, micros: Column, units: Column, intervals: tuple[str, ...], keep: int, ttl_ms: int) -> DataFrame:
    bucketed = with_bucket(expand_intervals(ticks, intervals)).select("symbol", "interval", "start_s", "seq", "arrival_ms", micros.alias("micros"), units.alias("units"))
    out = bucketed.groupBy("symbol", "interval").transformWithStateInPandas(CandleProcessor(keep, ttl_ms), REVISION, "Append", "None")
    price = lambda c: (F.col(c) * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)").alias(c)
    return out.select("symbol", "interval", "start_s", "seq", "kind", *(price(c) for c in PRICES), "volume", "trades")


def frames_to_candles(frames: DataFrame, intervals: tuple[str, ...], within_ms: int = 60_000, most: int = 100_000) -> DataFrame:
    """The changelog of candles of a stream of binary frames (seq, record_id, arrival_ms, payload).

    What is no frame or no valid tick is left out, a record_id that came within the memory of its symbol counts once, then
    the late rule applies: one query with two stateful operators, so that its checkpoint covers the whole way. With
    store.CandleSink behind it each micro-batch takes effect once, also over restarts. A micro-batch may be one file, which
    one task reads, so its frames are dealt to all cores before they are decoded.
    """
    dealt = frames.repartition(frames.sparkSession.sparkContext.defaultParallelism)
    ticks = validate_ticks(decode_tick_frames(dealt)[0])[0]
    # Whole numbers go through Python, not decimals; those out of range are -1, and errors if they are no repeats.
    micros = F.coalesce((F.col("price") * F.lit(MICROS)).try_cast("bigint"), F.lit(-1).cast("long")).alias("micros")
    units = F.coalesce(try_scale_volume(F.col("quantity")), F.lit(-1).cast("long")).alias("units")
    once = dedupe_recent(ticks.select("seq", "symbol", micros, units, "event_ms", "arrival_ms", "record_id"), within_ms=within_ms, most=most)
    whole = lambda c: F.when(F.col(c) < 0, F.raise_error(F.lit("price or volume is too large")).cast("bigint")).otherwise(F.col(c))
    return _revisions(once, whole("micros"), whole("units"), intervals, KEEP, TTL_MS)
