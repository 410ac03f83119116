"""Operators over ordered rows: filters, top-n, de-duplication, filling and crossings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.names import fresh

from .aggregate import interval_seconds
from .prefix import CHUNK, chunk_of, last_known, row_before, running_count, running_max

HOT_ROWS = 1000


def monotonic_ticker(ticks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ticks whose event time is not before that of an earlier tick of the symbol; equal times pass."""
    (high,) = fresh(ticks, "_high")
    return running_max(ticks, ("symbol",), "event_ms", "seq", high, chunk).where(F.col("event_ms") == F.col(high)).drop(high)


def throttle_klines(events: DataFrame, gap_ms: int = 250, chunk: int = CHUNK) -> DataFrame:
    """Kline events that go out: closed ones always; open ones ``gap_ms`` or more after the last that went out.

    Events have symbol, interval, seq, at_ms, closed. A closed event goes out and sets the clock, whatever came
    before, so what follows it up to the next closed one is a stretch of its own. Stretches spread over tasks; a task
    reads each in order and keeps the clock alone, however many events a stretch has.
    """
    (stretch,) = fresh(events, "_stretch")
    key, names = ("symbol", "interval"), events.columns
    dealt = running_count(events, key, F.col("closed"), "seq", stretch, chunk).repartition(*key, stretch).sortWithinPartitions(*key, stretch, "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = None, None
        for batch in batches:
            goes = []
            for own, at, closed in zip(zip(*(batch.column(c).to_pylist() for c in (*key, stretch)), strict=True), batch.column("at_ms").to_pylist(), batch.column("closed").to_pylist(), strict=True):
                if own != open_:
                    open_, last = own, None
                out = closed or last is None or at - last >= gap_ms
                last = at if out else last
                goes.append(bool(out))
            yield batch.filter(pa.array(goes, pa.bool_())).select(names)

    return dealt.mapInArrow(run, events.schema)


def latest_n(candles: DataFrame, n: int = HOT_ROWS, before_s: int | None = None) -> DataFrame:
    """The newest n candles of each symbol and interval, those that start before ``before_s`` where it is given."""
    rows = candles if before_s is None else candles.where(F.col("start_s") < before_s)
    (place,) = fresh(candles, "_n")
    over = Window.partitionBy("symbol", "interval").orderBy(F.desc("start_s"))
    return rows.withColumn(place, F.row_number().over(over)).where(F.col(place) <= n).drop(place)


def dedupe_keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``. Aggregation combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    (row,) = fresh(df, "_row")
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias(row))
    return last.select(*key, f"{row}.*").select(*df.columns)


def forward_fill(candles: DataFrame) -> DataFrame:
    """Fills gaps between candles of a symbol and interval with flat ones at the close before, volume 0, is_ghost."""
    d, after, at = fresh(candles, "_d", "_next", "_at")
    over = Window.partitionBy("symbol", "interval").orderBy("start_s")
    rows = candles.withColumn(d, interval_seconds()).withColumn(after, F.lead("start_s").over(over)).where(F.col(d).isNotNull())
    gap = F.col(after) - F.col("start_s") > F.col(d)
    starts = F.when(gap, F.sequence(F.col("start_s"), F.col(after) - F.col(d), F.col(d))).otherwise(F.array("start_s"))
    filled = rows.withColumn(at, F.explode(starts)).withColumn("is_ghost", F.col(at) > F.col("start_s"))
    price = lambda c: F.when(F.col("is_ghost"), F.col("close")).otherwise(F.col(c)).alias(c)
    zero = lambda c: F.when(F.col("is_ghost"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return filled.select(
        "symbol", "interval", F.col(at).alias("start_s"), (F.col(at) + F.col(d) - 1).alias("close_s"),
        *(price(c) for c in ("open", "high", "low")), "close", zero("volume"), zero("trades"), "is_ghost",
    )


def price_direction(prices: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """up or down against the price before; the same price keeps the last direction; neutral at first."""
    before, move, last = fresh(prices, "_was", "_move", "_last")
    known = row_before(prices, ("symbol",), F.col("price"), "seq", before, chunk_of("seq", chunk))
    was = F.col(before)["v"]
    moved = known.withColumn(move, F.when(F.col("price") > was, "up").when(F.col("price") < was, "down"))
    out = last_known(moved, ("symbol",), move, "seq", last, chunk_of("seq", chunk))
    return out.select(*prices.columns, F.coalesce(last, F.lit("neutral")).alias("direction"))


def threshold_crossings(samples: DataFrame, limit: float, key: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Samples (seq, ratio) where ratio rises to ``limit`` or over (alert) or falls below it again (recovery).

    A null ratio says nothing: what was known before it goes on.
    """
    (was,) = fresh(samples, "_was")
    high = F.col("ratio") >= limit
    marked = row_before(samples.where("ratio is not null"), key, high, "seq", was, chunk_of("seq", chunk))
    crossed = marked.where(high != F.coalesce(F.col(was)["v"], F.lit(False)))
    return crossed.withColumn("event", F.when(high, "alert").otherwise("recovery")).drop(was)
