"""Candles from ticks, range statistics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.numbers import scale_volume
from candlewright.functions.time import INTERVALS, bucket_close, bucket_start

PRICES = ("open", "high", "low", "close")


def interval_seconds() -> Column:
    return F.create_map(*(x for name, d in INTERVALS.items() for x in (F.lit(name), F.lit(d).cast("long"))))[F.col("interval")]


def expand_intervals(df: DataFrame, intervals=tuple(INTERVALS)) -> DataFrame:
    """A row of ``df`` for each interval, with its name."""
    return df.withColumn("interval", F.explode(F.array(*(F.lit(i) for i in intervals))))


def with_bucket(ticks: DataFrame) -> DataFrame:
    """Adds start_s, the bucket of event_ms in the row's interval."""
    second = F.floor(F.col("event_ms") / F.lit(1000).cast("decimal(4,0)")).cast("long")
    return ticks.withColumn("start_s", bucket_start(second, interval_seconds()))


def _summary() -> list[Column]:
    """Open and close go by arrival (seq), whatever the event times."""
    return [
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum(scale_volume(F.col("quantity"))).alias("volume"), F.count("*").alias("trades"),
    ]


def candles_of(bucketed: DataFrame) -> DataFrame:
    """Candles of ticks that have interval and start_s; the sum of volumes raises on overflow."""
    out = bucketed.groupBy("symbol", "interval", "start_s").agg(*_summary())
    return out.select("symbol", "interval", "start_s", bucket_close(F.col("start_s"), interval_seconds()).alias("close_s"), *PRICES, "volume", "trades")


def ohlcv(ticks: DataFrame, interval: str) -> DataFrame:
    """Candles of one interval."""
    return candles_of(with_bucket(expand_intervals(ticks, (interval,))))


def ohlcv_multi(ticks: DataFrame) -> DataFrame:
    """Candles of all intervals in one aggregation."""
    return candles_of(with_bucket(expand_intervals(ticks)))


def lenient_volume(ticks: DataFrame) -> DataFrame:
    """Volume of each symbol, null where it does not fit a bigint."""
    return ticks.groupBy("symbol").agg(F.try_sum(scale_volume(F.col("quantity"))).alias("volume"))


def in_range(candles: DataFrame, start_s: int, end_s: int) -> DataFrame:
    return candles.where((F.col("start_s") >= start_s) & (F.col("start_s") < end_s))


def range_stats(candles: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """Per symbol over [start_s, end_s): first and last bucket, open, high, low, close, volume; no row where none lies in it."""
    return in_range(candles, start_s, end_s).groupBy("symbol").agg(
        F.min("start_s").alias("first_s"), F.max("start_s").alias("last_s"), F.min_by("open", "start_s").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "start_s").alias("close"), F.sum("volume").alias("volume"),
    )


def range_aggregate(candles: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """High, low and volume over all candles in [start_s, end_s): always one row, of nulls where none lies in it."""
    return in_range(candles, start_s, end_s).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def rollup(candles: DataFrame, interval: str) -> DataFrame:
    """Candles of a longer interval from those of 1 minute; partial sources count, empty ones give nothing."""
    from_1m = candles.where("interval = '1m'").withColumn("bucket_s", bucket_start(F.col("start_s"), INTERVALS[interval]))
    out = from_1m.groupBy("symbol", "bucket_s").agg(
        F.min_by("open", "start_s").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "start_s").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trades").alias("trades"),
    )
    close = bucket_close(F.col("bucket_s"), INTERVALS[interval])
    return out.select("symbol", F.lit(interval).alias("interval"), F.col("bucket_s").alias("start_s"), close.alias("close_s"), *PRICES, "volume", "trades")


def first_and_last(candles: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """First and last candle of each symbol in [start_s, end_s), as rows with which."""
    row = F.struct("start_s", *PRICES, "volume")
    both = in_range(candles, start_s, end_s).groupBy("symbol").agg(F.min_by(row, "start_s").alias("a"), F.max_by(row, "start_s").alias("b"))
    ends = both.select("symbol", F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("a").alias("r")), F.struct(F.lit("last").alias("which"), F.col("b").alias("r")))).alias("x"))
    return ends.select("symbol", "x.which", "x.r.*")
