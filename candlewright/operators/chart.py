"""Chart windows, paging, 24-hour statistics and their live overlay."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.names import fresh
from candlewright.functions.numbers import change_percent, unscale_volume
from candlewright.functions.time import INTERVALS
from candlewright.sources.klines import in_span

from .aggregate import PRICES, range_stats
from .ordered import HOT_ROWS, latest_n

COLUMNS = ("symbol", "interval", "start_s", *PRICES, "volume")


def chart_candle(candles: DataFrame) -> DataFrame:
    """Chart rows: start in epoch seconds and volume as a number."""
    return candles.select("symbol", "interval", F.col("start_s").alias("time_s"), *PRICES, unscale_volume(F.col("volume")).alias("volume"))


def end_bucket(interval: str, as_of_s: int, to_s: int | None = None) -> int:
    d = INTERVALS[interval]
    return (as_of_s if to_s is None else to_s) // d * d


def is_hot(interval: str, as_of_s: int, to_s: int | None = None) -> bool:
    """Whether the window ends within the newest 1000 buckets."""
    return as_of_s // 60 * 60 - end_bucket(interval, as_of_s, to_s) <= INTERVALS[interval] * HOT_ROWS


def chart_hot(candles: DataFrame, symbol: str, interval: str, n: int, as_of_s: int, to_s: int | None = None) -> DataFrame:
    """The newest n candles before the end bucket, however long ago."""
    rows = candles.where((F.col("symbol") == symbol) & (F.col("interval") == interval))
    return latest_n(rows, n, end_bucket(interval, as_of_s, to_s)).select(*COLUMNS)


def chart_cold(candles: DataFrame, symbol: str, interval: str, n: int, as_of_s: int, to_s: int | None = None) -> DataFrame:
    """The candles of the n buckets before the end bucket; fewer where some are missing."""
    end = end_bucket(interval, as_of_s, to_s)
    return in_span(candles, interval, end - n * INTERVALS[interval], end).where(F.col("symbol") == symbol).select(*COLUMNS)


def merge_live(finalized: DataFrame, live: DataFrame, base_s: int) -> DataFrame:
    """``finalized`` with the live candle of bucket ``base_s`` put in, or put in place of a finalized one; others are ignored."""
    now = live.where(F.col("start_s") == base_s).select(*COLUMNS)
    return finalized.select(*COLUMNS).join(now, ["symbol", "interval", "start_s"], "left_anti").unionByName(now)


def chart(candles: DataFrame, live: DataFrame, symbol: str, interval: str = "1m", n: int = 120, as_of_s: int = 0, to_s: int | None = None) -> DataFrame:
    """A chart window, ascending; without ``to_s`` the live candle comes on top, so up to n + 1 rows."""
    window = chart_hot if is_hot(interval, as_of_s, to_s) else chart_cold
    rows = window(candles, symbol, interval, n, as_of_s, to_s)
    if to_s is None:
        own = live.where((F.col("symbol") == symbol) & (F.col("interval") == interval))
        rows = merge_live(rows, own, end_bucket(interval, as_of_s))
    return rows.orderBy("start_s")


def page_before(candles: DataFrame, symbol: str, interval: str, oldest_s: int, as_of_s: int, page: int = 120, hot: DataFrame | None = None) -> DataFrame:
    """The page before a candle, from the window ``hot`` (or ``candles``) where it ends within the newest buckets."""
    if is_hot(interval, as_of_s, oldest_s):
        return chart_hot(candles if hot is None else hot, symbol, interval, page, as_of_s, oldest_s)
    return chart_cold(candles, symbol, interval, page, as_of_s, oldest_s)


def pages_back(candles: DataFrame, symbol: str, interval: str, oldest_s: int, as_of_s: int, page: int = 120, hot: DataFrame | None = None) -> Iterator[DataFrame]:
    """One page after another, each before the oldest candle of the last, up to the first empty one.

    A page is asked for when the one before is done with, by its oldest bucket alone; of a stored table each page reads
    its own days.
    """
    while True:
        rows = page_before(candles, symbol, interval, oldest_s, as_of_s, page, hot)
        first = rows.agg(F.min("start_s")).first()[0]
        if first is None:
            return
        yield rows
        oldest_s = first


def page_back(candles: DataFrame, loaded: DataFrame, symbol: str, interval: str, oldest_s: int, as_of_s: int, page: int = 120) -> DataFrame:
    """``loaded`` with the page before its oldest candle; where both have a bucket the loaded row stays."""
    older = page_before(candles, symbol, interval, oldest_s, as_of_s, page)
    return older.join(loaded, ["symbol", "interval", "start_s"], "left_anti").unionByName(loaded.select(*COLUMNS)).orderBy("start_s")


def load_windows(candles: DataFrame, n: int = HOT_ROWS) -> DataFrame:
    """The newest n candles of every symbol and interval, in one job."""
    return latest_n(candles, n)


def stats_24h(candles: DataFrame, live: DataFrame, as_of_ms: int) -> DataFrame:
    """Statistics of each symbol over the 24 hours before ``as_of_ms``.

    The window starts exactly a day before, so a partial first minute is left out, and ends at the current
    minute; the live candle counts if it is of that minute. A symbol with neither has no row.
    """
    start_s, minute = -(-(as_of_ms - 86_400_000) // 1000), as_of_ms // 60_000 * 60
    done = range_stats(candles.where("interval = '1m'"), start_s, minute).alias("f")
    now = live.where((F.col("interval") == "1m") & (F.col("start_s") == minute)).alias("l")
    joined = done.join(now, F.col("f.symbol") == F.col("l.symbol"), "full")
    open_ = F.coalesce("f.open", "l.open")
    current = F.coalesce("l.close", "f.close")
    nothing = F.lit(0).cast("decimal(28,8)")
    live_volume = F.coalesce(unscale_volume(F.col("l.volume")), nothing)
    return joined.select(
        F.coalesce("f.symbol", "l.symbol").alias("symbol"), open_.alias("open"), current.alias("current"),
        F.greatest("f.high", "l.high").alias("high"), F.least("f.low", "l.low").alias("low"),
        (F.coalesce(unscale_volume(F.col("f.volume")), nothing) + live_volume).cast("decimal(28,8)").alias("volume"),
        change_percent(open_, current).alias("change_percent"), F.lit(as_of_ms - 86_400_000).alias("window_start_ms"), F.lit(minute * 1000).alias("window_end_ms"),
        F.col("l.start_s").alias("live_s"), live_volume.alias("live_volume"),
    )


def stats_overlay(stats: DataFrame, klines: DataFrame, tickers: DataFrame) -> DataFrame:
    """24-hour statistics refreshed by the last kline (start_s, high, low, close, volume) and ticker (price) of each symbol.

    Volume: within the bucket already counted the larger live volume counts, a later bucket adds its own.
    """
    s = stats.alias("s").join(klines.alias("k"), F.col("s.symbol") == F.col("k.symbol"), "left").join(tickers.alias("t"), F.col("s.symbol") == F.col("t.symbol"), "left")
    price = F.coalesce("t.price", "k.close", "s.current").cast("decimal(18,6)")
    k_volume = unscale_volume(F.col("k.volume"))
    same = F.col("k.start_s") == F.col("s.live_s")
    later = F.col("k.start_s") > F.coalesce("s.live_s", F.expr("s.window_end_ms div 1000 - 1"))
    volume = F.when(same, F.col("s.volume") - F.col("s.live_volume") + F.greatest("s.live_volume", k_volume)).when(later, F.col("s.volume") + k_volume).otherwise(F.col("s.volume"))
    return s.select(
        F.col("s.symbol").alias("symbol"), F.col("s.open").alias("open"), price.alias("current"), F.greatest("s.high", "k.high", price).alias("high"),
        F.least("s.low", "k.low", price).alias("low"), volume.cast("decimal(28,8)").alias("volume"), change_percent(F.col("s.open"), price).alias("change_percent"),
    )


def newest(df: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each symbol."""
    over = Window.partitionBy("symbol").orderBy(F.desc(order))
    (place,) = fresh(df, "_n")
    return df.withColumn(place, F.row_number().over(over)).where(F.col(place) == 1).drop(place)
