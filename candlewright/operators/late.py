"""Late ticks: who is late, which late ticks still count, and the candles that follow.

A bucket's ticks are on time while no tick of a later bucket has arrived for the symbol and interval. What
decides a tick's fate is a property of its bucket, kept in a directory with a row for each candle. Running
maxima over arrival order, for those who want them, are two-level prefix scans: within chunks of seq, and over
the chunks' maxima, so that one busy symbol spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.names import fresh
from candlewright.functions.numbers import scale_volume
from candlewright.functions.time import bucket_close

from .aggregate import PRICES, candles_of, expand_intervals, interval_seconds, with_bucket
from .prefix import CHUNK, running_max

KEEP, TTL_MS = 3, 120_000
KEY = ("symbol", "interval")


def classify_late(ticks: DataFrame, intervals: tuple[str, ...], chunk: int = CHUNK) -> DataFrame:
    """Ticks for each interval with start_s, high_s (the latest bucket opened so far) and on_time."""
    marked = running_max(with_bucket(expand_intervals(ticks, intervals)), KEY, "start_s", "seq", "high_s", chunk)
    return marked.withColumn("on_time", F.col("start_s") == F.col("high_s"))


def bucket_directory(bucketed: DataFrame, keep: int = KEEP) -> DataFrame:
    """The buckets that were once the latest, in order: seq of their first tick, seq and arrival of the tick that
    closed each, and seq of the tick from which on it no longer is one of the ``keep`` last closed (null: not yet).

    A bucket is opened if its first tick finds no later bucket. That takes one row for each candle, summed up
    before the shuffle; no window runs over ticks.
    """
    first = bucketed.groupBy(*KEY, "start_s").agg(F.min(F.struct("seq", "arrival_ms")).alias("o"))
    before = Window.partitionBy(*KEY).orderBy("o.seq").rowsBetween(Window.unboundedPreceding, -1)
    (high,) = fresh(first, "_high")
    opened = first.withColumn(high, F.max("start_s").over(before)).where(F.col(high).isNull() | (F.col("start_s") > F.col(high)))
    over = Window.partitionBy(*KEY).orderBy("start_s")
    return opened.select(
        *KEY, "start_s", F.col("o.seq").alias("open_seq"), F.lead("o.seq").over(over).alias("closed_seq"),
        F.lead("o.arrival_ms").over(over).alias("closed_ms"), F.lead("o.seq", keep + 1).over(over).alias("expired_seq"), F.col("o.arrival_ms").alias("open_ms"),
    )


def fate_of(opened: str, closed: str, closed_ms: str, expired: str, ttl_ms: int) -> Column:
    """The fate of a tick that has the columns of its bucket's row of the directory."""
    on_time = F.col(opened).isNotNull() & (F.col(closed).isNull() | (F.col("seq") < F.col(closed)))
    recent = F.col(expired).isNull() | (F.col("seq") < F.col(expired))
    applied = F.col(opened).isNotNull() & recent & (F.col("arrival_ms") - F.col(closed_ms) <= ttl_ms)
    return F.when(on_time, "on_time").when(applied, "late_applied").otherwise("late_dropped")


def apply_late(ticks: DataFrame, intervals: tuple[str, ...], keep: int = KEEP, ttl_ms: int = TTL_MS) -> DataFrame:
    """Ticks for each interval with fate, on_time, late_applied or late_dropped, and closed_seq of their bucket.

    A late tick counts if its bucket is one of the ``keep`` last closed and was closed at most ``ttl_ms`` ago.
    All of that stands in the bucket's row of the directory, so one join by candle settles it. Columns interval,
    start_s, fate and closed_seq of ``ticks`` are replaced, all others are carried, whatever their names.
    """
    bucketed = with_bucket(expand_intervals(ticks.drop("fate", "closed_seq"), intervals))
    opened, closed_ms, expired = fresh(bucketed, "open_seq", "closed_ms", "expired_seq")
    places = bucket_directory(bucketed.select("seq", "arrival_ms", *KEY, "start_s"), keep).select(
        *KEY, "start_s", "closed_seq", *(F.col(c).alias(n) for c, n in (("open_seq", opened), ("closed_ms", closed_ms), ("expired_seq", expired)))
    )
    joined = bucketed.join(places, [*KEY, "start_s"], "left")
    return joined.withColumn("fate", fate_of(opened, "closed_seq", closed_ms, expired, ttl_ms)).drop(opened, closed_ms, expired)


def candles_with_late(ticks: DataFrame, intervals: tuple[str, ...], keep: int = KEEP, ttl_ms: int = TTL_MS) -> DataFrame:
    """Candles of the ticks that count. A late tick comes after its bucket's first, so it never is the open."""
    return candles_of(apply_late(ticks, intervals, keep, ttl_ms).where("fate <> 'late_dropped'"))


def candle_revisions(ticks: DataFrame, intervals: tuple[str, ...], keep: int = KEEP, ttl_ms: int = TTL_MS) -> DataFrame:
    """Changelog of candles: after each tick that counts the candle as it stands (live or late), and each candle as it closed.

    A closed row bears the seq of the tick that opened the next bucket and comes before that tick's own row.
    """
    kept = apply_late(ticks, intervals, keep, ttl_ms).where("fate <> 'late_dropped'")
    bucket = Window.partitionBy(*KEY, "start_s").orderBy("seq")
    over = bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on_time = F.col("fate") == "on_time"
    # Late ticks of a bucket come after it closed, so its candle as it closed stands at its last tick that was on time.
    last = on_time & F.lead(on_time, 1, False).over(bucket).eqNullSafe(F.lit(False)) & F.col("closed_seq").isNotNull()
    own = F.struct("seq", F.when(on_time, "live").otherwise("late").alias("kind"))
    running = kept.select(
        *KEY, "start_s", F.when(last, F.array(own, F.struct(F.col("closed_seq").alias("seq"), F.lit("closed").alias("kind")))).otherwise(F.array(own)).alias("rows"),
        F.first("price").over(over).alias("open"), F.max("price").over(over).alias("high"), F.min("price").over(over).alias("low"),
        F.col("price").alias("close"), F.sum(scale_volume(F.col("quantity"))).over(over).alias("volume"), F.count("*").over(over).alias("trades"),
    )
    out = running.select(*KEY, "start_s", F.inline("rows"), *PRICES, "volume", "trades")
    return out.withColumn("close_s", bucket_close(F.col("start_s"), interval_seconds()))
