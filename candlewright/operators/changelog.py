"""Kline events: folding, live candles, hot windows, JSON and fan-out to subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.names import fresh

from .ordered import HOT_ROWS, dedupe_keep_last, latest_n

KEY = ("symbol", "interval", "start_s")


def live_candles(events: DataFrame) -> DataFrame:
    """The latest open candle of each symbol, in lower case, and interval."""
    return dedupe_keep_last(events.where("not closed").withColumn("symbol", F.lower("symbol")), ["symbol", "interval"], "seq")


def clear_if_bucket_matches(live: DataFrame, starts: DataFrame) -> DataFrame:
    """Live candles but those whose symbol, interval and start stand in ``starts``."""
    return live.join(starts.select(*KEY).withColumn("symbol", F.lower("symbol")), list(KEY), "left_anti")


def put_bucket(window: DataFrame, candles: DataFrame, n: int = HOT_ROWS) -> DataFrame:
    """A hot window after new candles took the place of those of their buckets; the newest n of each key stay."""
    kept = window.join(candles, list(KEY), "left_anti")
    return latest_n(kept.unionByName(candles.select(*window.columns)), n)


def put_range(window: DataFrame, candles: DataFrame, n: int = HOT_ROWS) -> DataFrame:
    """A hot window after a batch took the place of all buckets between its first and last of each key."""
    lo, hi = fresh(window, "_lo", "_hi")
    span = candles.groupBy("symbol", "interval").agg(F.min("start_s").alias(lo), F.max("start_s").alias(hi))
    outside = F.col(lo).isNull() | (F.col("start_s") < F.col(lo)) | (F.col("start_s") > F.col(hi))
    kept = window.join(span, ["symbol", "interval"], "left").where(outside).drop(lo, hi)
    return latest_n(kept.unionByName(candles.select(*window.columns)), n)


def finalized(events: DataFrame, n: int = HOT_ROWS) -> DataFrame:
    """The last closed event of each bucket, the newest n buckets of each key."""
    return latest_n(dedupe_keep_last(events.where("closed"), list(KEY), "seq"), n)


def materialized_live(events: DataFrame) -> DataFrame:
    """The latest open event of each key, unless a closed event of the same start came after it."""
    live = dedupe_keep_last(events.where("not closed"), ["symbol", "interval"], "seq")
    (at,) = fresh(events, "_closed")
    closed = events.where("closed").groupBy(*KEY).agg(F.max("seq").alias(at))
    return live.join(closed, list(KEY), "left").where(F.col(at).isNull() | (F.col(at) < F.col("seq"))).drop(at)


def kline_json(klines: DataFrame) -> DataFrame:
    """(key, value): klines as JSON for a topic."""
    body = F.struct("symbol", "interval", F.col("start_s").alias("startTime"), F.col("close_s").alias("endTime"), "open", "high", "low", "close", "volume", "trades", "closed")
    return klines.select(F.col("symbol").alias("key"), F.to_json(body).alias("value"))


def ticker_json(ticks: DataFrame) -> DataFrame:
    """(key, value): tickers as JSON for a topic."""
    return ticks.select(F.col("symbol").alias("key"), F.to_json(F.struct("symbol", "price", "volume", F.col("event_ms").alias("eventTime"))).alias("value"))


def classify_messages(df: DataFrame, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """(klines, tickers) of a mixed JSON stream: what has interval and startTime, and what else has price and eventTime."""
    fields = "symbol string, interval string, startTime bigint, endTime bigint, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume decimal(38,18), trades bigint, closed boolean, price decimal(38,18), eventTime bigint"
    m = df.withColumn("_m", F.from_json(body, fields))
    is_kline = F.col("_m.interval").isNotNull() & F.col("_m.startTime").isNotNull()
    klines = m.where(is_kline).select(
        "_m.symbol", "_m.interval", F.col("_m.startTime").alias("start_s"), F.col("_m.endTime").alias("close_s"), "_m.open", "_m.high", "_m.low", "_m.close",
        F.col("_m.volume").cast("decimal(28,8)").alias("volume"), "_m.trades", "_m.closed",
    )
    tickers = m.where(~is_kline & F.col("_m.price").isNotNull() & F.col("_m.eventTime").isNotNull())
    return klines, tickers.select("_m.symbol", "_m.price", "_m.volume", F.col("_m.eventTime").alias("event_ms"))


def active_subscriptions(commands: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """(session_id, symbol) whose last command is SUBSCRIBE, without the sessions that have ended."""
    last = dedupe_keep_last(commands.where(F.col("command").isin("SUBSCRIBE", "UNSUBSCRIBE")), ["session_id", "symbol"], "seq")
    out = last.where("command = 'SUBSCRIBE'").select("session_id", "symbol")
    return out if ended is None else out.join(ended.select("session_id"), "session_id", "left_anti")


#: Subscriptions that are broadcast at most; more are joined by shuffling.
BROADCAST_SUBSCRIPTIONS = 1_000_000
#: Tasks for each core that a fan-out is dealt to.
SPREAD = 8


def _tasks(df: DataFrame) -> int:
    return SPREAD * df.sparkSession.sparkContext.defaultParallelism


#: Bits of the number of events that a fan-out puts out together, for one session after the other.
RUN_BITS = 8


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A row of ``events`` for each session that follows its symbol, which is matched with case.

    A small file of events may have a row of output for each session and more, so events are dealt to all cores first, in
    runs of one symbol. A session gets a run as a whole before the next one does, so that what is written has the same
    session for a while and the same events again and again, and takes a small part of a byte a row in Parquet. A stream
    of events is joined row by row; call this in foreachBatch for the runs.
    """
    followers = subscriptions.count() if not subscriptions.isStreaming else None
    small = followers is not None and followers <= BROADCAST_SUBSCRIPTIONS
    if events.isStreaming or followers is None:
        return events.join(F.broadcast(subscriptions) if small else subscriptions, "symbol")
    rest, n = [c for c in events.columns if c != "symbol"], _tasks(events)
    run, rows, here, there = fresh(events, "_run", "_rows", "_here", "_there")
    # In an order that a repeated task has again, so that a row is in one run, whatever fails.
    dealt = events.repartition(n).sortWithinPartitions("symbol", *rest).withColumn(run, F.shiftright(F.monotonically_increasing_id(), RUN_BITS))
    one = F.struct(*(rest or [F.lit(True).alias(here)]))
    runs = dealt.repartition(n, run).groupBy("symbol", run).agg(F.collect_list(one).alias(rows))
    names = [c for c in subscriptions.columns if c != "symbol"]
    if small:
        both = runs.join(F.broadcast(subscriptions), "symbol")
    else:  # each part of the runs meets each part of the subscriptions
        parts = -(-followers // BROADCAST_SUBSCRIPTIONS)
        key = ["symbol", here, there]
        left = runs.select("*", F.pmod(F.xxhash64("symbol", run), F.lit(n)).alias(here), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(there))
        right = subscriptions.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(here), F.pmod(F.xxhash64(*subscriptions.columns), F.lit(parts)).cast("int").alias(there))
        both = left.repartition(n, *key).join(right.repartition(n, *key).hint("merge"), key)
    return both.select("symbol", F.inline(rows), *names).select("symbol", *rest, *names)


#: Bits of seq of the smallest blocks, bits that a level of blocks adds, and levels: seqs below 2**42.
BASE_BITS, BLOCK_BITS, LEVELS = 10, 3, 11
#: Parts that the runs of a block are dealt to, by level: blocks of 2**16 seqs and more are cut.
CUTS = (1, 1, 4, *(8,) * (LEVELS - 3))


def validity(commands: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """(session_id, symbol, from_seq, to_seq): after each SUBSCRIBE up to the next command of the session on the symbol, or
    to the session's end; to_seq is null while it lasts.

    ``commands`` has seq, session_id, command and symbol, ``ended`` seq and session_id. A session that has ended follows
    nothing until it subscribes anew. A SUBSCRIBE while one is valid ends that one and begins the next.
    """
    own = commands.where(F.col("command").isin("SUBSCRIBE", "UNSUBSCRIBE")).select("session_id", "symbol", "seq", (F.col("command") == "SUBSCRIBE").alias("on"))
    if ended is not None:
        ends = own.select("session_id", "symbol").distinct().join(ended.select("session_id", "seq").distinct(), "session_id")
        own = own.unionByName(ends.withColumn("on", F.lit(False)))
    after = Window.partitionBy("session_id", "symbol").orderBy("seq", F.desc("on"))
    spans = own.withColumn("to_seq", F.lead("seq").over(after)).where("on and (to_seq is null or to_seq > seq)")
    return spans.select("session_id", "symbol", F.col("seq").alias("from_seq"), "to_seq")


def _bits(level: int) -> int:
    return BASE_BITS + BLOCK_BITS * level


def _blocks(low: Column, high: Column, level: int) -> Column:
    """The blocks of a level within [low, high) that no block of the next level within it covers; of the smallest, also those that
    it meets in part."""
    first = lambda bits: F.shiftright(low + ((1 << bits) - 1), bits)
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<long>"))
    bits = _bits(level)
    a, b = (first(bits), F.shiftright(high, bits)) if level else (F.shiftright(low, bits), F.shiftright(high - 1, bits) + 1)
    if level + 1 == LEVELS:
        return span(a, b)
    c, d = (F.shiftleft(x, BLOCK_BITS) for x in (first(_bits(level + 1)), F.shiftright(high, _bits(level + 1))))
    return F.when(c < d, F.concat(span(a, c), span(d, b))).otherwise(span(a, b))


def fan_out_as_of(events: DataFrame, valid: DataFrame) -> DataFrame:
    """A row of ``events`` (seq, symbol) for each session that follows its symbol at its seq: from_seq < seq <= to_seq.

    The events of a symbol in 2**10 seqs are one run. Every span of seqs is a few blocks of one run, of 8, of 8 * 8 and so
    on, and every run lies in one block of each size, so the interval join is an equi-join on symbol and block: a busy
    symbol and a long subscription spread over many tasks, and no pair is made that is not in the result, but at the ends
    of a span, in two runs at most. A session gets a run as a whole before the next one does; written to Parquet this takes
    a small part of a byte a row. Few blocks are large, and most of the result may be in them: their runs are dealt to
    parts, each of which meets the spans of the block. Spans are cut to the events, so that one that lasts has no blocks
    beyond them. seq is not negative and below 2**42; a command of an event's own seq comes after it.
    """
    level, block, cut, first, last, rows, low, high, run, size = fresh(events, "_level", "_block", "_cut", "_first", "_last", "_rows", "_low", "_high", "_run", "_size")
    ends = F.broadcast(events.agg(F.min("seq").alias(first), F.max("seq").alias(last)))
    known = valid.crossJoin(ends).where((F.col(last) > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("to_seq") >= F.col(first))))
    known = known.select("session_id", "symbol", F.greatest(F.col("from_seq") + 1, first).alias(low), (F.least(F.coalesce("to_seq", last), F.col(last)) + 1).alias(high))
    both = F.array(*(F.struct(F.lit(i).alias("i"), _blocks(F.col(low), F.col(high), i).alias("of")) for i in range(LEVELS)))
    spans = known.select("session_id", "symbol", low, high, F.explode(both).alias("b")).select("session_id", "symbol", low, high, F.col("b.i").alias(level), F.explode("b.of").alias(block))
    parts = F.element_at(F.array(*(F.lit(n) for n in CUTS)), F.col(level) + 1)
    spans = spans.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias(cut))
    runs = events.withColumn(run, F.shiftright("seq", BASE_BITS)).groupBy("symbol", run).agg(F.collect_list(F.struct(*(c for c in events.columns if c != "symbol"))).alias(rows))
    part = lambda i: F.pmod(F.xxhash64(run), F.lit(CUTS[i])).cast("int")
    places = F.array(*(F.struct(F.lit(i).alias(level), F.shiftright(run, BLOCK_BITS * i).alias(block), part(i).alias(cut), F.lit(1 << _bits(i)).alias(size)) for i in range(LEVELS)))
    # A block that is longer than all events is in no span.
    at = runs.crossJoin(ends).select("symbol", rows, first, last, F.inline(places)).where((F.col(level) == 0) | (F.col(size) <= F.col(last) - F.col(first) + 1)).drop(first, last, size)
    key, n = ["symbol", level, block, cut], _tasks(events)
    met = at.repartition(n, *key).join(spans.repartition(n, *key).hint("merge"), key)
    return met.select("symbol", low, high, "session_id", F.inline(rows)).where((F.col("seq") >= F.col(low)) & (F.col("seq") < F.col(high))).select(*events.columns, "session_id")
