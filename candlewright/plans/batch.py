"""Registered batch queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions import numbers as N
from candlewright.functions import time as T
from candlewright.functions.names import normalize_symbol as lower_symbol
from candlewright.operators import aggregate as A
from candlewright.operators import changelog as L
from candlewright.operators import chart as C
from candlewright.operators import late as D
from candlewright.operators import metrics as H
from candlewright.operators import ordered as O
from candlewright.operators import reconcile as R
from candlewright.sources import klines as K
from candlewright.sources import ticks as S

from .scratch import once
from .sql import ROW, with_candles, with_late, with_ticks

ALL = tuple(T.INTERVALS)
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    """Registers a query under ``name``, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return S.validate_ticks(S.event_ticks(spark, sf))[0]


def candles(spark: SparkSession, sf: str) -> DataFrame:
    return A.ohlcv_multi(valid(spark, sf))


def repaired(spark: SparkSession, sf: str) -> DataFrame:
    return D.candles_with_late(valid(spark, sf), ALL)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Repaired candles as a stored table, for queries that read them more than once."""
    return once(repaired(spark, sf))


def stored(c: DataFrame) -> DataFrame:
    """Repaired candles with every eleventh minute missing and every seventh close off by a cent."""
    minute = F.expr("start_s div 60")
    off = F.when(minute % 7 == 0, (F.col("close") + F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,6)")).otherwise(F.col("close"))
    return c.where(~((F.col("interval") == "1m") & (minute % 11 == 0))).withColumn("close", off)


def as_of(spark: SparkSession, sf: str) -> int:
    """The last 1-minute bucket of the table: one number, for parameters of chart queries.

    The tick of the latest time is on time, so its bucket has a candle; a scan of the ticks finds it.
    """
    return valid(spark, sf).agg(F.expr("max(event_ms) div 60000 * 60")).first()[0]


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    """The changelog as kline events, stored once for queries that read it several times; a closed row precedes the tick that closed it."""
    rows = once(D.candle_revisions(valid(spark, sf), ALL))
    return rows.withColumn("closed", F.col("kind") != "live").withColumn("seq", F.col("seq") * 2 + F.when(F.col("kind") == "closed", 0).otherwise(1))


EVENTS = "ev as (select *, kind <> 'live' as closed, seq * 2 + case kind when 'closed' then 0 else 1 end as eseq from rev)"

# Sources


@query("read_trade_json", with_ticks("select seq, symbol, cast(price as decimal(38,18)) as price, cast(quantity as decimal(38,18)) as quantity, event_ms from ticks where seq % 13 <> 0 and seq % 17 <> 0"))
def read_trade_json(spark, sf):
    t = S.event_ticks(spark, sf)
    body = F.to_json(F.struct(F.struct(F.upper("symbol").alias("s"), F.col("price").cast("string").alias("p"), F.when(F.col("seq") % 17 != 0, F.col("quantity").cast("string")).alias("q"), F.col("event_ms").alias("E")).alias("data")))
    return S.read_trade_json(t.select("seq", F.when(F.col("seq") % 13 == 0, "{broken").otherwise(body).alias("value")))


FRAMES = with_ticks("select seq, symbol, cast(price as decimal(38,18)) as price, cast(quantity as decimal(38,18)) as quantity, event_ms from v where seq % 19 <> 0")


def with_invalid(spark, sf):
    """(frames, rejected) of all ticks and of a copy of every twenty-third with a price of 0."""
    t = S.event_ticks(spark, sf)
    worthless = t.where("seq % 23 = 0").withColumn("price", F.lit(0).cast("decimal(18,6)"))
    return S.encode_tick_frames(t.union(worthless))


@query("tick_frames_round_trip", FRAMES)
def tick_frames_round_trip(spark, sf):
    framed = with_invalid(spark, sf)[0].select("seq", "payload")
    bad = F.when(F.col("seq") % 19 == 0, F.unhex(F.lit("0203"))).otherwise(F.col("payload"))
    return S.decode_tick_frames(framed.withColumn("payload", bad))[0]


@query("tick_frames_rejected", with_ticks("select seq from v where seq % 19 = 0"))
def tick_frames_rejected(spark, sf):
    framed = with_invalid(spark, sf)[0].select("seq", "payload")
    bad = F.when(F.col("seq") % 19 == 0, F.unhex(F.lit("0203"))).otherwise(F.col("payload"))
    return S.decode_tick_frames(framed.withColumn("payload", bad))[1].select("seq")


def kline_rows(spark, sf):
    """1-minute candles as an exchange returns them: arrays of texts, one JSON array for each hour and symbol."""
    c = candles(spark, sf).where("interval = '1m'")
    text = lambda c_: F.col(c_).cast("string")
    row = F.array((F.col("start_s") * 1000).cast("string"), text("open"), text("high"), text("low"), text("close"), N.unscale_volume(F.col("volume")).cast("string"), (F.col("close_s") * 1000 + 999).cast("string"), F.lit("0"), text("trades"), F.lit("0"), F.lit("0"))
    return c.groupBy("symbol", F.expr("start_s div 3600").alias("hour")).agg(F.to_json(F.collect_list(row)).alias("value")).drop("hour")


def exchange(spark, sf):
    return K.read_exchange_klines(kline_rows(spark, sf))


EXCHANGE = """select symbol, start_s * 1000 as open_ms, cast(open as decimal(38,18)) as open, cast(high as decimal(38,18)) as high, cast(low as decimal(38,18)) as low,
cast(close as decimal(38,18)) as close, cast(cast(volume as decimal(28,8)) * 0.00000001 as decimal(38,18)) as volume, close_s * 1000 + 999 as close_ms, cast(trades as integer) as trades
from c where interval = '1m'"""
EXCHANGE_COLUMNS = ("symbol", "open_ms", "open", "high", "low", "close", "volume", "close_ms", "trades")


@query("read_exchange_klines", with_candles(EXCHANGE))
def read_exchange_klines(spark, sf):
    return exchange(spark, sf).select(*EXCHANGE_COLUMNS)


RANGE = (1704067200000 + 600_000, 1704067200000 + 3_000_000)


@query("kline_range", with_candles(f"select * from ({EXCHANGE}) where open_ms between {RANGE[0]} and {RANGE[1]} and symbol = 'click'"))
def kline_range(spark, sf):
    return K.kline_range(exchange(spark, sf), *RANGE, "click").select(*EXCHANGE_COLUMNS)


SYMBOLS = "s as (select row_number() over (order by symbol) as id, symbol from (select distinct symbol from ticks))"


@query("symbols", with_ticks(f", {SYMBOLS} select * from s"))
def symbols(spark, sf):
    return K.find_symbols(K.symbols(S.event_ticks(spark, sf)))


@query("symbol_lookup", with_ticks(f", {SYMBOLS} select * from s where id = 2 union all select * from s where symbol = 'view'"))
def symbol_lookup(spark, sf):
    dim = K.symbols(S.event_ticks(spark, sf))
    return K.get_symbol(dim, id=2).union(K.get_symbol(dim, symbol="view"))


@query("unknown_symbols", with_ticks("select seq, symbol from ticks where symbol = 'error'"))
def unknown_symbols(spark, sf):
    t = S.event_ticks(spark, sf)
    return K.unknown_symbols(t, K.symbols(t.where("symbol <> 'error'"))).select("seq", "symbol")


@query("with_symbol", with_ticks(f", {SYMBOLS} select seq, symbol, id as symbol_id from ticks join s using (symbol)"))
def with_symbol(spark, sf):
    t = S.event_ticks(spark, sf)
    return K.with_symbol(t, K.symbols(t)).select("seq", "symbol", "symbol_id")


SCAN = (1704067200 + 1800, 1704067200 + 5400)


@query("scan_candles", with_candles(f"select {ROW} from c where interval = '5m' and start_s >= {SCAN[0]} and start_s < {SCAN[1]}"))
def scan_candles(spark, sf):
    return K.scan_candles(candles(spark, sf), "5m", *SCAN)


@query("lookup_candle", with_candles(f"select {ROW} from c where interval = '30m' and symbol = 'click' and start_s = {SCAN[0]}"))
def lookup_candle(spark, sf):
    return K.lookup_candle(candles(spark, sf), "30m", "click", SCAN[0])


# Scalars


@query("validate_ticks", with_ticks("select seq, seq in (select seq from v) as valid from ticks"))
def validate_ticks(spark, sf):
    good, bad = S.validate_ticks(S.event_ticks(spark, sf))
    return good.select("seq", F.lit(True).alias("valid")).union(bad.select("seq", F.lit(False).alias("valid")))


@query("rejected_ticks", with_ticks("select seq from ticks where seq not in (select seq from v) union all select seq from ticks where seq % 23 = 0"))
def rejected_ticks(spark, sf):
    """What cannot be a frame: invalid ticks, and the worthless copies put among them."""
    return with_invalid(spark, sf)[1].select("seq")


@query("volume_scaling_wide", with_ticks("select seq, units + cast(1 as bigint) as units from v"))
def volume_scaling_wide(spark, sf):
    """Quantities of 18 decimals, a little under the next unit but one; the sum is decimal(29,18), so Spark rounds nothing."""
    wide = F.col("quantity").cast("decimal(18,8)") + F.lit("0.000000019999999999").cast("decimal(18,18)")
    return valid(spark, sf).select("seq", N.scale_volume(wide).alias("units"))


@query("normalize_symbol", with_ticks("select seq, lower(upper(symbol)) as symbol from ticks"))
def normalize_symbol(spark, sf):
    return S.event_ticks(spark, sf).select("seq", lower_symbol(F.upper("symbol")).alias("symbol"))


@query("bucket_bounds", with_candles("select seq, interval, start_s, cast(start_s + d - 1 as bigint) as close_s from b"))
def bucket_bounds(spark, sf):
    b = A.with_bucket(A.expand_intervals(valid(spark, sf)))
    return b.select("seq", "interval", "start_s", T.bucket_close(F.col("start_s"), A.interval_seconds()).alias("close_s"))


@query("truncate_times", "select event_id, time_bucket(interval '1 minute', ts) as t1, time_bucket(interval '5 minutes', ts) as t5, time_bucket(interval '30 minutes', ts) as t30 from events")
def truncate_times(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", T.to_1m(F.col("ts")).alias("t1"), T.to_5m(F.col("ts")).alias("t5"), T.resolve_bucket("30m", F.col("ts")).alias("t30"))


@query("volume_scaling", with_ticks("select seq, units, cast(cast(units as decimal(28,8)) * 0.00000001 as decimal(28,8)) as quantity from v"))
def volume_scaling(spark, sf):
    t = valid(spark, sf).select("seq", N.scale_volume(F.col("quantity")).alias("units"))
    return t.select("seq", "units", N.unscale_volume(F.col("units")).alias("quantity"))


@query("epoch_conversion", "select event_id, epoch_us(ts) // 1000 as ms, make_timestamp(epoch_us(ts) // 1000 * 1000) as back from events")
def epoch_conversion(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", T.ntz_to_millis(F.col("ts")).alias("ms"))
    return e.select("event_id", "ms", T.millis_to_ntz(F.col("ms")).alias("back"))


@query("expand_intervals", with_candles("select seq, interval from b"))
def expand_intervals(spark, sf):
    return A.expand_intervals(valid(spark, sf)).select("seq", "interval")


CHART_ROW = "symbol, interval, start_s as time_s, open, high, low, close, cast(cast(volume as decimal(28,8)) * 0.00000001 as decimal(28,8)) as volume"


@query("chart_candle", with_candles(f"select {CHART_ROW} from c"))
def chart_candle(spark, sf):
    return C.chart_candle(candles(spark, sf))


@query("candle_direction", with_candles("select symbol, interval, start_s, case when close >= open then 'up' else 'down' end as direction from c"))
def candle_direction(spark, sf):
    return candles(spark, sf).select("symbol", "interval", "start_s", N.candle_direction(F.col("open"), F.col("close")).alias("direction"))


#: Half up to 4 decimals in whole numbers: prices have 6 decimals.
PERCENT = """case when {o} = 0 then cast(0 as decimal(18,4)) else cast(
  sign(cast(({c} - {o}) * 1000000 as hugeint)) * ((abs(cast(({c} - {o}) * 1000000 as hugeint)) * 1000000 * 2 + cast({o} * 1000000 as hugeint)) // (2 * cast({o} * 1000000 as hugeint)))
  as decimal(38,0)) * 0.0001 end"""


def percent_sql(open_: str, current: str) -> str:
    return f"cast({PERCENT.format(o=open_, c=current)} as decimal(18,4))"


@query("change_percent", with_candles(f"select symbol, interval, start_s, {percent_sql('open', 'close')} as change from c"))
def change_percent(spark, sf):
    return candles(spark, sf).select("symbol", "interval", "start_s", N.change_percent(F.col("open"), F.col("close")).alias("change"))


@query("null_safe_extremes", with_candles("select symbol, interval, start_s, greatest(case when trades > 1 then high end, close) as hi, least(case when trades > 1 then low end, open) as lo from c"))
def null_safe_extremes(spark, sf):
    c = candles(spark, sf)
    many = lambda name: F.when(F.col("trades") > 1, F.col(name))
    return c.select("symbol", "interval", "start_s", N.null_safe_max(many("high"), F.col("close")).alias("hi"), N.null_safe_min(many("low"), F.col("open")).alias("lo"))


# Aggregations

for _name in ALL:
    QUERIES[f"ohlcv_m{_name[:-1]}"] = lambda spark, sf, i=_name: A.ohlcv(valid(spark, sf), i)
    SQL[f"ohlcv_m{_name[:-1]}"] = with_candles(f"select {ROW} from c where interval = '{_name}'")


@query("ohlcv_multi", with_candles(f"select {ROW} from c"))
def ohlcv_multi(spark, sf):
    return candles(spark, sf)


STATS = (1704067200 + 1234 // 60 * 60, 1704067200 + 86400)


@query("range_stats", with_candles(f"""select symbol, min(start_s) as first_s, max(start_s) as last_s, arg_min(open, start_s) as open, max(high) as high, min(low) as low,
arg_max(close, start_s) as close, cast(sum(volume) as bigint) as volume from c where interval = '1m' and start_s >= {STATS[0]} and start_s < {STATS[1]} group by symbol"""))  # fmt: skip
def range_stats(spark, sf):
    return A.range_stats(candles(spark, sf).where("interval = '1m'"), *STATS)


@query("range_aggregate", with_candles(f"""select 1 as part, max(high) as high, min(low) as low, cast(sum(volume) as bigint) as volume from c where interval = '1m' and start_s >= {STATS[0]} and start_s < {STATS[1]}
union all select 2, max(high), min(low), cast(sum(volume) as bigint) from c where start_s < 0"""))  # fmt: skip
def range_aggregate(spark, sf):
    c = candles(spark, sf)
    some, none = A.range_aggregate(c.where("interval = '1m'"), *STATS), A.range_aggregate(c, -10, 0)
    return some.select(F.lit(1).alias("part"), "*").union(none.select(F.lit(2).alias("part"), "*"))


def rollup_sql(source: str, interval: str, d: int) -> str:
    return f"""select symbol, '{interval}' as interval, start_s // {d} * {d} as start_s, start_s // {d} * {d} + {d - 1} as close_s, arg_min(open, start_s) as open, max(high) as high,
min(low) as low, arg_max(close, start_s) as close, cast(sum(volume) as bigint) as volume, cast(sum(trades) as bigint) as trades from {source} where interval = '1m' group by symbol, start_s // {d} * {d}"""


@query("rollup_candles", with_late(f"select * from ({rollup_sql('lc', '5m', 300)}) union all select * from ({rollup_sql('lc', '30m', 1800)})"))
def rollup_candles(spark, sf):
    c = kept(spark, sf)
    return A.rollup(c, "5m").union(A.rollup(c, "30m"))


DAY = 86_400_000


def live_of(c: DataFrame, end: int) -> DataFrame:
    """The open candle of the last minute of each symbol."""
    return c.where((F.col("interval") == "1m") & (F.col("start_s") == end))


STATS_24H = f""", w as (select (last_s + 20) * 1000 as as_of_ms, last_s as minute from lim),
fin as (select symbol, arg_min(open, start_s) as open, max(high) as high, min(low) as low, arg_max(close, start_s) as close, cast(sum(volume) as bigint) as volume
        from lc, w where interval = '1m' and start_s * 1000 >= as_of_ms - {DAY} and start_s < minute group by symbol),
live as (select lc.* from lc, w where interval = '1m' and start_s = minute),
st as (select coalesce(fin.symbol, live.symbol) as symbol, coalesce(fin.open, live.open) as open, coalesce(live.close, fin.close) as current, greatest(fin.high, live.high) as high,
  least(fin.low, live.low) as low, cast(cast(coalesce(fin.volume, 0) + coalesce(live.volume, 0) as decimal(28,8)) * 0.00000001 as decimal(28,8)) as volume,
  as_of_ms - {DAY} as window_start_ms, minute * 1000 as window_end_ms, live.start_s as live_s, cast(cast(coalesce(live.volume, 0) as decimal(28,8)) * 0.00000001 as decimal(28,8)) as live_volume
  from fin full join live using (symbol) cross join w)"""


@query("stats_24h", with_late(STATS_24H + f" select *, {percent_sql('open', 'current')} as change_percent from st"))
def stats_24h(spark, sf):
    return _stats_24h(kept(spark, sf), as_of(spark, sf))


def _stats_24h(c: DataFrame, end: int) -> DataFrame:
    return C.stats_24h(c, live_of(c, end), (end + 20) * 1000)


@query("checked_volume", with_ticks("select symbol, cast(sum(units) as bigint) as volume from v group by symbol"))
def checked_volume(spark, sf):
    return A.lenient_volume(valid(spark, sf))


# Ordered operators


@query("first_and_last", with_candles(f"""select * from (select symbol, 'first' as which, start_s, open, high, low, close, volume from c where interval = '1m' and start_s >= {STATS[0]} and start_s < {STATS[1]}
qualify row_number() over (partition by symbol order by start_s) = 1) union all select * from (select symbol, 'last', start_s, open, high, low, close, volume from c where interval = '1m' and start_s >= {STATS[0]} and start_s < {STATS[1]}
qualify row_number() over (partition by symbol order by start_s desc) = 1)"""))  # fmt: skip
def first_and_last(spark, sf):
    return A.first_and_last(candles(spark, sf).where("interval = '1m'"), *STATS)


@query("classify_late", with_late("select seq, interval, start_s, high_s, start_s = high_s as on_time from m"))
def classify_late(spark, sf):
    return D.classify_late(valid(spark, sf), ALL).select("seq", "interval", "start_s", "high_s", "on_time")


@query("apply_late", with_late("select seq, symbol, interval, start_s, fate from f"))
def apply_late(spark, sf):
    return D.apply_late(valid(spark, sf), ALL).select("seq", "symbol", "interval", "start_s", "fate")


@query("late_fates", with_late("select interval, fate, count(*) as ticks, count(distinct (symbol, start_s)) as candles from f group by all"))
def late_fates(spark, sf):
    fated = D.apply_late(valid(spark, sf), ALL)
    return fated.groupBy("interval", "fate").agg(F.count("*").alias("ticks"), F.count_distinct("symbol", "start_s").alias("candles"))


@query("candles_with_late", with_late(f"select {ROW} from lc"))
def candles_with_late(spark, sf):
    return repaired(spark, sf)


REVISION = "symbol, interval, start_s, cast(start_s + d - 1 as bigint) as close_s, seq, kind, open, high, low, close, volume, trades"


@query("candle_revisions", with_late(f"select {REVISION} from rev"))
def candle_revisions(spark, sf):
    return D.candle_revisions(valid(spark, sf), ALL)


@query("monotonic_ticker", with_ticks("""select seq, symbol, event_ms from v qualify event_ms >= coalesce(max(event_ms) over (partition by symbol order by seq rows between unbounded preceding and 1 preceding), event_ms)"""))
def monotonic_ticker(spark, sf):
    return O.monotonic_ticker(valid(spark, sf)).select("seq", "symbol", "event_ms")


THROTTLE = with_late(f""", {EVENTS},
t as (select symbol, interval, eseq as seq, closed, seq * 37 as at_ms, row_number() over (partition by symbol, interval order by eseq) as n from ev),
r as (select symbol, interval, start_n, list(struct_pack(seq := seq, at_ms := at_ms, closed := closed) order by seq) as xs
      from (select *, 1 as start_n from t) group by all),
g as (select symbol, interval, list_reduce(list_prepend(struct_pack(last := cast(-100000 as bigint), outs := cast([] as bigint[]), seq := cast(0 as bigint), at_ms := cast(0 as bigint), closed := false),
       list_transform(xs, lambda x: struct_pack(last := cast(0 as bigint), outs := cast([] as bigint[]), seq := x.seq, at_ms := cast(x.at_ms as bigint), closed := x.closed))),
       lambda a, x: struct_pack(last := case when x.closed or x.at_ms - a.last >= 250 then x.at_ms else a.last end,
         outs := case when x.closed or x.at_ms - a.last >= 250 then list_append(a.outs, x.seq) else a.outs end, seq := x.seq, at_ms := x.at_ms, closed := x.closed)) as acc from r)
select symbol, interval, unnest(acc.outs) as seq from g""")


@query("throttle_klines", THROTTLE)
def throttle_klines(spark, sf):
    e = events_log(spark, sf).withColumn("at_ms", F.expr("(seq div 2) * 37"))
    return O.throttle_klines(e.select("symbol", "interval", "seq", "at_ms", "closed")).select("symbol", "interval", "seq")


@query("latest_n", with_candles(f"select {ROW} from c qualify row_number() over (partition by symbol, interval order by start_s desc) <= 50"))
def latest_n(spark, sf):
    return O.latest_n(candles(spark, sf), 50)


@query("dedupe_keep_last", with_ticks("select event_ms // 1000 as second, symbol, seq, price from v qualify row_number() over (partition by symbol, event_ms // 1000 order by seq desc) = 1"))
def dedupe_keep_last(spark, sf):
    t = valid(spark, sf).select(F.expr("event_ms div 1000").alias("second"), "symbol", "seq", "price")
    return O.dedupe_keep_last(t, ["symbol", "second"], "seq")


@query("forward_fill", with_candles("""
, n as (select c.*, iv.d, lead(start_s) over (partition by symbol, interval order by start_s) as next_s from c join iv using (interval)),
x as (select *, unnest(range(start_s, coalesce(next_s, start_s + d), d)) as at_s from n)
select symbol, interval, at_s as start_s, cast(at_s + d - 1 as bigint) as close_s, case when at_s > start_s then close else open end as open, case when at_s > start_s then close else high end as high,
  case when at_s > start_s then close else low end as low, close, case when at_s > start_s then 0 else volume end as volume, case when at_s > start_s then 0 else trades end as trades, at_s > start_s as is_ghost from x"""))
def forward_fill(spark, sf):
    return O.forward_fill(candles(spark, sf))


@query("price_direction", with_ticks("""
, p as (select seq, symbol, price, lag(price) over (partition by symbol order by seq) as was from v)
select seq, symbol, price, coalesce(last_value(case when price > was then 'up' when price < was then 'down' end ignore nulls) over (partition by symbol order by seq rows between unbounded preceding and current row), 'neutral') as direction from p"""))
def price_direction(spark, sf):
    return O.price_direction(valid(spark, sf).select("seq", "symbol", "price"))


CROSS = with_ticks("""
, r as (select seq, symbol, cast(seq % 1000 * 250 as bigint) as lag, cast(seq % 1000 * 250 as bigint) / 200000.0 as ratio from ticks),
x as (select *, ratio >= 0.8 as high, coalesce(lag(ratio >= 0.8) over (partition by symbol order by seq), false) as was from r)
select seq, symbol, lag, cast(ratio as double) as ratio, case when high then 'alert' else 'recovery' end as event from x where high <> was""")


@query("threshold_crossings", CROSS)
def threshold_crossings(spark, sf):
    lagged = S.event_ticks(spark, sf).select("seq", "symbol", (F.col("seq") % 1000 * 250).alias("lag"))
    return O.threshold_crossings(H.backlog_ratio(lagged), 0.8, ("symbol",))


LIVE_COLUMNS = ("symbol", "interval", "start_s", "close", "volume", "trades")


@query("materialize_finalized", with_late(f""", {EVENTS} select symbol, interval, start_s, close, volume, trades from
(select * from ev where closed qualify row_number() over (partition by symbol, interval, start_s order by eseq desc) = 1) qualify row_number() over (partition by symbol, interval order by start_s desc) <= 1000"""))
def materialize_finalized(spark, sf):
    return L.finalized(events_log(spark, sf)).select(*LIVE_COLUMNS)


@query("materialize_live", with_late(f""", {EVENTS}, li as (select * from ev where not closed qualify row_number() over (partition by symbol, interval order by eseq desc) = 1)
select symbol, interval, start_s, close, volume, trades from li where not exists (select 1 from ev where ev.closed and ev.symbol = li.symbol and ev.interval = li.interval and ev.start_s = li.start_s and ev.eseq > li.eseq)"""))
def materialize_live(spark, sf):
    return L.materialized_live(events_log(spark, sf)).select(*LIVE_COLUMNS)


@query("live_candles", with_late(f""", {EVENTS} select symbol, interval, start_s, close, volume, trades from ev where not closed qualify row_number() over (partition by symbol, interval order by eseq desc) = 1"""))
def live_candles(spark, sf):
    return L.live_candles(events_log(spark, sf)).select(*LIVE_COLUMNS)


@query("clear_live", with_late(f""", {EVENTS} select symbol, interval, start_s, close, volume, trades from (select * from ev where not closed qualify row_number() over (partition by symbol, interval order by eseq desc) = 1)
where (symbol, interval, start_s) not in (select symbol, interval, max(start_s) from lc where interval = '5m' group by all)"""))
def clear_live(spark, sf):
    last = repaired(spark, sf).where("interval = '5m'").groupBy("symbol", "interval").agg(F.max("start_s").alias("start_s"))
    return L.clear_if_bucket_matches(L.live_candles(events_log(spark, sf)), last).select(*LIVE_COLUMNS)


WINDOW_SQL = f"select {ROW} from (select * from stored qualify row_number() over (partition by symbol, interval order by start_s desc) <= 200)"


@query("hot_window_put", with_late(f""", hw as ({WINDOW_SQL}), ch as (select {ROW} from lc where start_s // 60 % 7 = 0)
select * from (select * from hw where (symbol, interval, start_s) not in (select symbol, interval, start_s from ch) union all select * from ch) qualify row_number() over (partition by symbol, interval order by start_s desc) <= 200"""))
def hot_window_put(spark, sf):
    c = kept(spark, sf)
    window = O.latest_n(stored(c), 200)
    return L.put_bucket(window, c.where(F.expr("start_s div 60") % 7 == 0), 200)


@query("hot_window_put_range", with_late(f""", hw as ({WINDOW_SQL}), ch as (select {ROW} from lc where start_s % 9000 = 1800 and start_s >= (select last_s - 7200 from lim)),
sp as (select symbol, interval, min(start_s) as lo, max(start_s) as hi from ch group by all)
select * from (select hw.* from hw left join sp using (symbol, interval) where lo is null or start_s < lo or start_s > hi union all select * from ch) qualify row_number() over (partition by symbol, interval order by start_s desc) <= 200"""))
def hot_window_put_range(spark, sf):
    c = kept(spark, sf)
    window = O.latest_n(stored(c), 200)
    batch = c.where((F.col("start_s") % 9000 == 1800) & (F.col("start_s") >= as_of(spark, sf) - 7200))
    return L.put_range(window, batch, 200)


def messages(spark, sf):
    rows = candles(spark, sf).withColumn("closed", F.lit(True)).withColumn("volume", N.unscale_volume(F.col("volume")))
    ticks = valid(spark, sf).select("symbol", "price", F.col("quantity").alias("volume"), "event_ms")
    return L.kline_json(rows).union(L.ticker_json(ticks))


@query("kline_messages", with_candles("select symbol, interval, start_s, close_s, open, high, low, close, cast(cast(volume as decimal(28,8)) * 0.00000001 as decimal(28,8)) as volume, trades, true as closed from c"))
def kline_messages(spark, sf):
    return L.classify_messages(messages(spark, sf))[0]


@query("ticker_messages", with_ticks("select symbol, cast(price as decimal(38,18)) as price, cast(quantity as decimal(38,18)) as volume, event_ms from v"))
def ticker_messages(spark, sf):
    return L.classify_messages(messages(spark, sf))[1]


# Joins


@query("reconcile_changes", with_late("""select lc.symbol, lc.interval, lc.start_s, lc.open, lc.high, lc.low, lc.close, lc.volume from lc left join stored s using (symbol, interval, start_s)
where lc.interval = '1m' and (s.close is null or s.open <> lc.open or s.high <> lc.high or s.low <> lc.low or s.close <> lc.close or s.volume <> lc.volume)"""))
def reconcile_changes(spark, sf):
    c = kept(spark, sf)
    return R.reconcile(stored(c), c.where("interval = '1m'"))[0]


@query("reconcile_audit", with_late("""select lc.symbol, lc.interval, lc.start_s, case when s.close is null then 'MISSING' else 'MISMATCH' end as reason, lc.close as expected_close, s.close as actual_close
from lc left join stored s using (symbol, interval, start_s)
where lc.interval = '1m' and (s.close is null or s.open <> lc.open or s.high <> lc.high or s.low <> lc.low or s.close <> lc.close or s.volume <> lc.volume)"""))
def reconcile_audit(spark, sf):
    c = kept(spark, sf)
    return R.reconcile(stored(c), c.where("interval = '1m'"))[1]


@query("rollup_changed_only", with_late(f""", r as ({rollup_sql('lc', '5m', 300)})
select r.symbol, r.interval, r.start_s, r.open, r.high, r.low, r.close, r.volume from r left join stored s using (symbol, interval, start_s)
where s.close is null or s.open <> r.open or s.high <> r.high or s.low <> r.low or s.close <> r.close or s.volume <> r.volume"""))
def rollup_changed_only(spark, sf):
    c = kept(spark, sf)
    return R.changed_only(A.rollup(c, "5m"), stored(c))


@query("upsert_candles", with_late("""select coalesce(s.symbol, n.symbol) as symbol, coalesce(s.interval, n.interval) as interval, coalesce(s.start_s, n.start_s) as start_s, coalesce(n.open, s.open) as open, coalesce(n.high, s.high) as high,
coalesce(n.low, s.low) as low, coalesce(n.close, s.close) as close, coalesce(n.volume, s.volume) as volume, cast(case when s.symbol is not null and n.symbol is not null then 1 else 0 end as bigint) as version
from stored s full join (select * from lc where start_s // 60 % 3 = 0) n on s.symbol = n.symbol and s.interval = n.interval and s.start_s = n.start_s"""))
def upsert_candles(spark, sf):
    c = kept(spark, sf)
    changes = c.where(F.expr("start_s div 60") % 3 == 0)
    odd = changes.withColumn("interval", F.lit("7m"))
    return R.upserted(stored(c).withColumn("version", F.lit(0).cast("long")), changes.unionByName(odd))


RUN_SQL = f""", w as (select last_s - 60 - 7200 as a, last_s - 60 as z from lim),
fe as (select lc.* from lc, w where interval = '1m' and start_s >= a and start_s < z),
ch as (select fe.symbol, fe.interval, fe.start_s, fe.open, fe.high, fe.low, fe.close, fe.volume, s.close as was from fe left join stored s using (symbol, interval, start_s)
       where s.close is null or s.open <> fe.open or s.high <> fe.high or s.low <> fe.low or s.close <> fe.close or s.volume <> fe.volume),
co as (select symbol, interval, start_s, open, high, low, close, volume, 0 as trades from stored where interval = '1m' and (symbol, start_s) not in (select symbol, start_s from ch)
       union all select symbol, interval, start_s, open, high, low, close, volume, 0 from ch),
ro as (select * from ({rollup_sql("(select co.* from co, w where start_s >= a // 300 * 300)", "5m", 300)}) where start_s >= (select a // 300 * 300 from w) and start_s + 300 <= (select z from w)
       union all select * from ({rollup_sql("(select co.* from co, w where start_s >= a // 1800 * 1800)", "30m", 1800)}) where start_s >= (select a // 1800 * 1800 from w) and start_s + 1800 <= (select z from w))"""


@query("reconciliation_run", with_late(RUN_SQL + """ select symbol, interval, start_s, open, high, low, close, volume from ch
union all select r.symbol, r.interval, r.start_s, r.open, r.high, r.low, r.close, r.volume from ro r left join stored s using (symbol, interval, start_s)
where s.close is null or s.open <> r.open or s.high <> r.high or s.low <> r.low or s.close <> r.close or s.volume <> r.volume"""))
def reconciliation_run(spark, sf):
    c = kept(spark, sf)
    return R.reconciliation_run(stored(c), c.where("interval = '1m'"), as_of(spark, sf) * 1000 + 5000)[0]


@query("reconciliation_audit", with_late(RUN_SQL + " select symbol, interval, start_s, case when was is null then 'MISSING' else 'MISMATCH' end as reason, close as expected_close, was as actual_close from ch"))
def reconciliation_audit(spark, sf):
    c = kept(spark, sf)
    return R.reconciliation_run(stored(c), c.where("interval = '1m'"), as_of(spark, sf) * 1000 + 5000)[1]


TARGETS = (1704067200_000 + 200_000, 1704067200_000 + 7_260_000)


@query("rollup_targets", with_candles(f"""select symbol, '5m' as interval, x as start_s from (select distinct symbol from ticks), (select unnest(range({TARGETS[0] // 1000 // 300 * 300}, {TARGETS[1] // 1000 - 300} + 1, 300)) as x)"""))
def rollup_targets(spark, sf):
    return R.rollup_targets(K.symbols(S.event_ticks(spark, sf)), "5m", *TARGETS)


SUBSCRIPTIONS = """, cmd as (select seq, cast(user_id as varchar) as session_id, case event_type when 'click' then 'SUBSCRIBE' else 'UNSUBSCRIBE' end as command, 's' || (seq % 5) as symbol from ticks where event_type in ('click', 'view')),
sub as (select session_id, symbol from (select * from cmd qualify row_number() over (partition by session_id, symbol order by seq desc) = 1) where command = 'SUBSCRIBE' and session_id not in (select cast(user_id as varchar) from ticks where event_type = 'error' and seq % 50 = 0))"""


def subscriptions(spark, sf):
    t = S.event_ticks(spark, sf)
    cmd = t.where("symbol in ('click', 'view')").select("seq", F.col("user_id").cast("string").alias("session_id"), F.when(F.col("symbol") == "click", "SUBSCRIBE").otherwise("UNSUBSCRIBE").alias("command"), F.concat(F.lit("s"), F.col("seq") % 5).alias("symbol"))
    ended = t.where("symbol = 'error' and seq % 50 = 0").select(F.col("user_id").cast("string").alias("session_id")).distinct()
    return L.active_subscriptions(cmd, ended)


@query("active_subscriptions", with_ticks(SUBSCRIPTIONS + " select * from sub"))
def active_subscriptions(spark, sf):
    return subscriptions(spark, sf)


@query("fan_out", with_ticks(SUBSCRIPTIONS + " select t.seq, sub.symbol, session_id from ticks t join sub on sub.symbol = 's' || (t.seq % 5)"))
def fan_out(spark, sf):
    events = S.event_ticks(spark, sf).select("seq", F.concat(F.lit("s"), F.col("seq") % 5).alias("symbol"))
    return L.fan_out(events, subscriptions(spark, sf)).select("seq", "symbol", "session_id")


OVERLAY = STATS_24H + f""", kl as (select symbol, start_s, high, low, close, volume * 2 as volume from (select * from lc where interval = '1m' qualify row_number() over (partition by symbol order by start_s desc) = 1)),
tk as (select symbol, price from v qualify row_number() over (partition by symbol order by seq desc) = 1),
j as (select st.*, kl.start_s as ks, kl.high as kh, kl.low as kl_, cast(cast(kl.volume as decimal(28,8)) * 0.00000001 as decimal(28,8)) as kv, cast(coalesce(tk.price, kl.close, st.current) as decimal(18,6)) as p
      from st left join kl on kl.symbol = st.symbol left join tk on tk.symbol = st.symbol)
select symbol, open, p as current, greatest(high, kh, p) as high, least(low, kl_, p) as low, cast(case when ks = live_s then volume - live_volume + greatest(live_volume, kv)
  when ks > coalesce(live_s, window_end_ms // 1000 - 1) then volume + kv else volume end as decimal(28,8)) as volume, {percent_sql('open', 'p')} as change_percent from j"""


@query("stats_overlay", with_late(OVERLAY))
def stats_overlay(spark, sf):
    c = kept(spark, sf)
    last = C.newest(c.where("interval = '1m'"), "start_s").withColumn("volume", F.col("volume") * 2)
    return C.stats_overlay(_stats_24h(c, as_of(spark, sf)), last, C.newest(valid(spark, sf)))


# Chart queries

CHART = "symbol, interval, start_s, open, high, low, close, volume"


@query("chart_hot", with_late(f"select {CHART} from lc where symbol = 'click' and interval = '1m' and start_s < (select last_s - 3000 from lim) order by start_s desc limit 120"))
def chart_hot(spark, sf):
    end = as_of(spark, sf)
    return C.chart_hot(repaired(spark, sf), "click", "1m", 120, end, end - 3000)


@query("chart_cold", with_late(f"select {CHART} from lc where symbol = 'click' and interval = '1m' and start_s < (select last_s - 30000 from lim) and start_s >= (select last_s - 30000 - 7200 from lim)"))
def chart_cold(spark, sf):
    end = as_of(spark, sf)
    return C.chart_cold(repaired(spark, sf), "click", "1m", 120, end, end - 30000)


@query("chart", with_late(f""", h as (select {CHART} from lc where symbol = 'click' and interval = '1m' and start_s < (select last_s from lim) order by start_s desc limit 60)
select * from h union all select {CHART} from lc where symbol = 'click' and interval = '1m' and start_s = (select last_s from lim)"""))
def chart(spark, sf):
    c, end = kept(spark, sf), as_of(spark, sf)
    return C.chart(c, live_of(c, end), "click", "1m", 60, end)


@query("merge_live", with_late(f"select {CHART} from stored where interval = '1m' and start_s <> (select last_s from lim) union all select {CHART} from lc where interval = '1m' and start_s = (select last_s from lim)"))
def merge_live(spark, sf):
    c, end = kept(spark, sf), as_of(spark, sf)
    return C.merge_live(stored(c).where(F.col("interval") == "1m"), live_of(c, end), end)


@query("page_back", with_late(f""", l as (select {CHART} from stored where symbol = 'click' and interval = '5m' and start_s >= (select last_s // 300 * 300 - 3000 from lim)),
p as (select {CHART} from lc where symbol = 'click' and interval = '5m' and start_s < (select last_s // 300 * 300 - 3000 from lim) order by start_s desc limit 120) select * from l union all select * from p"""))
def page_back(spark, sf):
    end = as_of(spark, sf)
    oldest = end // 300 * 300 - 3000
    c = kept(spark, sf)
    loaded = stored(c).where((F.col("symbol") == "click") & (F.col("interval") == "5m") & (F.col("start_s") >= oldest))
    return C.page_back(c, loaded, "click", "5m", oldest, end)


@query("load_windows", with_late(f"select {ROW} from lc qualify row_number() over (partition by symbol, interval order by start_s desc) <= 1000"))
def load_windows(spark, sf):
    return C.load_windows(repaired(spark, sf))


# Operations

SAMPLES = "sa as (select ts, 'app' || (seq % 3) as application, cast(seq % 5000 as double) as counter, value, event_type, seq, epoch_ms(ts) // 60000 * 60 as minute_s from ticks)"


def samples(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet")
    return t.select("ts", F.concat(F.lit("app"), F.col("event_id") % 3).alias("application"), (F.col("event_id") % 5000).cast("double").alias("counter"), "value", "event_type", F.col("event_id").alias("seq"))


def increase_sql(value: str) -> str:
    return f"""select application, minute_s, sum(case when b is null then 0.0 when x < b then x else x - b end) as increase from
(select application, minute_s, {value} as x, lag({value}) over (partition by application order by ts, {value}) as b from sa) group by all"""


@query("counter_rate", with_ticks(f", {SAMPLES} select application, minute_s, cast(increase as double) as increase from ({increase_sql('counter')})"))
def counter_rate(spark, sf):
    return H.counter_increase(samples(spark, sf).select("ts", "application", F.col("counter").alias("value")), ("application",))


@query("latency_percentiles", """select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by event_type""")
def latency_percentiles(spark, sf):
    return H.latency_percentiles(spark.read.parquet(f"{sf}/events.parquet"), ("event_type",))


@query("mean_latency", with_ticks(f""", {SAMPLES}, s1 as ({increase_sql('counter * 3')}), c1 as ({increase_sql('counter')})
select application, minute_s, case when c1.increase > 0 then cast(s1.increase as double) / cast(c1.increase as double) end as mean_latency from s1 join c1 using (application, minute_s)"""))
def mean_latency(spark, sf):
    s = samples(spark, sf)
    return H.mean_latency(s.select("ts", "application", (F.col("counter") * 3).alias("value")), s.select("ts", "application", F.col("counter").alias("value")), ("application",))


@query("hit_rate", with_ticks(f", {SAMPLES} select application, cast(count(*) filter (event_type = 'click') as double) * 100.0 / cast(count(*) as double) as hit_rate from sa group by application"))
def hit_rate(spark, sf):
    return H.hit_rate(samples(spark, sf), ("application",), F.col("event_type") == "click").withColumn("hit_rate", F.col("hit_rate").cast("double"))


@query("failures_a_minute", with_ticks(f", {SAMPLES} select minute_s, count(*) filter (event_type = 'error') as failures from sa group by minute_s"))
def failures_a_minute(spark, sf):
    return H.failures_a_minute(samples(spark, sf), F.col("event_type") == "error")


@query("backlog_alerts", with_ticks(f"""
, {SAMPLES}, bl as (select application, seq, counter * 41 % 260001 as lag, counter * 41 % 260001 / 200000.0 as ratio from sa),
x as (select *, ratio >= 0.8 as high, coalesce(lag(ratio >= 0.8) over (partition by application order by seq), false) as was from bl)
select application, seq, cast(lag as double) as lag, cast(ratio as double) as ratio, case when high then 'alert' else 'recovery' end as event from x where high <> was"""))
def backlog_alerts(spark, sf):
    """The backlog of each application against its longest."""
    lagged = samples(spark, sf).select("application", "seq", (F.col("counter") * 41 % 260001).alias("lag"))
    return O.threshold_crossings(H.backlog_ratio(lagged), 0.8, ("application",))


OVERDUE = 1704067200000 + 3_600_000


@query("pending_overdue", with_ticks(f"select cast(seq as varchar) as record_id, symbol as consumer, arrival_ms as last_delivery_ms from ticks where {OVERDUE} - arrival_ms >= 30000"))
def pending_overdue(spark, sf):
    p = S.event_ticks(spark, sf).select(F.col("seq").cast("string").alias("record_id"), F.col("symbol").alias("consumer"), F.col("arrival_ms").alias("last_delivery_ms"))
    return H.pending_overdue(p, OVERDUE)
