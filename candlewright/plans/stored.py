"""Registered queries over tables that are written batch by batch, and over logs that are followed in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators import changelog as L
from candlewright.operators import chart as C
from candlewright.operators import metrics as H
from candlewright.operators import ordered as O
from candlewright.sources import klines as K
from candlewright.sources import ticks as S
from candlewright.streaming import candles as G
from candlewright.streaming import store as W
from candlewright.streaming import typed as Y

from .batch import ALL, CHART, as_of, kept, rollup_sql, stored
from .scratch import once, scratch
from .sql import with_late, with_ticks

QUERIES: dict = {}
SQL: dict = {}
#: Files, and so micro-batches, that the events are dealt to in order, at least; stream_store has as many.
PIECES = 3


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


#: Rows of a file, and so of a micro-batch, where nothing fixes how many there are.
ROWS = 1_000_000
#: The same for frames, of which a task holds a few whole numbers and an id: fewer micro-batches, each of which takes some time for itself.
FRAMES = 2_000_000


def landed(rows: DataFrame, order: str, pieces: int | None = None, least: int = PIECES, most: int = ROWS) -> DataFrame:
    """``rows`` as a stream of files in their order, one for each micro-batch: ``pieces`` of them, or, ``least`` or more, as many as keep
    each at about ``most`` rows, so that what a task holds of a micro-batch does not grow with the table.

    All files are written in one job, which computes ``rows`` once. The source takes files by their time, so these are set.
    """
    spark, at = rows.sparkSession, f"{scratch(rows.sparkSession)}/landed"
    last, n = rows.agg(F.max(order), F.count("*")).first()
    pieces = pieces or max(least, -(-n // most))
    cut = rows.withColumn("_piece", F.expr(f"cast({order} * {pieces} div {(last or 0) + 1} as int)"))
    cut.where("_piece is not null").repartition(pieces, "_piece").write.partitionBy("_piece").parquet(at)
    if last is None:
        rows.limit(0).write.parquet(f"{at}/_piece=0")
    root = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs, begin = root.getFileSystem(spark._jsc.hadoopConfiguration()), 1_704_067_200_000
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("_piece="):
            for file in fs.listStatus(folder.getPath()):
                fs.setTimes(file.getPath(), begin + 1000 * int(name.removeprefix("_piece=")), -1)
    return G.file_stream(spark, f"{at}/_piece=*", rows.schema, files_a_trigger=1)


def pieces(spark: SparkSession, sf: str, count: int | None = None, least: int = PIECES) -> DataFrame:
    return S.as_ticks(landed(spark.read.parquet(f"{sf}/events.parquet"), "event_id", count, least))


def sink_steps(spark: SparkSession, sf: str, count: int | None = None) -> tuple[W.CandleStore, W.HotWindows, W.LiveCandles, str]:
    """A candle stream over several micro-batches with all steps of its sink: table, hot windows, live candles, topic."""
    at = scratch(spark)
    store, windows, live = W.CandleStore(spark, f"{at}/candles"), W.HotWindows(spark, f"{at}/windows", 50), W.LiveCandles(spark, f"{at}/live")

    def publish(rows: DataFrame, batch_id: int) -> None:
        sent = rows.withColumn("close_s", F.lit(None).cast("long")).withColumn("closed", F.col("kind") != "live")
        L.kline_json(sent).write.mode("overwrite").parquet(f"{at}/topic/batch={batch_id}")

    sink = W.CandleSink(store, windows, live, f"{at}/batches", publish)
    G.run_to_end(G.stream_candles(S.validate_ticks(pieces(spark, sf, count))[0], ALL), f"{at}/checkpoint", sink=sink)
    return store, windows, live, f"{at}/topic"


STEPS = f""", fin as (select symbol, interval, start_s, count(distinct seq * {PIECES} // (select max(seq) + 1 from ticks)) - 1 as version from rev where kind <> 'live' group by all),
cl as (select lc.*, fin.version from lc join fin using (symbol, interval, start_s))"""


@query("stream_store", with_late(STEPS + " select symbol, interval, start_s // 86400 as day, start_s, open, high, low, close, volume, version from cl"))
def stream_store(spark, sf):
    """Closed candles, merged by touched days; version counts the micro-batches that changed a candle again."""
    return sink_steps(spark, sf, PIECES)[0].read()


@query("stream_sink_steps", with_late(STEPS + """, hw as (select * from cl qualify row_number() over (partition by symbol, interval order by start_s desc) <= 50)
select 'window' as step, symbol, interval, start_s, close, count(*) as n from hw group by all
union all select 'live', symbol, interval, start_s, close, count(*) from lc anti join fin using (symbol, interval, start_s) group by all
union all select 'topic', symbol, interval, start_s, close, count(*) from rev group by all"""))
def stream_sink_steps(spark, sf):
    """What the later steps leave: hot windows of 50, live candles that no closed one cleared, messages."""
    _, windows, live, topic = sink_steps(spark, sf)
    columns = ("symbol", "interval", "start_s", "close")
    sent = L.classify_messages(spark.read.parquet(topic).select("value"))[0]
    parts = [d.select(F.lit(step).alias("step"), *columns) for step, d in (("window", windows.read()), ("live", live.live()), ("topic", sent))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("step", *columns).agg(F.count("*").alias("n"))


@query("stream_candles_typed", with_late("select symbol, interval, start_s, seq, kind, open, high, low, close, volume, trades from rev"))
def stream_candles_typed(spark, sf):
    stream, at = Y.stream_candles_typed(S.validate_ticks(pieces(spark, sf))[0], ALL), scratch(spark)
    with Y.rocksdb(spark):
        G.run_to_end(stream, f"{at}/checkpoint", path=f"{at}/out")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def frame_log(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks as binary frames under a place in their log; every fifth comes twice, and broken frames lie between."""
    framed = once(S.encode_tick_frames(S.event_ticks(spark, sf))[0].select(F.col("seq") * 3, F.col("seq").cast("string").alias("record_id"), "arrival_ms", "payload").toDF("seq", "record_id", "arrival_ms", "payload"))
    again = framed.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1)
    broken = framed.where("seq % 7 = 0").select((F.col("seq") + 2).alias("seq"), F.concat("record_id", F.lit("x")).alias("record_id"), "arrival_ms", F.substring("payload", 1, 9).alias("payload"))
    return framed.unionByName(again).unionByName(broken)


@query("stream_frames_to_store", with_late(STEPS + " select symbol, interval, start_s, open, high, low, close, volume from cl"))
def stream_frames_to_store(spark, sf):
    """From binary frames through decoding, validation, recent ids and the late rule to the stored candles."""
    at = scratch(spark)
    store = W.CandleStore(spark, f"{at}/candles")
    sink = W.CandleSink(store, W.HotWindows(spark, f"{at}/windows"), W.LiveCandles(spark, f"{at}/live"), f"{at}/batches")
    with Y.rocksdb(spark):
        G.run_to_end(Y.frames_to_candles(landed(frame_log(spark, sf), "seq", most=FRAMES), ALL), f"{at}/checkpoint", sink=sink)
    return store.read().select(*C.COLUMNS)


def candle_store(spark: SparkSession, sf: str) -> W.CandleStore:
    """All repaired candles in a table by interval and day."""
    store = W.CandleStore(spark, f"{scratch(spark)}/candles")
    store.merge(kept(spark, sf).withColumn("seq", F.lit(0)), 0)
    return store


@query("scan_stored", with_late(f"select {CHART} from lc, lim where interval = '5m' and start_s >= last_s - 36000 and start_s < last_s - 600"))
def scan_stored(spark, sf):
    """A range of a stored table; the plan reads the interval and days of the range alone."""
    end = as_of(spark, sf)
    return K.scan_candles(candle_store(spark, sf).read(), "5m", end - 36000, end - 600).select(*C.COLUMNS)


@query("lookup_stored", with_late(f"select {CHART} from lc, lim where interval = '30m' and symbol = 'click' and start_s = last_s // 1800 * 1800 - 3600"))
def lookup_stored(spark, sf):
    at = as_of(spark, sf) // 1800 * 1800 - 3600
    return K.lookup_candle(candle_store(spark, sf).read(), "30m", "click", at).select(*C.COLUMNS)


@query("chart_stored", with_late(f"""select {CHART} from (select * from lc where symbol = 'view' and interval = '5m' and start_s < (select last_s // 300 * 300 from lim) order by start_s desc limit 40)
union all select {CHART} from lc where symbol = 'view' and interval = '1m' and start_s < (select last_s - 30000 from lim) // 60 * 60 and start_s >= (select last_s - 30000 from lim) // 60 * 60 - 7200"""))
def chart_stored(spark, sf):
    """A hot window from the stored windows, and a cold one from the days of the table that it spans."""
    end, store = as_of(spark, sf), candle_store(spark, sf)
    windows = W.HotWindows(spark, f"{scratch(spark)}/windows")
    windows.put(store.read(), 0)
    hot = C.chart_hot(windows.of("view", "5m"), "view", "5m", 40, end)
    return hot.union(C.chart_cold(store.read(), "view", "1m", 120, end, end - 30000))


@query("pages_back", with_late(f"select {CHART} from lc where symbol = 'click' and interval = '30m' and start_s < (select last_s // 1800 * 1800 from lim)"))
def pages_back(spark, sf):
    """All pages of 12 before the current candle, to the first empty one."""
    end, store = as_of(spark, sf), candle_store(spark, sf)
    out = None
    for page in C.pages_back(store.read(), "click", "30m", end // 1800 * 1800, end, 12):
        out = page if out is None else out.union(page)
    return out


LOG = """, cmd as (select seq, cast(user_id as varchar) as session_id, event_type = 'click' as sub, 's' || (seq % 5) as symbol from ticks where event_type in ('click', 'view')),
own as (select * from cmd union all select distinct e.seq, cmd.session_id, false, cmd.symbol from cmd join ticks e on cast(e.user_id as varchar) = cmd.session_id and e.event_type = 'error' and e.seq % 50 = 0),
val as (select * from (select *, lead(seq) over (partition by session_id, symbol order by seq, sub desc) as to_seq from own) where sub and (to_seq is null or to_seq > seq))"""
DELIVERED = LOG + """ select t.seq, val.symbol, val.session_id from ticks t join val on val.symbol = 's' || (t.seq % 5) and t.seq > val.seq and (val.to_seq is null or t.seq <= val.to_seq)"""


def followed(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, commands, ended) of a log in which every event concerns a symbol, and some are commands or ends of sessions."""
    of, session = F.concat(F.lit("s"), F.col("seq") % 5).alias("symbol"), F.col("user_id").cast("string").alias("session_id")
    commands = t.where("symbol in ('click', 'view')").select("seq", session, F.when(F.col("symbol") == "click", "SUBSCRIBE").otherwise("UNSUBSCRIBE").alias("command"), of)
    return t.select("seq", of), commands, t.where("symbol = 'error' and seq % 50 = 0").select("seq", session)


@query("fan_out_as_of", with_ticks(DELIVERED))
def fan_out_as_of(spark, sf):
    events, commands, ended = followed(S.event_ticks(spark, sf))
    return L.fan_out_as_of(events, L.validity(commands, ended)).select("seq", "symbol", "session_id")


@query("stream_fan_out_as_of", with_ticks(DELIVERED))
def stream_fan_out_as_of(spark, sf):
    """The same over several micro-batches, with subscriptions carried from one to the next."""
    at = scratch(spark)
    table = W.Subscriptions(spark, f"{at}/subscriptions")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/log/{batch_id}")
        table.deliver(*followed(spark.read.schema(batch.schema).parquet(f"{at}/log/{batch_id}")), batch_id, f"{at}/out")

    G.run_to_end(pieces(spark, sf), f"{at}/checkpoint", sink=sink)
    return spark.read.parquet(f"{at}/out").select("seq", "symbol", "session_id")


@query("stream_dedupe_recent", "with recursive " + with_ticks("").removeprefix("with ").rstrip() + """,
t as (select seq, symbol, arrival_ms, seq % 2 as record_id from v),
r as (select symbol, record_id, min(seq) as seq, min(arrival_ms) as arrival_ms from t group by all
      union all select t.symbol, t.record_id, min(t.seq), min(t.arrival_ms) from r join t on t.symbol = r.symbol and t.record_id = r.record_id and t.arrival_ms >= r.arrival_ms + 60000 group by all)
select seq, symbol, cast(record_id as varchar) as record_id from r""")
def stream_dedupe_recent(spark, sf):
    """Ids that come back again and again: one of each symbol and minute stays."""
    t = S.validate_ticks(pieces(spark, sf))[0].select("seq", "symbol", "arrival_ms", (F.col("seq") % 2).cast("string").alias("record_id"))
    at = scratch(spark)
    G.run_to_end(G.dedupe_recent(t).select("seq", "symbol", "record_id"), f"{at}/checkpoint", path=f"{at}/out")
    return spark.read.parquet(f"{at}/out")


def carried(spark: SparkSession, sf: str, schema: str, operator, carry) -> DataFrame:
    """Ticks over several micro-batches through an ordered operator, with a few rows carried from one to the next."""
    at = scratch(spark)
    table = W.CarriedRows(spark, f"{at}/carried", schema)
    stream = S.validate_ticks(pieces(spark, sf))[0].select(*table.names)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{batch_id}")
        table.run(spark.read.schema(batch.schema).parquet(f"{at}/rows/{batch_id}"), operator, carry, batch_id, f"{at}/out")

    G.run_to_end(stream, f"{at}/checkpoint", sink=sink)
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("stream_ticker_carried", with_ticks("select seq, symbol, event_ms from v qualify event_ms >= coalesce(max(event_ms) over (partition by symbol order by seq rows between unbounded preceding and 1 preceding), event_ms)"))
def stream_ticker_carried(spark, sf):
    return carried(spark, sf, "symbol string, seq bigint, event_ms bigint", lambda r: O.monotonic_ticker(r, 100), W.carry_highest)


@query("stream_direction_carried", with_ticks(""", p as (select *, lag(price) over (partition by symbol order by seq) as was from v),
mv as (select *, case when price > was then 'up' when price < was then 'down' end as move from p)
select seq, symbol, price, coalesce(last_value(move ignore nulls) over (partition by symbol order by seq rows between unbounded preceding and current row), 'neutral') as direction from mv"""))
def stream_direction_carried(spark, sf):
    return carried(spark, sf, "symbol string, seq bigint, price decimal(18,6)", lambda r: O.price_direction(r, 100), W.carry_last_move)


@query("stream_revisions_carried", with_late("select symbol, interval, start_s, seq, kind, open, high, low, close, volume, trades from rev"))
def stream_revisions_carried(spark, sf):
    """The changelog of candles by joins and windows in each micro-batch, with a few buckets carried."""
    at = scratch(spark)
    table = W.CandleRevisions(spark, f"{at}/carried")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{batch_id}")
        table.run(spark.read.schema(batch.schema).parquet(f"{at}/rows/{batch_id}"), ALL, batch_id, f"{at}/out")

    G.run_to_end(S.validate_ticks(pieces(spark, sf))[0], f"{at}/checkpoint", sink=sink)
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("sketch_percentiles", """select event_type, cast(epoch_ms(ts) // 3600000 * 3600 as bigint) as start_s, count(value) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99
from events where event_type is not null group by all""")
def sketch_percentiles(spark, sf):
    """Hours from sketches of minutes; a sketch of 65,535 is exact for as many values."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    return H.sketch_percentiles(H.latency_sketches(events, ("event_type",), 65_535), ("event_type",), 3600, 65_535)


@query("reconcile_landed", with_late(f""", off as (select lc.* from lc left join stored s using (symbol, interval, start_s) where lc.interval = '1m'
    and (s.close is null or s.open <> lc.open or s.high <> lc.high or s.low <> lc.low or s.close <> lc.close or s.volume <> lc.volume)),
ro as (select r.* from ({rollup_sql("(select symbol, interval, start_s, open, high, low, close, volume, 0 as trades from lc where interval = '1m')", "5m", 300)}) r semi join off on off.symbol = r.symbol and off.start_s // 300 * 300 = r.start_s
    union all select r.* from ({rollup_sql("(select symbol, interval, start_s, open, high, low, close, volume, 0 as trades from lc where interval = '1m')", "30m", 1800)}) r semi join off on off.symbol = r.symbol and off.start_s // 1800 * 1800 = r.start_s),
fin as (select symbol, interval, start_s, open, high, low, close, volume from lc where interval = '1m'
    union all select symbol, interval, start_s, open, high, low, close, volume from ro
    union all select symbol, interval, start_s, open, high, low, close, volume from stored anti join ro using (symbol, interval, start_s) where interval <> '1m')
select * from fin"""))
def reconcile_landed(spark, sf):
    """A table with missing and wrong candles after an exchange's klines have landed, a part at a time."""
    at, c = scratch(spark), kept(spark, sf)
    store = W.CandleStore(spark, f"{at}/candles")
    store.merge(stored(c).withColumn("seq", F.lit(0)), -1)
    feed = c.where("interval = '1m'").select(*C.COLUMNS).withColumn("place", F.expr("start_s div 1800 - 946704"))
    G.run_to_end(landed(feed, "place").drop("place"), f"{at}/checkpoint", sink=W.Reconciler(store, f"{at}/audit", 1704067200000))
    return store.read().select(*C.COLUMNS)
