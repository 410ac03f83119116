"""Worked examples for the candle operators, and the late rule against a sequential model."""

import random
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from candlewright.functions import numbers as N
from candlewright.functions import time as T
from candlewright.operators import aggregate as A
from candlewright.operators import chart as C
from candlewright.operators import changelog as L
from candlewright.operators import late as D
from candlewright.operators import metrics as H
from candlewright.operators import ordered as O
from candlewright.operators import reconcile as R
from candlewright.sources import klines as K
from candlewright.sources import ticks as S
from candlewright.streaming.candles import CandleState, CandleTable

TICK = "seq bigint, symbol string, price decimal(18,6), quantity decimal(18,8), event_ms bigint, arrival_ms bigint"
CANDLE = "symbol string, interval string, start_s bigint, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume bigint, trades bigint"


def ticks(spark, rows, gap=1000):
    return spark.createDataFrame([(i, "btc", Dec(p), Dec(q), ms, 10_000_000 + i * gap) for i, (p, q, ms) in enumerate(rows)], TICK)


def candles(spark, rows, interval="1m"):
    return spark.createDataFrame([("btc", interval, s, Dec(o), Dec(h), Dec(lo), Dec(c), v, 1) for s, o, h, lo, c, v in rows], CANDLE)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_late_tick_keeps_open_and_moves_the_rest(spark):
    t = ticks(spark, [(100, 10, 60_000), (105, 5, 121_000), (150, 2, 119_000)])
    assert values(D.apply_late(t, ("1m", "5m")), "seq", "interval", "fate") == [
        (0, "1m", "on_time"), (0, "5m", "on_time"), (1, "1m", "on_time"), (1, "5m", "on_time"), (2, "1m", "late_applied"), (2, "5m", "on_time")
    ]
    got = D.candles_with_late(t, ("1m",)).where("start_s = 60")
    assert values(got, "open", "high", "close", "volume", "trades") == [(Dec(100), Dec(150), Dec(150), 1_200_000_000, 2)]
    kinds = D.candle_revisions(t, ("1m",)).groupBy("kind").count()
    assert dict(kinds.collect()) == {"live": 2, "closed": 1, "late": 1}


def test_unknown_bucket_is_dropped(spark):
    t = ticks(spark, [(100, 10, 6_000_000), (150, 10, 10_000)])
    assert {r["fate"] for r in D.apply_late(t, ("1m", "5m", "30m")).where("seq = 1").collect()} == {"late_dropped"}


@pytest.mark.parametrize("arrival, fate", [(120_000, "late_applied"), (120_001, "late_dropped")])
def test_late_time_limit_is_inclusive(spark, arrival, fate):
    rows = [(0, "btc", Dec(1), Dec(1), 60_000, 0), (1, "btc", Dec(1), Dec(1), 120_000, 0), (2, "btc", Dec(1), Dec(1), 60_000, arrival)]
    got = D.apply_late(spark.createDataFrame(rows, TICK), ("1m",)).where("seq = 2")
    assert values(got, "fate") == [(fate,)]


def test_fourth_oldest_closed_bucket_is_dropped(spark):
    t = ticks(spark, [(1, 1, 60_000 * i) for i in range(1, 6)] + [(9, 1, 60_000), (9, 1, 120_000)], gap=1)
    assert values(D.apply_late(t, ("1m",)).where("seq >= 5"), "seq", "fate") == [(5, "late_dropped"), (6, "late_applied")]


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_late_rule_equals_sequential_model(spark, chunk):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(600):
        at += rng.randint(0, 40_000)
        rows.append((i, rng.choice("ab"), Dec(rng.randint(1, 99)), Dec(1), max(1, at - rng.choice((0, 0, 0, 60_000, 200_000))), at))
    states, want = {}, []
    for seq, symbol, price, _, ms, arrival in rows:
        state = states.setdefault(symbol, CandleState(None, 3, 120_000))
        want += [(symbol, c[0], seq, kind, *c[1:]) for kind, c in state.tick(ms // 1000 // 60 * 60, int(price), 1, arrival)]
    df = spark.createDataFrame(rows, TICK).repartition(5)
    fates = D.apply_late(df, ("1m",))
    marked = {(r.seq,): r.on_time for r in D.classify_late(df, ("1m",), chunk).collect()}
    assert all(marked[(r.seq,)] == (r.fate == "on_time") for r in fates.collect())
    got = values(fates.where("fate = 'late_applied'"), "seq")
    assert got == sorted((w[2],) for w in want if w[3] == "late")
    revisions = D.candle_revisions(spark.createDataFrame(rows, TICK), ("1m",))
    found = sorted((r.symbol, r.start_s, r.seq, r.kind, int(r.open), int(r.high), int(r.low), int(r.close), r.volume // 10**8, r.trades) for r in revisions.collect())
    assert found == sorted(want)


RANGE = [(0, 80, 90, 70, 85, 100_000_000), (60, 100, 110, 90, 105, 200_000_000), (120, 105, 120, 95, 115, 300_000_000), (180, 115, 118, 100, 101, 400_000_000), (240, 101, 200, 1, 150, 500_000_000)]


def test_range_statistics(spark):
    c = candles(spark, RANGE)
    assert values(A.range_stats(c, 60, 240), "first_s", "last_s", "open", "high", "low", "close", "volume") == [(60, 180, Dec(100), Dec(120), Dec(90), Dec(101), 900_000_000)]
    assert A.range_stats(c, 900, 999).count() == 0
    assert [tuple(r) for r in A.range_aggregate(c, 900, 999).collect()] == [(None, None, None)]


def test_rollup(spark):
    five = [(i * 60, 100 + 5 * i, 110 + 5 * i, 95 + 5 * i, 105 + 5 * i, 1000 + 100 * i) for i in range(5)]
    cols = ("open", "high", "low", "close", "volume")
    assert values(A.rollup(candles(spark, five), "5m"), *cols) == [(Dec(100), Dec(130), Dec(95), Dec(125), 6000)]
    two = candles(spark, [(0, 100, 110, 95, 105, 1000), (29 * 60, 200, 210, 195, 205, 2000)])
    assert values(A.rollup(two, "30m"), *cols) == [(Dec(100), Dec(210), Dec(95), Dec(205), 3000)]
    assert R.changed_only(A.rollup(two, "30m"), A.rollup(two, "30m")).count() == 0


@pytest.mark.parametrize("start, end, want", [(0, 899_999, [0, 300]), (180_000, 600_000, [0, 300]), (0, 299_999, []), (0, 300_000, [0])])
def test_rollup_targets(spark, start, end, want):
    one = spark.createDataFrame([("btc",)], "symbol string")
    assert [r["start_s"] for r in R.rollup_targets(one, "5m", start, end).orderBy("start_s").collect()] == want


def test_reconcile(spark):
    feed = candles(spark, [(60, 100, 110, 90, 105, 1000)])
    for stored, reason in (([], "MISSING"), ([(60, 99, 110, 90, 105, 1000)], "MISMATCH"), ([(60, 100, 110, 90, 105, 1000)], None)):
        changes, audit = R.reconcile(candles(spark, stored), feed)
        assert [r["reason"] for r in audit.collect()] == ([reason] if reason else [])
        assert changes.count() == (1 if reason else 0)


def test_reconciliation_run_settles(spark):
    start = 1_710_237_600
    stored = candles(spark, [(start, 50000, 51000, 49000, 50500, 100)])
    prices = [(60000, 61000, 59000, 60500, 100), (60500, 61500, 60000, 61000, 200), (61000, 62000, 60500, 61500, 300), (61500, 62500, 61000, 62000, 400), (62000, 63000, 61500, 62500, 500)]
    feed = candles(spark, [(start + 60 * i, *p) for i, p in enumerate(prices)])
    as_of = (start + 1860) * 1000
    changes, _ = R.reconciliation_run(stored, feed, as_of, 30)
    assert values(changes.where("interval <> '1m'"), "interval", "start_s", "open", "close", "volume") == [("30m", start, Dec(60000), Dec(62500), 1500), ("5m", start, Dec(60000), Dec(62500), 1500)]
    after = R.upserted(stored.withColumn("version", F.lit(0).cast("long")), changes)
    assert values(after.where(f"interval = '1m' and start_s = {start}"), "open", "version") == [(Dec(60000), 1)]
    assert R.reconciliation_run(after.withColumn("trades", F.lit(1)), feed, as_of, 30)[0].count() == 0


AS_OF = 1_786_710_896_000  # 2026-08-14T12:34:56Z
MINUTE = AS_OF // 60_000 * 60


@pytest.mark.parametrize(
    "done, live, want",
    [
        ([(MINUTE - 600, 100, 108, 95, 107, 10**9)], [(MINUTE, 107, 112, 101, 110, 125_000_000)], (100, 110, 112, 95, "11.25", "10.0000")),
        ([], [(MINUTE, 100, 105, 99, 102, 250_000_000)], (100, 102, 105, 99, "2.5", "2.0000")),
        ([(MINUTE - 600, 100, 110, 90, 105, 5 * 10**8)], [(MINUTE - 60, 105, 200, 1, 150, 10**9)], (100, 105, 110, 90, "5", "5.0000")),
        ([], [], None),
        ([(MINUTE - 86_400, 100, 108, 95, 107, 10**9)], [], None),
    ],
)
def test_stats_24h(spark, done, live, want):
    got = C.stats_24h(candles(spark, done), candles(spark, live), AS_OF).select("open", "current", "high", "low", "volume", "change_percent").collect()
    assert [tuple(r) for r in got] == ([tuple(Dec(x) for x in want)] if want else [])


def test_chart_puts_live_candle_on_top(spark):
    c = candles(spark, [(60, 101, 101, 101, 101, 1), (120, 102, 102, 102, 102, 1)])
    got = C.chart(c, candles(spark, [(180, 103, 103, 103, 103, 1)]), "btc", "1m", 2, 210)
    assert [int(r["close"]) for r in got.collect()] == [101, 102, 103]
    assert [int(r["close"]) for r in C.chart(c, candles(spark, []), "btc", "1m", 2, 210, 120).collect()] == [101]


FRAMES = [("btcusdt", "65432.12345678", "0.001234", 1711512345678), ("ethusdt", "0.000000001234", "12345678.90123456", 1), ("a", "1", "0", 7), ("abcdefghijklmnopqrstuvwxyz", "100", "2.22", 333), ("test", "1.11", "2.22", 333)]


def test_frames_round_trip(spark):
    rows = [(s, Dec(p), Dec(q), ms) for s, p, q, ms in FRAMES]
    df = spark.createDataFrame(rows, "symbol string, price decimal(38,18), quantity decimal(38,18), event_ms bigint")
    framed = S.encode_all_tick_frames(df).select("payload").persist()
    assert sorted(len(r["payload"]) for r in framed.collect()) == sorted(34 + len(s) for s, *_ in FRAMES)
    good, bad = S.decode_tick_frames(framed)
    assert values(good, "symbol", "price", "quantity", "event_ms") == sorted(rows)
    assert bad.count() == 0
    broken = spark.createDataFrame([(None,), (bytearray(b"\x02\x01a"),), (bytearray(b""),), (bytearray(b"\x01\x03ab"),)], "payload binary")
    assert S.decode_tick_frames(broken)[0].count() == 0 and S.decode_tick_frames(broken)[1].count() == 4


@pytest.mark.parametrize("symbol, price, quantity, ms", [(" ", 1, 1, 1), ("a", 0, 1, 1), ("a", 1, -1, 1), ("a", 1, 1, 0), (None, 1, 1, 1)])
def test_invalid_ticks(spark, symbol, price, quantity, ms):
    df = spark.createDataFrame([(symbol, Dec(price), Dec(quantity), ms)], "symbol string, price decimal(38,18), quantity decimal(38,18), event_ms bigint")
    good, bad = S.validate_ticks(df)
    assert (good.count(), bad.count()) == (0, 1)
    assert [d.count() for d in S.encode_tick_frames(df)] == [0, 1]
    with pytest.raises(ValueError, match="cannot be encoded"):
        S.encode_all_tick_frames(df)


def test_frames_of_valid_and_invalid_ticks_in_one_plan(spark):
    rows = [(i, "a" if i % 5 else " ", Dec(i % 3), Dec(1), 7) for i in range(60)] + [(60, "x" * 256, Dec(1), Dec(1), 7), (61, "a", Dec("1234567890123456789"), Dec("0.000000000000000001"), 7)]
    df = spark.createDataFrame(rows, "seq bigint, symbol string, price decimal(38,18), quantity decimal(38,18), event_ms bigint")
    valid, invalid = S.validate_ticks(df)
    frames, rejected = S.encode_tick_frames(valid)
    again, broken = S.decode_tick_frames(frames.where("octet_length(payload) > 1 and octet_length(payload) < 600"))
    want = [r for r in rows[:60] if r[1] == "a" and r[2] > 0] + [rows[61]]
    assert values(again, "seq", "symbol", "price", "quantity", "event_ms") == values(spark.createDataFrame(want, df.schema), *df.columns)
    assert (rejected.count(), broken.count(), invalid.count()) == (1, 0, 60 - len(want) + 1)
    assert S.encode_tick_frames(df)[1].count() == 62 - len(want)


def test_trade_json(spark):
    texts = ['{"data":{"s":"BTCUSDT","p":"1.5","q":"2","E":7}}', '{"data":{"s":"A","p":"1"}}', "{", '{"data":{"s":"A","p":"1","q":"1","E":0}}', '{"data":{"s":"A","p":"x","q":"1","E":5}}', None]
    got = S.read_trade_json(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert values(got, "symbol", "price", "quantity", "event_ms") == [("btcusdt", Dec("1.5"), Dec(2), 7)]


def test_exchange_kline(spark):
    body = '[[1672531200000,"16500.10","16550.50","16450.00","16510.20","100.5",1672531259999,"1655000.00",1500,"50.2","825000.00"]]'
    row = K.read_exchange_klines(spark.createDataFrame([(body,)], "value string")).first()
    assert (row.open_ms, row.high, row.trades, row.taker_buy_quote) == (1672531200000, Dec("16550.50"), 1500, Dec(825000))
    with pytest.raises(Exception, match="fewer than 11"):
        K.read_exchange_klines(spark.createDataFrame([('[["1","2"]]',)], "value string")).collect()


def test_volume_scaling(spark):
    one = lambda v: spark.createDataFrame([(Dec(v),)], "q decimal(28,10)").select(N.scale_volume(F.col("q")).alias("v")).first()["v"]
    assert one("1.0000000199") == 100_000_001
    wide = lambda v: spark.createDataFrame([(Dec(v),)], "q decimal(38,18)").select(N.scale_volume(F.col("q")).alias("v"), N.try_scale_volume(F.col("q")).alias("t")).first()
    for text, units in (("0.999999999999999999", 99_999_999), ("1.234567899999999999", 123_456_789), ("0.000000009999999999", 0), ("92233720368.547758079999999999", 2**63 - 1)):
        assert tuple(wide(text)) == (units, units)
    assert spark.createDataFrame([(Dec(-1),), (None,), (Dec(92233720369),)], "q decimal(38,18)").select(N.try_scale_volume(F.col("q")).alias("t")).where("t is not null").count() == 0
    with pytest.raises(Exception, match="negative"):
        one("-1")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        one("999999999999")
    big = spark.createDataFrame([("a", Dec(90_000_000_000)), ("a", Dec(90_000_000_000))], "symbol string, quantity decimal(28,8)")
    assert A.lenient_volume(big).first()["volume"] is None


def test_crossings(spark):
    def run(lags):
        rows = H.backlog_ratio(spark.createDataFrame(list(enumerate(lags)), "seq bigint, lag bigint"))
        return [(r["lag"], r["event"]) for r in O.threshold_crossings(rows, 0.8).orderBy("seq").collect()]

    assert run([100_000]) == []
    assert run([160_000, 180_000, 100_000, 170_000]) == [(160_000, "alert"), (100_000, "recovery"), (170_000, "alert")]


def test_throttle_equals_greedy_rule(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(500):
        at += rng.choice((10, 60, 120, 260))
        rows.append((rng.choice("ab"), "1m", i, at, rng.random() < 0.1))
    last, want = {}, []
    for s, _, i, at, closed in rows:
        if closed or s not in last or at - last[s] >= 250:
            last[s] = at
            want.append((i,))
    got = O.throttle_klines(spark.createDataFrame(rows, "symbol string, interval string, seq bigint, at_ms bigint, closed boolean"))
    assert values(got, "seq") == want


def test_forward_fill_and_direction(spark):
    c = candles(spark, [(60, 1, 2, 1, 2, 5), (240, 3, 3, 3, 3, 5)])
    assert values(O.forward_fill(c), "start_s", "close", "volume", "is_ghost") == [(60, Dec(2), 5, False), (120, Dec(2), 0, True), (180, Dec(2), 0, True), (240, Dec(3), 5, False)]
    prices = spark.createDataFrame([(i, "a", p) for i, p in enumerate([5, 5, 6, 6, 4])], "seq bigint, symbol string, price int")
    assert [r["direction"] for r in O.price_direction(prices).orderBy("seq").collect()] == ["neutral", "neutral", "up", "up", "down"]


CHUNK = 7


def test_chunks_change_nothing(spark):
    """Ordered operators over chunks of seven against plain loops, with null keys, gaps and columns of their names."""
    rng = random.Random(21)
    rows, at = [], 0
    for i in sorted(rng.sample(range(400), 150)):
        at += rng.choice((10, 100, 200, 300))
        rows.append((i, rng.choice(["a", "b", None]), "1m", rng.randint(1, 4), at, rng.random() < 0.15, 1, 2))
    df = spark.createDataFrame(rows, "seq bigint, symbol string, interval string, price int, at_ms bigint, closed boolean, _chunk int, _was int").repartition(5)
    clock, price, way, high = {}, {}, {}, {}
    out, ways, rising, crossed, was = [], [], [], [], False
    for i, s, _, p, ms, closed, *_ in rows:
        if closed or s not in clock or ms - clock[s] >= 250:
            clock[s] = ms
            out.append((i,))
        if s in price and p != price[s]:
            way[s] = "up" if p > price[s] else "down"
        price[s] = p
        ways.append((i, way.get(s, "neutral")))
        high[s] = max(high.get(s, 0), p)
        if p == high[s]:
            rising.append((i,))
        if (p >= 3) != was:
            was = p >= 3
            crossed.append((i, "alert" if was else "recovery"))
    for chunk in (CHUNK, 1_000_000):
        assert values(O.throttle_klines(df, chunk=chunk), "seq") == out
        assert values(O.price_direction(df, chunk), "seq", "direction") == ways
        assert values(O.monotonic_ticker(df.withColumn("event_ms", F.col("price").cast("long")), chunk), "seq") == rising
        assert values(O.threshold_crossings(df.withColumn("ratio", F.col("price").cast("double")), 3.0, chunk=chunk), "seq", "event") == crossed
    assert set(df.columns) <= set(O.price_direction(df).columns) and O.latest_n(df.withColumn("start_s", F.col("seq")).withColumn("_n", F.lit(5)), 2).select("_n").distinct().collect() == [(5,)]
    empty = df.limit(0)
    assert O.throttle_klines(empty).count() == O.price_direction(empty).count() == 0


def test_counter_restarts_across_chunks(spark):
    rows = [(i * 600, "x", float(v)) for i, v in enumerate([3, 5, 9, 2, 2, 7, 1, 4, 4, 8, 20, 3])]
    df = spark.createDataFrame(rows, "s bigint, application string, value double").selectExpr("timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00') as ts", "application", "value")
    want, last = [], None
    for s, _, v in rows:
        want.append((s + 1704067200, 0.0 if last is None else v if v < last else v - last))
        last = v
    for ms in (900_000, 3_600_000, 1 << 40):
        assert values(H.counter_increase(df, ("application",), ms), "minute_s", "increase") == want
    mean = H.mean_latency(df.withColumn("value", F.col("value") * 3), df, ("application",))
    assert values(mean, "minute_s", "mean_latency") == [(m, 3.0 if v else None) for m, v in want]


def test_symbols_and_unknown_intervals(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, symbol string")
    assert values(K.get_symbol(dim, symbol="b"), "id") == [(2,)]
    with pytest.raises(LookupError, match="SYM-001"):
        K.get_symbol(dim, id=3)
    assert K.find_symbols(dim, symbol="A").count() == 0
    c = candles(spark, [(60, 1, 1, 1, 1, 5)]).withColumn("version", F.lit(0).cast("long"))
    with pytest.warns(UserWarning, match="7m"):
        assert R.upserted(c, c.withColumn("interval", F.lit("7m")), warn=True).count() == 1


def test_changelog_fold(spark):
    rows = [("b", "1m", 60, 1, 101, True), ("b", "1m", 120, 2, 102, False), ("b", "1m", 120, 3, 104, True)]
    events = spark.createDataFrame(rows, "symbol string, interval string, start_s bigint, seq bigint, close int, closed boolean")
    assert values(L.finalized(events), "start_s", "close") == [(60, 101), (120, 104)]
    assert L.materialized_live(events).count() == 0


def test_subscriptions(spark):
    rows = [(1, "x", "SUBSCRIBE", "a"), (2, "x", "UNSUBSCRIBE", "a"), (3, "x", "SUBSCRIBE", "B"), (4, "y", "SUBSCRIBE", "a")]
    commands = spark.createDataFrame(rows, "seq bigint, session_id string, command string, symbol string")
    subs = L.active_subscriptions(commands)
    assert values(subs, "session_id", "symbol") == [("x", "B"), ("y", "a")]
    events = spark.createDataFrame([("a",), ("b",)], "symbol string")
    assert values(L.fan_out(events, subs), "symbol", "session_id") == [("a", "y")]


def test_times_do_not_depend_on_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:34:56.789' as ts")
    want = [tuple(r) for r in df.select(T.to_1m(F.col("ts")), T.to_5m(F.col("ts")), T.to_30m(F.col("ts")), T.ntz_to_millis(F.col("ts"))).collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [tuple(r) for r in df.select(T.to_1m(F.col("ts")), T.to_5m(F.col("ts")), T.to_30m(F.col("ts")), T.ntz_to_millis(F.col("ts"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert str(want[0][2]) == "2024-03-31 02:30:00"
    with pytest.raises(ValueError):
        T.resolve_bucket("7m", F.col("ts"))


def test_candle_table_is_idempotent(spark, tmp_path):
    table = CandleTable(spark, f"file://{tmp_path}/t")
    first = candles(spark, [(60, 1, 1, 1, 1, 5)]).withColumn("seq", F.lit(1).cast("long"))
    again = candles(spark, [(60, 1, 115, 1, 112, 1050)]).withColumn("seq", F.lit(2).cast("long"))
    table.write(first, 0)
    table.write(again, 1)
    table.write(again, 1)
    assert values(table.read(), "high", "close", "volume", "version") == [(Dec(115), Dec(112), 1050, 1)]
    other = CandleTable(spark, f"file://{tmp_path}/u")
    table.compact(other)
    assert values(other.read(), "close", "version") == [(Dec(112), 0)]


def test_pending_is_inclusive(spark):
    p = spark.createDataFrame([("a", "c", 0), ("b", "c", 1)], "record_id string, consumer string, last_delivery_ms bigint")
    assert [r["record_id"] for r in H.pending_overdue(p, 30_000).collect()] == ["a"]


def test_late_rule_with_columns_of_its_own_names(spark):
    """Ticks may have any other columns; those named as the result's are replaced."""
    names = ("open_seq", "closed_seq", "closed_ms", "expired_seq", "fate", "high_s", "_high")
    t = ticks(spark, [("100", "10", 60_000), ("105", "5", 121_000), ("150", "2", 119_000)])
    odd = t.withColumns({n: F.lit(-7) for n in names})
    columns = ("seq", "interval", "fate", "start_s")
    assert values(D.apply_late(odd, ("1m", "5m")), *columns) == values(D.apply_late(t, ("1m", "5m")), *columns)
    assert D.apply_late(odd, ("1m",)).select("open_seq", "expired_seq", "_high").distinct().collect() == [(-7, -7, -7)]
    assert values(D.candle_revisions(odd, ("1m",)), "seq", "kind", "close") == values(D.candle_revisions(t, ("1m",)), "seq", "kind", "close")


def test_keep_last_by_a_key_named_like_the_helper(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (2, 1, "z")], "_row long, seq long, v string")
    assert values(O.dedupe_keep_last(df, ["_row"], "seq"), "_row", "v") == [(1, "y"), (2, "z")]


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_crossings_pass_over_null_ratios(spark, chunk):
    df = spark.createDataFrame([(1, None), (2, 0.9), (3, None), (4, 0.9), (5, None), (6, 0.1), (7, None), (8, 0.2), (9, 0.8)], "seq long, ratio double")
    assert values(O.threshold_crossings(df, 0.8, chunk=chunk), "seq", "event") == [(2, "alert"), (6, "recovery"), (9, "alert")]


def test_counter_samples_of_one_time(spark):
    """Equal times stand in the order of values, whatever the rows' order."""
    rows = [("2024-01-01 00:00:00", 5.0), ("2024-01-01 00:00:10", 9.0), ("2024-01-01 00:00:10", 7.0), ("2024-01-01 00:00:10", 8.0), ("2024-01-01 00:00:20", 2.0)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "ts string, value double").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.lit("a").alias("k")).repartition(3)
        assert [r.increase for r in H.counter_increase(df, ("k",)).collect()] == [4.0 + 2.0]


def test_minutes_of_samples_count_to_the_nearest_millisecond(spark):
    """As epoch_ms in the SQL of counter_rate, failures_a_minute, mean_latency and sketch_percentiles has it."""
    import duckdb

    times = ["2024-01-01 00:00:59.999499", "2024-01-01 00:00:59.9995", "2024-01-01 00:59:59.9999", "2024-12-31 23:59:59.999999", "1970-01-01 00:00:00.0005"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit(True).alias("bad"))
    want = sorted(duckdb.sql(f"select epoch_ms(timestamp '{t}') // 60000 * 60").fetchall()[0][0] for t in times)
    assert sorted(r.minute_s for r in H.failures_a_minute(df, F.col("bad")).collect() for _ in range(r.failures)) == want
    hours = H.sketch_percentiles(H.latency_sketches(df.select(F.lit("a").alias("k"), "ts", F.lit(1.0).alias("value")), ("k",)), ("k",))
    assert sorted(r.start_s for r in hours.collect() for _ in range(r.n)) == sorted(w // 3600 * 3600 for w in want)
    assert [r.m for r in df.select(T.ntz_to_millis(F.col("ts")).alias("m")).collect()][1] % 1000 == 999
