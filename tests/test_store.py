"""Stored tables batch by batch, delivery as of each event, and bounded memories, against brute force."""

import os
import random
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from candlewright.operators import changelog as L
from candlewright.operators import chart as C
from candlewright.operators import late as D
from candlewright.operators import metrics as H
from candlewright.operators import ordered as O
from candlewright.plans import stored as P
from candlewright.plans.registry import QUERIES
from candlewright.sources import klines as K
from candlewright.sources import ticks as S
from candlewright.streaming import candles as G
from candlewright.streaming import store as W
from candlewright.streaming import typed as Y

SF = "/root/testdata/sf0.001"
DAY = 86400
SCHEMA = "symbol string, interval string, start_s bigint, seq bigint, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume bigint"


def candles(spark, rows):
    return spark.createDataFrame([(s, i, t, q, Dec(1), Dec(2), Dec(1), Dec(p), 5) for s, i, t, q, p in rows], SCHEMA)


def held(table, *columns):
    return sorted(map(tuple, table.read().select(*columns).collect()))


@pytest.fixture
def store(spark, tmp_path):
    return W.CandleStore(spark, f"file://{tmp_path}/t")


def test_a_batch_reads_and_writes_its_days_alone(spark, store):
    """Over 50 batches of a day each, with a late candle for the day before: what a batch reads and rewrites stays the same."""
    sizes, written = [], []
    for b in range(50):
        rows = [(f"s{k}", "1m", b * DAY + 60 * m, b, 3) for k in range(5) for m in range(20)] + [("s0", "1m", (b - 1) * DAY + 60, b, 7)]
        changes = candles(spark, rows)
        files = [r[0].removeprefix("file:") for r in store.only(store.touched(changes.withColumn("day", W.day_of()))).select("_metadata.file_path").distinct().collect()]
        sizes.append(sum(os.path.getsize(f.replace("///", "/")) for f in files))
        before = {f for d, _, fs in os.walk(store.data.removeprefix("file://")) for f in fs}
        assert store.merge(changes, b)
        written.append(len({f for d, _, fs in os.walk(store.data.removeprefix("file://")) for f in fs if f.endswith(".parquet")} - before))
    assert max(sizes[2:]) <= 1.2 * min(sizes[2:]) and max(written) <= 4
    got = {r.start_s // DAY: r.version for r in store.read().where("symbol = 's0' and pmod(start_s, 86400) = 60").collect()}
    assert got == {-1: 0, **{d: 1 for d in range(49)}, 49: 0}


def test_repeated_and_broken_batches(spark, store):
    """A repeated batch leaves versions alone; one that broke off while it replaced is finished from its stage."""
    first = candles(spark, [("a", "1m", 60, 1, 3), ("b", "5m", 300, 2, 4), ("a", "7m", 60, 3, 9), ("a", "1m", 60, 4, 5)])
    assert store.merge(first, 0) and not store.merge(first, 0)
    assert held(store, "symbol", "start_s", "close", "version") == [("a", 60, 5, 0), ("b", 300, 4, 0)]
    second = candles(spark, [("a", "1m", 60, 5, 8), ("c", "1m", DAY, 6, 1)])
    fs = store._files(store.data)[0]
    merged = store.read().where("symbol = 'a'").withColumns({"close": F.lit(8).cast("decimal(18,6)"), "version": F.lit(1).cast("long")}).unionByName(
        second.where("symbol = 'c'").drop("seq").withColumn("version", F.lit(0).cast("long")).withColumn("day", W.day_of()))
    merged.select(*store.read().columns).write.partitionBy("interval", "day").parquet(f"{store.path}/staged/1")
    fs.delete(store._files(f"{store.data}/interval=1m/day=0")[1], True)  # half replaced
    assert store.merge(second, 1)
    assert held(store, "symbol", "start_s", "close", "version") == [("a", 60, 8, 1), ("b", 300, 4, 0), ("c", DAY, 1, 0)]
    assert not store.merge(second, 1)


def filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]


def test_scans_read_their_days(spark, store):
    store.merge(candles(spark, [(s, i, d * DAY + 300 * k, 0, 3) for s in "ab" for i in ("1m", "5m") for d in range(6) for k in range(4)]), 0)
    scan = K.scan_candles(store.read(), "5m", 2 * DAY + 300, 4 * DAY + 300, "a")
    assert [r.start_s for r in scan.collect()] == [2 * DAY + 300, 2 * DAY + 600, 2 * DAY + 900, 3 * DAY, 3 * DAY + 300, 3 * DAY + 600, 3 * DAY + 900, 4 * DAY]
    for df in (scan, K.lookup_candle(store.read(), "5m", "a", 3 * DAY), C.chart_cold(store.read(), "a", "5m", 10, 3 * DAY + 1200)):
        assert "interval" in filters(df) and "day" in filters(df) and not df.isEmpty()


def test_pages_to_the_empty_one(spark):
    """Three pages of four, without a gap or an overlap; a window for the newest, days for the rest."""
    rows = candles(spark, [("a", "5m", 300 * k, 0, 3) for k in range(11)] + [("b", "5m", 0, 0, 3)])
    pages = list(C.pages_back(rows, "a", "5m", 3300, 3300, 4))
    assert [[r.start_s // 300 for r in p.orderBy("start_s").collect()] for p in pages] == [[7, 8, 9, 10], [3, 4, 5, 6], [0, 1, 2]]
    assert list(C.pages_back(rows, "c", "5m", 3300, 3300, 4)) == []


def test_windows_read_touched_slots(spark, tmp_path):
    """Window and live candles after many batches equal those of all rows at once; a batch touches its slots alone."""
    draw = random.Random(1)
    windows, live = W.HotWindows(spark, f"file://{tmp_path}/w", n=3, slots=8), W.LiveCandles(spark, f"file://{tmp_path}/l", slots=8)
    latest, opened, seq = {}, {}, 0
    for b in range(6):
        final, events = [], []
        for _ in range(10):
            s, t = draw.choice("abcdef"), 60 * draw.randint(0, 9)
            seq += 1
            events.append((s, "1m", t, seq, draw.random() < 0.5))
            if events[-1][4]:
                final.append((s, "1m", t, seq, seq))
                latest.setdefault(s, {})[t] = seq
                if opened.get(s, (None,))[0] == t:
                    opened.pop(s)
            else:
                opened[s] = (t, seq)
        own = {t: max(q for s2, _, t2, q, _ in final if (s2, t2) == t) for t in {(s, t) for s, _, t, _, _ in final}}
        rows = candles(spark, [(s, "1m", t, q, q) for (s, t), q in own.items()])
        before = set(os.listdir(tmp_path / "w" / "data" / "interval=1m")) if b else set()
        windows.put(rows, b)
        assert not windows.put(rows, b)
        moved = {f"slot={r[0]}" for r in rows.select(W.slot_of(8)).distinct().collect()}
        assert set(os.listdir(tmp_path / "w" / "data" / "interval=1m")) == before | moved
        live.apply(candles(spark, [(s, i, t, q, q) for s, i, t, q, _ in events]).join(spark.createDataFrame([(q, c) for *_, q, c in events], "seq long, closed boolean"), "seq").withColumn("trades", F.lit(1).cast("long")), b)
        latest = {s: dict(sorted(v.items())[-3:]) for s, v in latest.items()}
        assert held(windows, "symbol", "start_s", "close") == sorted((s, t, q) for s, v in latest.items() for t, q in v.items())
        assert sorted(map(tuple, live.live().select("symbol", "start_s", "seq").collect())) == sorted((s, *v) for s, v in opened.items())
    assert sorted(r.start_s for r in windows.of("a", "1m").collect()) == sorted(latest["a"])


def delivered(events, commands, ended):
    """One log in order; of one seq the event comes first, then commands, then the session's end."""
    out, follows = [], set()
    log = [(q, 0, s, None, None) for q, s in events] + [(q, 1, y, s, c) for q, s, c, y in commands] + [(q, 2, None, s, None) for q, s in ended]
    for q, kind, symbol, session, command in sorted(log, key=lambda x: (x[0], x[1], x[4] == "SUBSCRIBE")):
        if kind == 0:
            out += [(q, symbol, s) for s, y in follows if y == symbol]
        elif kind == 2:
            follows = {x for x in follows if x[0] != session}
        elif command == "SUBSCRIBE":
            follows.add((session, symbol))
        else:
            follows.discard((session, symbol))
    return sorted(out)


def log_of(seed, n=700):
    draw = random.Random(seed)
    seqs = draw.sample(range(5000), n) + [64, 4096, 262144, 2**41]
    events, commands, ended = [], [], []
    for q in seqs:
        if draw.random() < 0.5:
            events.append((q, draw.choice("AaB")))
        elif draw.random() < 0.9:
            commands.append((q, f"u{draw.randint(0, 8)}", draw.choice(["SUBSCRIBE", "SUBSCRIBE", "UNSUBSCRIBE", "PING"]), draw.choice("AaB")))
        else:
            ended.append((q, f"u{draw.randint(0, 8)}"))
    return events, commands, ended


def frames(spark, events, commands, ended):
    return (
        spark.createDataFrame(events, "seq long, symbol string"),
        spark.createDataFrame(commands, "seq long, session_id string, command string, symbol string"),
        spark.createDataFrame(ended, "seq long, session_id string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_fan_out_as_of(spark, seed):
    """Subscriptions that come, are renewed, go, and end with their session; blocks of every size."""
    log = log_of(seed)
    events, commands, ended = frames(spark, *log)
    got = L.fan_out_as_of(events, L.validity(commands, ended))
    assert sorted(map(tuple, got.select("seq", "symbol", "session_id").collect())) == delivered(*[[r for r in part if len(r) != 4 or r[2] != "PING"] for part in log])


def share_of_largest_task(df) -> float:
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(rows) / sum(rows)


def test_fan_outs_spread_over_tasks(spark):
    """One file of events of one symbol, followed by sessions that last: no task makes most of what goes out."""
    n, events = 40_000, spark.range(300_000, 340_000, 1, 1).select(F.col("id").alias("seq"), F.lit("a").alias("symbol"))
    follows = spark.range(50).select(F.col("id").cast("string").alias("session_id"), F.lit("a").alias("symbol"))
    out = L.fan_out(events, follows)
    assert out.count() == 50 * n and share_of_largest_task(out) < 0.2
    spans = follows.where("session_id < 3").select("session_id", "symbol", F.lit(1).cast("long").alias("from_seq"), F.lit(None).cast("long").alias("to_seq"))
    large = spark.range(2**18, 2**18 * 3, 1, 1).select(F.col("id").alias("seq"), F.lit("a").alias("symbol"))
    out = L.fan_out_as_of(large, spans)  # two whole blocks of 2**18
    assert out.distinct().count() == out.count() == 3 * 2**19 and share_of_largest_task(out) < 0.3
    assert L.fan_out_as_of(events.limit(0), spans).count() == L.fan_out_as_of(events, spans.withColumn("to_seq", F.lit(299_999).cast("long"))).count() == 0


def changes_of_session(df) -> float:
    """The share of rows whose session is not that of the row before, as tasks put them out."""
    parts = df.select("session_id").rdd.mapPartitions(lambda rows: [[r.session_id for r in rows]]).collect()
    return sum(1 + sum(a != b for a, b in zip(p, p[1:])) for p in parts if p) / sum(map(len, parts))  # noqa: B905


def test_fan_outs_go_by_sessions(spark):
    """A session gets many events before the next one does, so that stored deliveries are a small part of a byte a row."""
    events = spark.range(0, 60_000, 1, 2).select(F.col("id").alias("seq"), F.concat(F.lit("s"), F.col("id") % 2).alias("symbol"))
    follows = spark.range(40).select(F.concat(F.lit("u"), "id").alias("session_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("symbol"))
    out = L.fan_out(events, follows)
    assert out.count() == 20 * 60_000 and changes_of_session(out) < 0.02
    spans = follows.select("*", F.lit(100).cast("long").alias("from_seq"), F.lit(None).cast("long").alias("to_seq"))
    out = L.fan_out_as_of(events, spans)
    assert out.count() == 20 * (60_000 - 101) and changes_of_session(out) < 0.02


@pytest.mark.parametrize("name", ["stream_fan_out", "stream_fan_out_as_of"])
def test_streams_store_deliveries_by_sessions(name, spark):
    out = QUERIES[name](spark, SF.replace("0.001", "0.01"))
    assert changes_of_session(out) < 0.1 and all(f.endswith(".zstd.parquet") for f in out.inputFiles())
    assert sum(os.path.getsize(f.replace("file:///", "/")) for f in out.inputFiles()) < 0.9 * out.count()


def test_fan_out_beyond_broadcasts(spark, monkeypatch):
    """Sessions of a hot symbol beyond what is broadcast meet its events in many tasks, each pair once; events may be equal."""
    follows = spark.createDataFrame([(f"u{i}", "aab"[i % 3]) for i in range(90)] + [("u0", None)], "session_id string, symbol string")
    events = spark.range(2_000).select(F.expr("element_at(array('a', 'a', 'b', 'c', null), cast(id % 5 as int) + 1)").alias("symbol"), (F.col("id") % 7).alias("seq"), "id")
    want = sorted(map(tuple, events.join(follows, "symbol").collect()))
    monkeypatch.setattr(L, "BROADCAST_SUBSCRIPTIONS", 20)
    out = L.fan_out(events, follows)
    assert out.columns == ["symbol", "seq", "id", "session_id"] and sorted(map(tuple, out.collect())) == want
    assert share_of_largest_task(L.fan_out(spark.range(40_000).select(F.when(F.col("id") >= 0, "a").alias("symbol"), "id"), follows)) < 0.2
    assert L.fan_out(events.select("symbol"), follows).count() == len(want) and L.fan_out(events, follows.limit(0)).count() == 0


def test_subscriptions_are_carried(spark, tmp_path):
    """The log in four batches, each delivered twice, equals the log as a whole."""
    events, commands, ended = log_of(3)
    table = W.Subscriptions(spark, f"file://{tmp_path}/s", slots=4)
    for b, (low, high) in enumerate(((0, 1000), (1000, 2500), (2500, 2600), (2600, 2**42))):
        part = frames(spark, *([r for r in rows if low <= r[0] < high] for rows in (events, commands, ended)))
        for _ in range(2):
            table.deliver(*part, b, f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").select("seq", "symbol", "session_id")
    assert sorted(map(tuple, got.collect())) == delivered(events, [r for r in commands if r[2] != "PING"], ended)


def recent(rows, within, most):
    """Sequential memory by scanning a list of (id, time) for each row."""
    out, memory, now = [], {}, {}
    for q, s, i, a in sorted(rows):
        now[s] = max(now.get(s, a), a)
        own = [(x, t) for x, t in memory.get(s, []) if now[s] - t < within]
        if i is None or i not in [x for x, _ in own]:
            out.append((q, s, i))
            own += [(i, now[s])] if i is not None else []
        memory[s] = own[-most:]
    return sorted(out, key=repr)


def test_recent_ids_in_batch_and_stream(spark, tmp_path):
    draw = random.Random(4)
    rows = [(q, draw.choice("ab"), draw.choice([None, *map(str, range(12))]), 1000 * q + draw.randint(-3000, 3000)) for q in range(400)]
    schema = "seq long, symbol string, record_id string, arrival_ms long"
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    want = recent(rows, 20_000, 5)
    batch = G.dedupe_recent(spark.createDataFrame(rows, schema).repartition(3), within_ms=20_000, most=5)
    assert sorted(map(tuple, batch.select("seq", "symbol", "record_id").collect()), key=repr) == want
    stream = G.dedupe_recent(G.file_stream(spark, f"file://{tmp_path}/in", schema, 1), within_ms=20_000, most=5)
    G.run_to_end(stream, f"file://{tmp_path}/c", path=f"file://{tmp_path}/out")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").select("seq", "symbol", "record_id").collect()), key=repr) == want
    assert len(want) < 400


def test_recent_ids_beyond_a_hundred_thousand(spark):
    """100,001 ids within the minute: the oldest is forgotten and new again, the second is known, all while the minute lasts."""
    ids = spark.range(100_001).select(F.col("id").alias("seq"), F.lit("a").alias("symbol"), F.col("id").cast("string").alias("record_id"), F.lit(1000).cast("long").alias("arrival_ms"))
    again = spark.createDataFrame([(200_000, "a", "1", 1500), (200_001, "a", "0", 1500), (200_002, "a", "100000", 61_000)], ids.schema)
    got = {r.seq for r in G.dedupe_recent(ids.union(again)).where("seq >= 200000").collect()}
    assert got == {200_001, 200_002}


def test_no_file_before_the_first_batch(spark, tmp_path):
    from candlewright.operators.reconcile import read_audit

    assert G.CandleTable(spark, f"file://{tmp_path}/a").read().collect() == []
    assert read_audit(spark, f"file://{tmp_path}/b").collect() == []
    assert W.CandleStore(spark, f"file://{tmp_path}/c").read().collect() == []


def test_stored_queries_are_pruned(spark):
    assert "day" in filters(QUERIES["scan_stored"](spark, SF)) and "interval" in filters(QUERIES["lookup_stored"](spark, SF))
    assert set(P.QUERIES) <= set(QUERIES)


# Chains, carried rows, landed klines, sketches


def put(spark, folder, df, n):
    """Adds a file to a folder, younger than those before."""
    df.coalesce(1).write.mode("append").parquet(f"file://{folder}")
    for f in os.listdir(folder):
        if f.endswith(".parquet") and not f.startswith("done"):
            os.rename(f"{folder}/{f}", f"{folder}/done{n}.parquet")
            os.utime(f"{folder}/done{n}.parquet", (1_000_000 + 10 * n,) * 2)


def test_frames_to_store_over_a_restart(spark, tmp_path):
    """Stopped after two files and started again with new objects: ids, candles and tables go on; equal to the batch rule."""
    log, steps = P.frame_log(spark, SF), []
    top = log.agg(F.max("seq")).first()[0] + 1
    at = f"file://{tmp_path}"
    for part in ((0, 1), (2, 3)):
        for i in part:
            put(spark, tmp_path / "in", log.where(f"seq * 4 div {top} = {i}"), i)
        store = W.CandleStore(spark, f"{at}/candles")
        live = W.LiveCandles(spark, f"{at}/live")
        sink = W.CandleSink(store, W.HotWindows(spark, f"{at}/windows"), live, f"{at}/batches", lambda rows, n: steps.append((n, store.is_done(n), live.is_done(n))))
        with Y.rocksdb(spark):
            G.run_to_end(Y.frames_to_candles(G.file_stream(spark, f"{at}/in", log.schema, 1), ("1m", "5m")), f"{at}/checkpoint", sink=sink)
    assert steps == [(n, True, True) for n in range(4)]  # each is published once, after its tables
    columns = ("symbol", "interval", "start_s", "open", "high", "low", "close", "volume")
    want = set(map(tuple, D.candles_with_late(S.validate_ticks(S.event_ticks(spark, SF))[0], ("1m", "5m")).select(*columns).collect()))
    got, open_ = ({tuple(r) for r in t.select(*columns).collect()} for t in (store.read(), live.live()))
    assert got | open_ == want and not {r[:3] for r in got} & {r[:3] for r in open_}


def test_frames_are_dealt_and_decoded_once(spark, tmp_path):
    """A micro-batch of one file goes to all cores before it is decoded; filters on what is decoded do not decode it again."""
    P.frame_log(spark, SF).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    frames = spark.read.parquet(f"file://{tmp_path}/in")
    plan = Y.frames_to_candles(G.file_stream(spark, f"file://{tmp_path}/in", frames.schema), ("1m",))._jdf.queryExecution().analyzed().toString()
    decoded = S.validate_ticks(S.decode_tick_frames(frames)[0])[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("conv(") < plan.index("Repartition ") and decoded.count("conv(") <= 16
    encoded = S.encode_tick_frames(S.event_ticks(spark, SF))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert encoded.count("unhex(") == 1


def test_live_candles_get_the_newest_revisions_alone(spark, tmp_path):
    """Of a thousand live revisions of a key in a micro-batch one goes on to the live candles; they end the same."""
    rows = [(s, "1m", 60 * (q // 400), q, Dec(1), Dec(2), Dec(1), Dec(q), 5, k, 1) for s in "ab" for q in range(1000) for k in (["closed", "live"] if q in (400, 800) else ["live"])]
    rows = [(s, i, t - 60 if k == "closed" else t, *r, k, n) for s, i, t, *r, k, n in rows]
    batch = spark.createDataFrame(rows, f"{SCHEMA}, kind string, trades bigint")
    live, seen = W.LiveCandles(spark, f"file://{tmp_path}/l"), []
    apply = live.apply
    live.apply = lambda events, n: (seen.append(events.count()), apply(events, n))
    W.CandleSink(W.CandleStore(spark, f"file://{tmp_path}/c"), W.HotWindows(spark, f"file://{tmp_path}/w"), live, f"file://{tmp_path}/b")(batch, 0)
    assert seen == [2 * 3] and [(r.symbol, r.start_s, r.close) for r in live.live().orderBy("symbol").collect()] == [("a", 120, Dec(999)), ("b", 120, Dec(999))]


def five(spark, rows, schema):
    size = -(-len(rows) // 5)
    return [spark.createDataFrame(rows[i : i + size], schema) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("operator, carry", [(lambda r: O.monotonic_ticker(r, 7), W.carry_highest), (lambda r: O.price_direction(r, 7), W.carry_last_move)])
def test_carried_rows(spark, tmp_path, operator, carry):
    """Five micro-batches in chunks of 7, each run twice, equal the batch; a hot symbol, one that pauses, equal prices."""
    draw = random.Random(8)
    rows = [(draw.choice("aaaab" if q < 90 or q > 170 else "aaaac"), q, 1000 * q - draw.choice([0, 0, 30_000]), Dec(draw.choice([1, 1, 2, 3]))) for q in range(200)]
    schema = "symbol string, seq bigint, event_ms bigint, price decimal(18,6)"
    table = W.CarriedRows(spark, f"file://{tmp_path}/t", schema, slots=4)
    for b, part in enumerate(five(spark, rows, schema)):
        for _ in range(2):
            table.run(part, operator, carry, b, f"file://{tmp_path}/out")
    want = operator(spark.createDataFrame(rows, schema))
    got = spark.read.parquet(f"file://{tmp_path}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_landed_klines(spark, tmp_path):
    """Two runs equal one, the second takes new files alone, and only touched days and changed buckets are written."""
    stored = candles(spark, [("a", "1m", 60 * m, 0, 3) for m in range(10) if m != 4] + [("a", "5m", 0, 0, 3), ("a", "5m", 300, 0, 3), ("a", "1m", 5 * DAY, 0, 3)])
    feed = candles(spark, [("a", "1m", 60 * m, 0, 9 if m == 7 else 3) for m in range(10)]).drop("seq")
    tables = []
    for name, cuts in (("one", [(0, 600)]), ("two", [(0, 300), (300, 600)])):
        store = W.CandleStore(spark, f"file://{tmp_path}/{name}")
        store.merge(stored, -1)
        sink = W.Reconciler(store, f"file://{tmp_path}/{name}_audit", 0)
        seen = []

        def run(b, n, sink=sink, seen=seen):
            seen.append(b.count())
            sink(b, n)
            sink(b, n)

        for i, (low, high) in enumerate(cuts):
            put(spark, tmp_path / f"{name}_in", feed.where(f"start_s >= {low} and start_s < {high}"), i)
            G.run_to_end(G.file_stream(spark, f"file://{tmp_path}/{name}_in", feed.schema, 1), f"file://{tmp_path}/{name}_c", sink=run)
        assert seen == [(high - low) // 60 for low, high in cuts]
        audit = spark.read.parquet(f"file://{tmp_path}/{name}_audit")
        assert sorted((r.start_s, r.reason) for r in audit.collect()) == [(240, "MISSING"), (420, "MISMATCH")]
        tables.append(held(store, "symbol", "interval", "start_s", "open", "close", "volume"))
        versions = {(r.interval, r.start_s): r.version for r in store.read().collect()}
        assert versions[("1m", 420)] == 1 and versions[("1m", 240)] == 0 and versions[("1m", 5 * DAY)] == 0 and versions[("5m", 300)] == 1
    assert tables[0] == tables[1] and ("a", "30m", 0, Dec(1), Dec(3), 50) in tables[0]


def test_sketches_merge_within_their_error(spark):
    """Hours from minutes of a million values in one hot key: ranks within the stated error; sketches stay small."""
    n, k = 1_000_000, 512
    rows = spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 3600).cast("timestamp_ntz").alias("ts"), (F.xxhash64("id") % 1_000_003).cast("double").alias("value"))
    sketches = H.latency_sketches(rows, ("k",), k)
    assert sketches.count() == 60 and sketches.agg(F.max(F.octet_length("sketch"))).first()[0] < 40 * k
    (got,) = H.sketch_percentiles(sketches, ("k",), 3600, k).collect()
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")):
        rank = rows.where(F.col("value") <= got[name]).count() / n
        assert abs(rank - q) <= 2.7 / k
    nothing = spark.createDataFrame([("a", None)], "k string, value double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert H.sketch_percentiles(H.latency_sketches(nothing, ("k",)), ("k",)).collect() == []


def test_revisions_with_carried_buckets(spark, tmp_path):
    """Micro-batches down to one tick, each run twice: late ticks over their borders, skipped and expired buckets, a hot symbol."""
    draw = random.Random(12)
    rows, now = [], 1_000_000_000
    for q in range(160):
        now += draw.choice([100, 5_000, 40_000, 70_000])
        rows.append((q, draw.choice("aaab"), Dec(draw.randint(1, 9)), Dec(draw.randint(1, 5)), now - draw.choice([0, 0, 0, 30_000, 90_000, 200_000, 600_000]), now))
    schema = "seq bigint, symbol string, price decimal(18,6), quantity decimal(18,8), event_ms bigint, arrival_ms bigint"
    table, cuts = W.CandleRevisions(spark, f"file://{tmp_path}/t", slots=2), [0, 1, 40, 90, 92, 160]
    for b, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = spark.createDataFrame(rows[low:high], schema)
        for _ in range(2):
            table.run(part, ("1m", "5m"), b, f"file://{tmp_path}/out")
    columns = ("symbol", "interval", "start_s", "seq", "kind", "open", "high", "low", "close", "volume", "trades")
    want = D.candle_revisions(spark.createDataFrame(rows, schema), ("1m", "5m"))
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert {r.kind for r in got.collect()} == {"live", "late", "closed"} and table.read().groupBy("symbol", "interval").count().agg(F.max("count")).first()[0] <= 4
