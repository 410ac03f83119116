"""Streams over several micro-batches, restarts and repeated batches against the batch operators."""

import os
from collections import Counter
from decimal import Decimal as Dec

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import late as D
from candlewright.operators import ordered as O
from candlewright.sources import ticks as S
from candlewright.streaming import candles as G

SF = "/root/testdata/sf0.001"
ALL = ("1m", "5m", "30m")
FILES = 5


@pytest.fixture
def source(spark, tmp_path):
    """A folder, a function that puts the next files of events into it in order of seq, and the stream over it."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.toPandas().sort_values("event_id")
    folder = tmp_path / "in"
    folder.mkdir()
    size = -(-len(rows) // FILES)
    pieces = [rows[i : i + size] for i in range(0, len(rows), size)]

    def put(n):
        for _ in range(n):
            k = FILES - len(pieces)
            at = str(tmp_path / f"part{k}")
            spark.createDataFrame(pieces.pop(0), events.schema).coalesce(1).write.parquet(f"file://{at}")
            (file,) = [f for f in os.listdir(at) if f.endswith(".parquet")]
            os.utime(f"{at}/{file}", (1_000_000 + 10 * k,) * 2)
            os.rename(f"{at}/{file}", folder / f"{k}.parquet")

    stream = S.validate_ticks(S.as_ticks(G.file_stream(spark, f"file://{folder}", events.schema, files_a_trigger=1)))[0]
    batch = S.validate_ticks(S.as_ticks(events))[0]
    return put, stream, batch


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def batches(spark, checkpoint):
    return len([f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()])


@pytest.mark.parametrize("make, plain, columns", [
    (lambda s: G.stream_candles(s, ALL), lambda b: D.candle_revisions(b, ALL), ("symbol", "interval", "start_s", "seq", "kind", "open", "high", "low", "close", "volume", "trades")),
    (G.stream_ticker, O.monotonic_ticker, ("seq", "symbol", "event_ms")),
])
def test_state_crosses_batches_and_a_restart(spark, source, tmp_path, make, plain, columns):
    put, stream, batch = source
    at = f"file://{tmp_path}"
    for n in (2, FILES - 2):
        put(n)
        G.run_to_end(make(stream), f"{at}/checkpoint", path=f"{at}/out")
    assert batches(spark, tmp_path / "checkpoint") == FILES
    assert rows(spark.read.parquet(f"{at}/out"), *columns) == rows(plain(batch), *columns)


def test_sink_takes_a_repeated_batch_once(spark, source, tmp_path):
    """Table, then publication, in this order for each batch; a batch that comes again changes nothing."""
    put, stream, batch = source
    table, order = G.CandleTable(spark, f"file://{tmp_path}/t"), []

    def publish(b, n):
        order.append((n, table.read().count()))

    sink = G.candle_sink(table, publish)

    def twice(b, n):
        sink(b, n)
        sink(b, n)

    put(FILES)
    G.run_to_end(G.stream_candles(stream, ALL), f"file://{tmp_path}/checkpoint", sink=twice)
    assert [n for n, _ in order] == [i for i in range(FILES) for _ in (0, 1)]
    assert all(a == b for a, b in zip(order[::2], order[1::2], strict=True)) and order[0][1] > 0
    columns = ("symbol", "interval", "start_s", "open", "high", "low", "close", "volume")
    assert rows(table.read(), *columns) == rows(D.candles_with_late(batch, ALL), *columns)
    written = Counter(tuple(r) for b in range(FILES) for r in spark.read.parquet(f"file://{tmp_path}/t/batch={b}").select("symbol", "interval", "start_s").distinct().collect())
    assert {tuple(r[:3]): r.version for r in table.read().select("symbol", "interval", "start_s", "version").collect()} == {k: n - 1 for k, n in written.items()}


def put_ticks(spark, folder, n, rows_):
    schema = "seq bigint, symbol string, price decimal(18,6), quantity decimal(18,8), event_ms bigint, record_id string"
    df = spark.createDataFrame([(s, "a", Dec(p), Dec(1), ms, f"r{s % 100}") for s, p, ms in rows_], schema)
    df.coalesce(1).write.parquet(f"file://{folder}/tmp{n}")
    (file,) = [f for f in os.listdir(folder / f"tmp{n}") if f.endswith(".parquet")]
    os.utime(folder / f"tmp{n}" / file, (1_000_000 + 10 * n,) * 2)
    (folder / "in").mkdir(exist_ok=True)
    os.rename(folder / f"tmp{n}" / file, folder / "in" / f"{n}.parquet")
    return schema


def test_windowed_candles_drop_what_comes_past_the_watermark(spark, tmp_path):
    """Append mode: a window goes out once the watermark, two minutes behind, has passed it; later rows for it are lost."""
    minute = 60_000
    schema = put_ticks(spark, tmp_path, 0, [(0, 5, 0), (1, 6, minute), (2, 9, 3 * minute + 1)])
    put_ticks(spark, tmp_path, 1, [(3, 7, minute + 5)])  # late, but within two minutes of 3:00
    put_ticks(spark, tmp_path, 2, [(4, 8, 10 * minute)])
    put_ticks(spark, tmp_path, 3, [(5, 8, 10 * minute + 1)])  # windows go out a batch after what moved the watermark
    put_ticks(spark, tmp_path, 4, [(6, 99, minute + 9), (7, 4, 20 * minute)])  # the first is past the watermark
    put_ticks(spark, tmp_path, 5, [(8, 4, 20 * minute + 1)])
    stream = G.stream_candles_windowed(G.file_stream(spark, f"file://{tmp_path}/in", schema, 1), "1m")
    G.run_to_end(stream, f"file://{tmp_path}/checkpoint", path=f"file://{tmp_path}/out")
    got = spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out")
    assert rows(got, "start_s", "open", "high", "trades") == [(0, 5, 5, 1), (60, 6, 7, 2), (180, 9, 9, 1), (600, 8, 8, 2)]


def test_dedupe_across_batches(spark, tmp_path):
    minute = 60_000
    schema = put_ticks(spark, tmp_path, 0, [(1, 1, 0), (101, 1, 10), (2, 1, 20)])
    put_ticks(spark, tmp_path, 1, [(201, 1, 5_000), (3, 1, 6_000)])
    put_ticks(spark, tmp_path, 2, [(4, 1, 20 * minute)])
    put_ticks(spark, tmp_path, 3, [(5, 1, 20 * minute + 1)])  # here the memory of r1, a minute long, ends
    put_ticks(spark, tmp_path, 4, [(301, 1, 20 * minute + 2)])
    stream = G.file_stream(spark, f"file://{tmp_path}/in", schema, 1).withColumn("arrived", F.timestamp_millis("event_ms"))
    G.run_to_end(G.dedupe_ticks(stream).select("record_id", "seq"), f"file://{tmp_path}/checkpoint", path=f"file://{tmp_path}/out")
    got = Counter(r[0] for r in rows(spark.read.parquet(f"file://{tmp_path}/out"), "record_id"))
    assert got == {"r1": 2, "r2": 1, "r3": 1, "r4": 1, "r5": 1}


def test_messages_from_text_files(spark, tmp_path):
    """Trade messages as lines of text, broken ones between, over two files and a restart: equal to reading them at once."""
    lines = [f'{{"data":{{"s":"BTC","p":"{i % 7 + 1}.5","q":"2","E":{1_000_000 + i}}}}}' if i % 5 else "{broken" for i in range(40)]
    (tmp_path / "in").mkdir()
    for n in (0, 1):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines[20 * n : 20 * n + 20]))
        os.utime(tmp_path / "in" / f"{n}.txt", (1_000 + n,) * 2)
        stream = S.read_trade_json(G.message_stream(spark, f"file://{tmp_path}/in", files_a_trigger=1))
        G.run_to_end(stream, f"file://{tmp_path}/checkpoint", path=f"file://{tmp_path}/out")
    whole = S.read_trade_json(spark.createDataFrame([(x, 1_000_000 + 1000 * (i // 20)) for i, x in enumerate(lines)], "value string, arrival_ms bigint"))
    columns = ("symbol", "price", "quantity", "event_ms", "arrival_ms")
    got = rows(spark.read.parquet(f"file://{tmp_path}/out"), *columns)
    assert got == rows(whole, *columns) and len(got) == 32


def test_landed_rows_in_bounded_micro_batches(spark, monkeypatch, tmp_path):
    """A table of more rows than a micro-batch may have goes in several, in order, each row once; a fixed number stays."""
    from candlewright.plans import stored

    monkeypatch.setattr(stored, "ROWS", 100)
    rows = spark.range(1050).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("x")).repartition(4)
    for name, given, want in (("many", {}, 11), ("few", {"pieces": 3}, 3)):
        seen = []
        G.run_to_end(stored.landed(rows, "seq", **given), f"file://{tmp_path}/{name}", sink=lambda b, _, seen=seen: seen.append(sorted((r.seq, r.x) for r in b.collect())))
        assert len(seen) == want and [r for batch in seen for r in batch] == [(i, 2 * i) for i in range(1050)]
    monkeypatch.setattr(stored, "ROWS", 10_000)
    G.run_to_end(stored.landed(rows.limit(0), "seq"), f"file://{tmp_path}/none", sink=lambda b, _: None)


def test_rows_in_order_hold_numbers_alone():
    frames = [pd.DataFrame({"symbol": ["a"] * 3, "seq": q, "x": [i * 10 for i in q]}) for q in ([5, 1, 3], [4, 0, 2])]
    assert list(G.in_order(iter(frames), ["seq", "x"])) == [(i, i * 10) for i in range(6)]
