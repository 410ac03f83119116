"""Stored tables that a stream changes: candles by interval and day, hot windows and live candles by slots of symbols.

A micro-batch reads and rewrites the partitions that it touches and no others, so its cost does not grow with the age
of a table. A rewrite is staged first: a job cannot overwrite what it reads, and what a crash leaves half replaced is
replaced again from the stage when the batch is repeated. A mark for each batch that is done makes a repeated one change
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.functions.numbers import scale_volume
from candlewright.functions.time import INTERVALS, bucket_start
from candlewright.operators.aggregate import PRICES, expand_intervals, rollup, with_bucket
from candlewright.operators.changelog import KEY, fan_out_as_of, materialized_live, put_bucket, validity
from candlewright.operators.late import KEEP, TTL_MS, bucket_directory, fate_of
from candlewright.operators.ordered import HOT_ROWS
from candlewright.operators.reconcile import VALUES, append_audit, changed_only, reconcile

_VALUES = "open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume bigint"
#: Slots of symbols that windows and live candles are dealt to.
SLOTS = 64


def day_of(start_s: str = "start_s"):
    return F.expr(f"{start_s} div 86400 - if({start_s} % 86400 < 0, 1, 0)")


def slot_of(slots: int):
    return F.pmod(F.xxhash64("symbol"), F.lit(slots)).cast("int")


class PartitionedTable:
    """Parquet files by the columns ``by``, in each of them sorted by ``order``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...], order: tuple[str, ...]):
        self.spark, self.path, self.schema, self.by, self.order = spark, path, schema, by, order
        self.data = f"{path}/data"
        self._files(self.data)[0].mkdirs(self._files(self.data)[1])

    def _files(self, at: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, at: str) -> bool:
        fs, where = self._files(at)
        return fs.exists(where)

    def read(self) -> DataFrame:
        """All rows, with the columns that they are partitioned by; none before the first batch."""
        return self.spark.read.schema(self.schema).parquet(self.data)

    def touched(self, rows: DataFrame) -> list[Row]:
        """The partitions that ``rows`` belong to: a few for each day or slot."""
        return rows.select(*self.by).distinct().collect()

    def only(self, parts: list[Row]) -> DataFrame:
        """The rows of some partitions; no other is read."""
        if not parts:
            return self.read().limit(0)
        groups: dict[tuple, list] = {}
        for p in parts:
            groups.setdefault(tuple(p)[:-1], []).append(p[-1])
        one = lambda head, last: reduce(lambda a, b: a & b, [*(F.col(c) == v for c, v in zip(self.by, head, strict=False)), F.col(self.by[-1]).isin(last)])
        return self.read().where(reduce(lambda a, b: a | b, (one(h, v) for h, v in groups.items())))

    def is_done(self, batch: int) -> bool:
        return self._exists(f"{self.path}/done/{batch}")

    def is_staged(self, batch: int) -> bool:
        """Whether a batch has been computed, so that the table may hold some of it."""
        return self.is_done(batch) or self._exists(f"{self.path}/staged/{batch}/_SUCCESS")

    def replace(self, make: Callable[[], DataFrame], batch: int) -> bool:
        """Replaces the partitions of the rows that ``make`` gives by these rows; a batch that is done changes nothing."""
        if self.is_done(batch):
            return False
        staged, names = f"{self.path}/staged/{batch}", self.read().columns
        if not self.is_staged(batch):
            # Rebalancing puts a partition's rows together, splits those that are too large and needs no sample.
            rows = make().select(*names).hint("rebalance", *self.by).sortWithinPartitions(*self.by, *self.order)
            rows.write.mode("overwrite").partitionBy(*self.by).parquet(staged)
        ready = self.spark.read.schema(self.schema).parquet(staged).sortWithinPartitions(*self.by, *self.order)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.data)
        fs, done = self._files(f"{self.path}/done/{batch}")
        fs.mkdirs(done)
        fs.delete(self._files(staged)[1], True)
        return True

    def finish(self, batch: int) -> None:
        """Puts a staged batch in place, if that is not done."""
        if self.is_staged(batch):
            self.replace(self.read, batch)  # what is staged is not made again


class CandleStore(PartitionedTable):
    """Candles (symbol, interval, start_s, values, version) by interval and day, sorted by symbol and start."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, f"symbol string, start_s bigint, {_VALUES}, version bigint, interval string, day bigint", ("interval", "day"), ("symbol", "start_s"))

    def merge(self, changes: DataFrame, batch: int) -> bool:
        """Puts in the last revision (by seq) of each candle: a known candle's version rises by one, a new one has version 0.

        Intervals that are not known are left out. ``changes`` is read twice. Of a batch that is done nothing happens.
        """
        own = changes.where(F.col("interval").isin(*INTERVALS)).groupBy(*KEY).agg(F.max_by(F.struct(*VALUES), "seq").alias("r"))
        last = own.select(*KEY, "r.*").withColumn("day", day_of())

        def merged() -> DataFrame:
            old = self.only(self.touched(changes.where(F.col("interval").isin(*INTERVALS)).select("interval", day_of().alias("day"))))
            joined = old.alias("o").join(last.withColumn("new", F.lit(True)).alias("n"), [*KEY, "day"], "full")
            version = F.when(F.col("version").isNull(), 0).when(F.col("new"), F.col("version") + 1).otherwise(F.col("version")).cast("long")
            pick = lambda c: F.when(F.col("new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            return joined.select(*KEY, "day", *(pick(c) for c in VALUES), version.alias("version"))

        return self.replace(merged, batch)


class HotWindows(PartitionedTable):
    """The newest ``n`` candles of each symbol and interval."""

    def __init__(self, spark: SparkSession, path: str, n: int = HOT_ROWS, slots: int = SLOTS):
        super().__init__(spark, path, f"symbol string, start_s bigint, {_VALUES}, interval string, slot int", ("interval", "slot"), ("symbol", "start_s"))
        self.n, self.slots = n, slots

    def put(self, candles: DataFrame, batch: int) -> bool:
        """Candles take the place of those of their buckets, and the newest ``n`` of each key stay; ``candles`` is read twice."""
        own = candles.select(*KEY, *VALUES).withColumn("slot", slot_of(self.slots))
        return self.replace(lambda: put_bucket(self.only(self.touched(own)), own, self.n), batch)

    def of(self, symbol: str, interval: str) -> DataFrame:
        """The window of one symbol and interval; no other slot is read."""
        slot = self.spark.range(1).select(F.lit(symbol).alias("symbol")).select(slot_of(self.slots)).first()[0]
        return self.read().where((F.col("interval") == interval) & (F.col("slot") == slot) & (F.col("symbol") == symbol))


class LiveCandles(PartitionedTable):
    """The open candle of each symbol and interval that no closed one of the same start has cleared."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        super().__init__(spark, path, f"symbol string, start_s bigint, seq bigint, closed boolean, {_VALUES}, trades bigint, interval string, slot int", ("interval", "slot"), ("symbol",))
        self.slots = slots

    def apply(self, events: DataFrame, batch: int) -> bool:
        """The latest open candle of each key after ``events`` (seq, closed); cleared ones leave a row that says closed."""
        own = events.select(*KEY, "seq", "closed", *VALUES, "trades").withColumn("slot", slot_of(self.slots))

        def applied() -> DataFrame:
            both = self.only(self.touched(own)).unionByName(own)
            live = materialized_live(both)
            gone = both.groupBy("symbol", "interval", "slot").agg(F.max_by(F.struct("start_s", "seq", F.lit(True).alias("closed"), *VALUES, "trades"), "seq").alias("r"))
            cleared = gone.select("symbol", "interval", "slot", "r.*").join(live.select("symbol", "interval"), ["symbol", "interval"], "left_anti")
            return live.unionByName(cleared)

        return self.replace(applied, batch)

    def live(self) -> DataFrame:
        return self.read().where("not closed")


class CandleSink:
    """A foreachBatch function over revisions (kind live, closed or late) of candles, in the order that each finalized one asks for.

    Finalized candles (closed or late) go into the table, then into the hot windows, then clear the live candle of their
    start, and then all revisions are handed to ``publish``. Each step is done once for a batch, also when it is repeated.
    """

    def __init__(self, store: CandleStore, windows: HotWindows, live: LiveCandles, path: str, publish: Callable[[DataFrame, int], None] | None = None):
        self.store, self.windows, self.live, self.path, self.publish = store, windows, live, path, publish

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Written once: each step reads it, and reading the batch itself would run its stateful operators again.
        batch.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        rows = spark.read.schema(batch.schema).parquet(f"{self.path}/{batch_id}")
        final = rows.where("kind <> 'live'")
        self.store.merge(final, batch_id)
        newest = final.groupBy(*KEY).agg(F.max_by(F.struct(*VALUES), "seq").alias("r")).select(*KEY, "r.*")
        self.windows.put(newest, batch_id)
        # Of the live revisions, which are most, the newest of each key is all that counts.
        rest = [c for c in rows.columns if c not in ("symbol", "interval")]
        last = rows.where("kind = 'live'").groupBy("symbol", "interval").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("symbol", "interval", "r.*")
        told = f"{self.path}/{batch_id}_told"
        closed_first = F.col("seq") * 2 + F.when(F.col("kind") == "live", 1).otherwise(0)
        final.unionByName(last).withColumn("closed", F.col("kind") != "live").withColumn("seq", closed_first).write.mode("overwrite").parquet(told)
        self.live.apply(spark.read.parquet(told), batch_id)
        if self.publish is not None:
            self.publish(rows, batch_id)
        for done in (f"{self.path}/{batch_id}", told):
            fs, at = self.store._files(done)
            fs.delete(at, True)


class Subscriptions(PartitionedTable):
    """What every session follows now, carried from one micro-batch of a log of commands to the next."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        super().__init__(spark, path, "symbol string, session_id string, seq bigint, slot int", ("slot",), ("symbol", "session_id"))
        self.slots = slots

    def deliver(self, events: DataFrame, commands: DataFrame, ended: DataFrame, batch: int, out: str) -> None:
        """Writes a row of ``events`` (seq, symbol) for each session that follows its symbol at its seq, to out/batch=N.

        A repeated batch writes the same rows or, once what follows is being stored, none again. The whole table is read:
        a row for each subscription that is valid, whatever the age of the log.
        """
        if self.is_staged(batch):
            self.finish(batch)
            return
        before = self.read().where("session_id is not null")
        log = before.select("seq", "session_id", F.lit("SUBSCRIBE").alias("command"), "symbol").unionByName(commands.select("seq", "session_id", "command", "symbol"))
        valid = validity(log, ended)
        # Deliveries repeat themselves over and over, which zstd shortens further than the default.
        fan_out_as_of(events, valid).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch}")

        def now() -> DataFrame:
            kept = valid.where("to_seq is null").select("symbol", "session_id", F.col("from_seq").alias("seq"), slot_of(self.slots).alias("slot"))
            # A row without a session for each slot, so that an emptied slot is replaced too.
            every = self.spark.range(self.slots).select(F.lit("").alias("symbol"), F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.col("id").cast("int").alias("slot"))
            return kept.unionByName(every)

        self.replace(now, batch)


class CarriedRows(PartitionedTable):
    """Rows that decide what comes after: an ordered operator over one micro-batch after another, with no task for a whole key.

    Each micro-batch goes through the batch operator, which spreads a key over many tasks, together with the few rows
    that ``carry`` kept of those before. ``schema`` is that of the rows, which have symbol and an order by seq.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, slots: int = SLOTS):
        super().__init__(spark, path, f"{schema}, slot int", ("slot",), ("symbol", "seq"))
        self.slots, self.names = slots, [c for c in self.read().columns if c != "slot"]

    def run(self, rows: DataFrame, operator: Callable[[DataFrame], DataFrame], carry: Callable[[DataFrame], DataFrame], batch: int, out: str) -> None:
        """Writes what ``operator`` makes of the carried rows and these, without the carried ones, to out/batch=N.

        A repeated batch writes the same rows or, once what is carried is being stored, none again. Only slots of the
        batch's symbols are read.
        """
        if self.is_staged(batch):
            self.finish(batch)
            return
        own = rows.select(*self.names).withColumn("slot", slot_of(self.slots))
        before = self.only(self.touched(own))
        both = before.unionByName(own)
        made = operator(both.select(*self.names))
        # Rows of a batch come after all before it in seq, so the carried ones are told by their seq.
        fresh_rows = made.join(own.groupBy("symbol").agg(F.min("seq").alias("_first")), "symbol").where("seq >= _first").drop("_first")
        fresh_rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        self.replace(lambda: carry(both), batch)


def carry_highest(rows: DataFrame) -> DataFrame:
    """For tickers: the row of the newest event time of each symbol."""
    rest = [c for c in rows.columns if c not in ("symbol", "slot")]
    return rows.groupBy("symbol", "slot").agg(F.max_by(F.struct(*rest), F.struct("event_ms", "seq")).alias("r")).select("symbol", "slot", "r.*")


def carry_last_move(rows: DataFrame) -> DataFrame:
    """For price directions: the last row of each symbol, and the last before it of another price."""
    rest = [c for c in rows.columns if c not in ("symbol", "slot")]
    last = F.max_by(F.struct(*rest), "seq").alias("r")
    end = rows.groupBy("symbol", "slot").agg(last).select("symbol", "slot", "r.*")
    other = rows.join(end.select("symbol", F.col("price").alias("_last")), "symbol").where("price <> _last").groupBy("symbol", "slot").agg(last)
    return end.unionByName(other.select("symbol", "slot", "r.*"))


class Reconciler:
    """A foreachBatch function over landed exchange klines (1-minute candles): only what has landed is compared.

    Of a micro-batch the touched days of the table are read; differences go to the audit log and, with the 5- and
    30-minute candles of the buckets that they change, into the table. A repeated batch replaces its own audit rows and
    changes nothing else.
    """

    def __init__(self, store: CandleStore, audit: str, created_ms: int):
        self.store, self.audit, self.created_ms = store, audit, created_ms

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.store.is_staged(batch_id):
            self.store.finish(batch_id)
            return
        spark, at = batch.sparkSession, f"{self.store.path}/feed/{batch_id}"
        batch.select(*KEY, *VALUES).dropDuplicates(list(KEY)).write.mode("overwrite").parquet(at)
        feed = spark.read.parquet(at)
        days = sorted({r.day for r in feed.select(day_of().alias("day")).distinct().collect()})
        near = self.store.read().where(F.col("day").isin(days))
        own = near.where("interval = '1m'").select(*KEY, *VALUES)
        changes, audit = reconcile(own, feed)
        append_audit(audit, self.audit, batch_id, self.created_ms)
        corrected = own.join(changes, list(KEY), "left_anti").unionByName(changes)
        out = changes
        for interval in ("5m", "30m"):
            d = INTERVALS[interval]
            touched = changes.select("symbol", bucket_start(F.col("start_s"), d).alias("_b")).distinct()
            minutes = corrected.withColumn("_b", bucket_start(F.col("start_s"), d)).join(touched, ["symbol", "_b"], "left_semi").drop("_b")
            whole = rollup(minutes.withColumn("trades", F.lit(0)), interval)
            out = out.unionByName(changed_only(whole, near.where(F.col("interval") == interval)))
        self.store.merge(out.withColumn("seq", F.lit(0)), batch_id)
        fs, where = self.store._files(at)
        fs.delete(where, True)


class CandleRevisions(PartitionedTable):
    """The changelog of candles over one micro-batch after another by joins and windows, with no task for a whole symbol.

    Carried are, for each symbol and interval, the newest ``keep`` + 1 opened buckets: when each was opened and its candle
    so far. A tick of an older bucket cannot count, so nothing else is needed. As in the batch rule the ticks of one
    candle meet in one task, and no more.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP, ttl_ms: int = TTL_MS, slots: int = SLOTS):
        super().__init__(spark, path, f"symbol string, interval string, start_s bigint, seq bigint, open_seq bigint, open_ms bigint, closed boolean, {_VALUES}, trades bigint, slot int", ("slot",), (*KEY,))
        self.keep, self.ttl_ms, self.slots = keep, ttl_ms, slots

    def run(self, ticks: DataFrame, intervals: tuple[str, ...], batch: int, out: str) -> None:
        """Writes the revisions (kind live, closed or late) that these ticks give rise to, to out/batch=N.

        Batches come in order of seq. A repeated one writes the same rows or, once what is carried is being stored, none again.
        """
        if self.is_staged(batch):
            self.finish(batch)
            return
        own = with_bucket(expand_intervals(ticks, intervals)).select(*KEY, "seq", "arrival_ms", "price", scale_volume(F.col("quantity")).alias("volume"))
        before = self.only(self.touched(ticks.select(slot_of(self.slots).alias("slot"))))
        first = before.select(*KEY, F.col("open_seq").alias("seq"), F.col("open_ms").alias("arrival_ms"))
        places = bucket_directory(own.select(*KEY, "seq", "arrival_ms").unionByName(first), self.keep)
        fated = own.join(places, list(KEY), "left").withColumn("fate", fate_of("open_seq", "closed_seq", "closed_ms", "expired_seq", self.ttl_ms)).where("fate <> 'late_dropped'")
        price = F.col("price").cast("decimal(18,6)")
        now = fated.select(*KEY, "seq", "closed_seq", (F.col("fate") == "on_time").alias("on_time"), F.lit(False).alias("carried"), *(price.alias(c) for c in PRICES), "volume", F.lit(1).cast("long").alias("trades"))
        then = before.join(places.select(*KEY, "closed_seq"), list(KEY)).select(*KEY, "seq", "closed_seq", (~F.col("closed")).alias("on_time"), F.lit(True).alias("carried"), *VALUES, "trades")
        bucket = Window.partitionBy(*KEY).orderBy("seq")
        over = bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.col("on_time") & F.lead("on_time", 1, False).over(bucket).eqNullSafe(F.lit(False)) & F.col("closed_seq").isNotNull()
        running = now.unionByName(then).select(
            *KEY, "seq", "carried", "on_time", "closed_seq", last.alias("closes"), F.first("open").over(over).alias("open"), F.max("high").over(over).alias("high"),
            F.min("low").over(over).alias("low"), "close", F.sum("volume").over(over).alias("volume"), F.sum("trades").over(over).alias("trades"),
        )
        row = lambda seq, kind: F.array(F.struct(seq.alias("seq"), kind.alias("kind")))
        none = F.array().cast("array<struct<seq: bigint, kind: string>>")
        told = F.when(F.col("carried"), none).otherwise(row(F.col("seq"), F.when(F.col("on_time"), "live").otherwise("late")))
        ends = F.when(F.col("closes"), row(F.col("closed_seq"), F.lit("closed"))).otherwise(none)
        running.select(*KEY, F.inline(F.concat(told, ends)), *VALUES, "trades").write.mode("overwrite").parquet(f"{out}/batch={batch}")

        def carry() -> DataFrame:
            end = running.groupBy(*KEY).agg(F.max_by(F.struct("seq", *VALUES, "trades"), "seq").alias("r")).select(*KEY, "r.*")
            newest = places.where("expired_seq is null").select(*KEY, "open_seq", "open_ms", F.col("closed_seq").isNotNull().alias("closed"))
            return end.join(newest, list(KEY)).withColumn("slot", slot_of(self.slots))

        self.replace(carry, batch)
