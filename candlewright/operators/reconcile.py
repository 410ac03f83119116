"""Reconciliation of stored candles with an exchange feed, and the tables it writes."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions.time import INTERVALS, millis_to_ntz

from .aggregate import PRICES, in_range, rollup

VALUES = (*PRICES, "volume")
KEY = ("symbol", "interval", "start_s")
AUDIT_ROWS = "symbol string, interval_type string, start_s bigint, reason string, expected_close decimal(18,6), actual_close decimal(18,6), created_at timestamp_ntz, batch int"


def _differs(left: str, right: str, columns=VALUES):
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def reconcile(actual: DataFrame, expected: DataFrame, round_expected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(changes, audit): expected candles that are absent or differ in any value, and why.

    Prices of ``expected`` are rounded to the 6 decimals that tables store; without that, longer ones differ
    on every run. ``changes`` has the columns of ``actual``'s key and values, ``audit`` reason and closes.
    """
    if round_expected:
        expected = expected.withColumns({c: F.col(c).cast("decimal(18,6)") for c in PRICES})
    joined = expected.select(*KEY, *VALUES).alias("e").join(actual.select(*KEY, *VALUES).alias("a"), list(KEY), "left")
    reason = F.when(F.col("a.close").isNull(), "MISSING").when(_differs("e", "a"), "MISMATCH")
    found = joined.withColumn("reason", reason).where("reason is not null")
    changes = found.select(*KEY, *(F.col(f"e.{c}").alias(c) for c in VALUES))
    audit = found.select(*KEY, "reason", F.col("e.close").alias("expected_close"), F.col("a.close").alias("actual_close"))
    return changes, audit


def append_audit(audit: DataFrame, path: str, batch: int, created_ms: int) -> None:
    """Appends audit rows as one folder for each batch; a batch that is written again replaces its own rows."""
    rows = audit.withColumnRenamed("interval", "interval_type").withColumn("created_at", millis_to_ntz(F.lit(created_ms)))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All audit rows, with the batch that wrote them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)  # no batch has been written yet
    return spark.read.schema(AUDIT_ROWS).parquet(path)


def changed_only(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` that ``existing`` has not, or has with other values."""
    joined = new.select(*KEY, *VALUES).alias("n").join(existing.select(*KEY, *VALUES).alias("o"), list(KEY), "left")
    return joined.where(_differs("n", "o")).select(*KEY, *(F.col(f"n.{c}").alias(c) for c in VALUES))


def upserted(target: DataFrame, changes: DataFrame, warn: bool = False) -> DataFrame:
    """``target`` (key, values, version) after ``changes``: found rows are overwritten, version + 1, new ones have version 0.

    Changes of unknown intervals are ignored; ``warn`` says so, in a job of its own.
    """
    if warn and not (odd := changes.where(~F.col("interval").isin(*INTERVALS)).select("interval").distinct().limit(10)).isEmpty():
        warnings.warn(f"changes of unknown intervals are ignored: {', '.join(sorted(str(r[0]) for r in odd.collect()))}", stacklevel=2)
    known = changes.where(F.col("interval").isin(*INTERVALS))
    joined = target.select(*KEY, *VALUES, "version").alias("t").join(known.select(*KEY, *VALUES, F.lit(True).alias("new")).alias("c"), list(KEY), "full")
    version = F.when(F.col("t.version").isNull(), 0).when(F.col("c.new"), F.col("t.version") + 1).otherwise(F.col("t.version")).cast("long")
    pick = lambda c: F.when(F.col("c.new"), F.col(f"c.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return joined.select(*KEY, *(pick(c) for c in VALUES), version.alias("version"))


def rollup_targets(symbols: DataFrame, interval: str, start_ms: int, end_ms: int) -> DataFrame:
    """(symbol, interval, start_s) of each bucket from the one that holds the start, whose end is not after the end."""
    d = INTERVALS[interval]
    first = start_ms // 1000 // d * d
    last = end_ms // 1000 - d
    starts = F.sequence(F.lit(first), F.lit(last), F.lit(d)) if last >= first else F.array().cast("array<bigint>")
    return symbols.select("symbol", F.lit(interval).alias("interval"), F.explode(starts.cast("array<bigint>")).alias("start_s"))


def reconciliation_window(as_of_ms: int, minutes: int = 120) -> tuple[int, int]:
    """[start_s, end_s) of a run: it ends one minute before the current one."""
    end = as_of_ms // 60_000 * 60 - 60
    return end - 60 * minutes, end


def reconciliation_run(stored: DataFrame, feed: DataFrame, as_of_ms: int, minutes: int = 120) -> tuple[DataFrame, DataFrame]:
    """(changes, audit) of a whole run over all symbols: 1-minute candles, then 5 and 30 minutes from the corrected ones."""
    start, end = reconciliation_window(as_of_ms, minutes)
    own = stored.where("interval = '1m'")
    changes, audit = reconcile(own, in_range(feed, start, end))
    corrected = own.join(changes, list(KEY), "left_anti").select(*KEY, *VALUES).unionByName(changes)
    out = changes
    for interval in ("5m", "30m"):
        first = start // INTERVALS[interval] * INTERVALS[interval]
        whole = in_range(rollup(corrected.where(F.col("start_s") >= first).withColumn("trades", F.lit(0)), interval), first, end - INTERVALS[interval] + 1)
        out = out.unionByName(changed_only(whole, stored.where(F.col("interval") == interval)))
    return out, audit

