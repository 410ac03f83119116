"""Exchange klines, symbols and stored candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.names import fresh, normalize_symbol

FIELDS = (
    ("open_ms", "bigint"), ("open", "decimal(38,18)"), ("high", "decimal(38,18)"), ("low", "decimal(38,18)"), ("close", "decimal(38,18)"),
    ("volume", "decimal(38,18)"), ("close_ms", "bigint"), ("quote_volume", "decimal(38,18)"), ("trades", "int"),
    ("taker_buy_base", "decimal(38,18)"), ("taker_buy_quote", "decimal(38,18)"),
)


def read_exchange_klines(df: DataFrame, body: str = "value") -> DataFrame:
    """A row for each inner array of JSON arrays of arrays; fewer than 11 elements are an error. Other columns are carried."""
    rest = [c for c in df.columns if c != body]
    (k,) = fresh(df, "_k")
    rows = df.select(*rest, F.explode(F.from_json(body, "array<array<string>>")).alias(k))
    checked = F.when(F.size(k) >= len(FIELDS), F.col(k)).otherwise(F.raise_error(F.lit("kline has fewer than 11 elements")).cast("array<string>"))
    return rows.withColumn(k, checked).select(*rest, *(F.col(k)[i].cast(kind).alias(name) for i, (name, kind) in enumerate(FIELDS)))


def kline_range(klines: DataFrame, start_ms: int, end_ms: int, symbol: str | None = None) -> DataFrame:
    """Klines whose open_ms lies in [start_ms, end_ms], both ends included."""
    out = klines.where(F.col("open_ms").between(start_ms, end_ms))
    return out if symbol is None else out.where(F.col("symbol") == symbol)


def symbols(ticks: DataFrame) -> DataFrame:
    """A symbol dimension (id, symbol) from the symbols that occur, numbered from 1 by name.

    A dimension has a row for each instrument, so one task numbers it.
    """
    from pyspark.sql import Window

    names = ticks.select(normalize_symbol(F.col("symbol")).alias("symbol")).where("symbol is not null").distinct()
    return names.select(F.row_number().over(Window.orderBy("symbol")).cast("long").alias("id"), "symbol")


def find_symbols(dimension: DataFrame, id: int | None = None, symbol: str | None = None) -> DataFrame:
    """Rows by id or by code, or all; a code or id that is absent gives no row."""
    out = dimension
    if id is not None:
        out = out.where(F.col("id") == id)
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    return out


def get_symbol(dimension: DataFrame, id: int | None = None, symbol: str | None = None) -> DataFrame:
    """The row of an id or code; an absent one is an error, found in a job of its own."""
    out = find_symbols(dimension, id, symbol)
    if out.isEmpty():
        raise LookupError(f"SYM-001 unknown symbol {symbol if id is None else id}")
    return out


def unknown_symbols(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows whose symbol is not in the dimension."""
    return df.join(dimension.select("symbol"), "symbol", "left_anti")


#: A dimension of more rows than this is joined by shuffling instead of being broadcast.
BROADCAST_SYMBOLS = 100_000


def with_symbol(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """``df`` with symbol_id; an unknown symbol is an error. A small dimension is broadcast, after counting it."""
    small = dimension.limit(BROADCAST_SYMBOLS + 1).count() <= BROADCAST_SYMBOLS
    side = dimension.select("symbol", F.col("id").alias("symbol_id"))
    joined = df.join(F.broadcast(side) if small else side, "symbol", "left")
    unknown = F.raise_error(F.concat(F.lit("SYM-001 unknown symbol "), F.coalesce("symbol", F.lit("null")))).cast("long")
    return joined.withColumn("symbol_id", F.coalesce("symbol_id", unknown))


def in_span(candles: DataFrame, interval: str, start_s: int, end_s: int) -> DataFrame:
    """Candles of an interval that start in [start_s, end_s). Of a table with a partition column day no other day is read."""
    out = candles.where((F.col("interval") == interval) & (F.col("start_s") >= start_s) & (F.col("start_s") < end_s))
    return out.where(F.col("day").between(start_s // 86400, (end_s - 1) // 86400)) if "day" in candles.columns else out


def scan_candles(candles: DataFrame, interval: str, start_s: int, end_s: int, symbol: str | None = None) -> DataFrame:
    """Candles of an interval that start in [start_s, end_s), ascending."""
    out = in_span(candles, interval, start_s, end_s)
    out = out if symbol is None else out.where(F.col("symbol") == symbol)
    return out.orderBy("symbol", "start_s")


def lookup_candle(candles: DataFrame, interval: str, symbol: str, start_s: int) -> DataFrame:
    """The candle of one bucket, if there is one."""
    return in_span(candles, interval, start_s, start_s + 1).where(F.col("symbol") == symbol)
