"""Trade ticks from JSON messages, from binary frames and from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions.names import fresh, normalize_symbol
from candlewright.functions.time import ntz_to_millis


#: What a tick read from a message has; columns of these names are replaced.
FIELDS = ("symbol", "price", "quantity", "event_ms")


def read_trade_json(df: DataFrame, body: str = "value") -> DataFrame:
    """Ticks (symbol, price, quantity, event_ms) of trade messages {"data": {"s", "p", "q", "E"}}.

    Symbols become lower case. A row goes where the text is not such an object, symbol, price or quantity is
    missing or no number, or the time is missing or 0. Other columns of ``df`` are carried.
    """
    (m,) = fresh(df, "_message")
    parsed = F.from_json(F.col(body), "data struct<s:string,p:string,q:string,E:bigint>")["data"]
    number = lambda name: F.col(m)[name].try_cast("decimal(38,18)")
    rest = [c for c in df.columns if c not in (body, *FIELDS)]
    out = df.withColumn(m, parsed).select(
        *rest, normalize_symbol(F.col(m)["s"]).alias("symbol"), number("p").alias("price"), number("q").alias("quantity"), F.col(m)["E"].alias("event_ms")
    )
    return out.where("symbol is not null and price is not null and quantity is not null and coalesce(event_ms, 0) <> 0")


#: Frame, big-endian: version 1, symbol length 1, symbol, price 8 unscaled + 4 scale, quantity the same, time 8.
VERSION = 1


def _signed(data: Column, at: Column, width: int) -> Column:
    """Signed big-endian integer of ``width`` bytes at the 1-based place ``at``."""
    digits = F.hex(F.substring(data, at, F.lit(width)))
    return F.conv(F.when(F.substring(digits, 1, 1) >= "8", F.lpad(digits, 16, "F")).otherwise(digits), 16, -10).cast("bigint")


def _once(df: DataFrame, fields: Column) -> DataFrame:
    """``df`` with the fields of a struct as columns, computed once a row: filters on a generator's columns are not computed before it."""
    return df.select("*", F.inline(F.array(fields)))


def decode_tick_frames(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(ticks, rejected): frames of the known version and of their full length, and all other rows.

    Ticks have symbol, price and quantity as decimal(38,18), and event_ms; other columns are carried. A null
    payload, another version, a wrong length, or a number that decimal(38,18) cannot hold is rejected.
    """
    data = F.col(payload)
    n, price, quantity, symbol, event_ms = fresh(df, "_n", "_price", "_quantity", "_symbol", "_event_ms")
    named = df.withColumn(n, F.conv(F.hex(F.substring(data, F.lit(2), F.lit(1))), 16, 10).cast("int"))
    version = F.conv(F.hex(F.substring(data, F.lit(1), F.lit(1))), 16, 10).cast("int")
    whole = data.isNotNull() & (version == VERSION) & (F.octet_length(data) == F.col(n) + 34)
    read = lambda offset, width: _signed(data, F.col(n) + F.lit(3 + offset), width)
    number = lambda offset: F.concat(read(offset, 8).cast("string"), F.lit("E"), (-read(offset + 8, 4)).cast("string")).try_cast("decimal(38,18)")
    text = F.decode(F.substring(data, F.lit(3), F.col(n)), "UTF-8")
    fields = F.struct(*(F.when(whole, x).alias(name) for name, x in ((price, number(0)), (quantity, number(12)), (symbol, text), (event_ms, read(24, 8)))))
    checked = _once(named, fields)
    good = F.col(price).isNotNull() & F.col(quantity).isNotNull()
    rest = [c for c in df.columns if c not in (payload, *FIELDS)]
    ticks = checked.where(good).select(
        *rest, F.col(symbol).alias("symbol"), F.col(price).alias("price"), F.col(quantity).alias("quantity"), F.col(event_ms).alias("event_ms")
    )
    return ticks, checked.where(~F.coalesce(good, F.lit(False))).select(*df.columns)


def _frame() -> Column:
    """The frame of a tick, or null where it cannot be encoded; no row raises an error."""

    def number(name: str) -> Column:
        plain = F.rtrim(F.rtrim(F.col(name).try_cast("decimal(38,18)").cast("string"), F.lit("0")), F.lit("."))

        def packed(text: Column) -> Column:
            scale = F.when(text.contains("."), F.length(text) - F.instr(text, ".")).otherwise(0)
            unscaled = F.replace(text, F.lit("."), F.lit("")).try_cast("decimal(38,0)").try_cast("bigint")
            return F.concat(F.lpad(F.hex(unscaled), 16, "0"), F.lpad(F.hex(scale.cast("bigint")), 8, "0"))

        return F.element_at(F.transform(F.array(plain), packed), 1)

    symbol = F.hex(F.encode("symbol", "UTF-8"))
    size = F.octet_length("symbol")
    text = F.concat(F.lit("01"), F.lpad(F.hex(size.cast("bigint")), 2, "0"), symbol, number("price"), number("quantity"), F.lpad(F.hex("event_ms"), 16, "0"))
    return F.when(valid_tick() & (size <= 255), F.unhex(text))


def encode_tick_frames(df: DataFrame, to: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(frames, rejected) of ``df`` (symbol, price, quantity, event_ms): rows with their binary frame in ``to``, and all others.

    Trailing zeros of numbers are dropped. A symbol that is null, blank or over 255 bytes, a price of 0 or less, a
    negative quantity, a time of 0 or less, or a number of over 64 bits unscaled is rejected.
    """
    framed = _once(df.drop(to), F.struct(_frame().alias(to)))
    return framed.where(F.col(to).isNotNull()), framed.where(F.col(to).isNull()).select(*df.columns)


def encode_all_tick_frames(df: DataFrame, to: str = "payload") -> DataFrame:
    """As encode_tick_frames, where a row that cannot be encoded is an error; looks for one first, in a job of its own."""
    frames, rejected = encode_tick_frames(df, to)
    if not rejected.isEmpty():
        raise ValueError("tick cannot be encoded")
    return frames


def valid_tick() -> Column:
    """Whether symbol is not blank, price over 0, quantity at least 0 and event_ms over 0; nulls are not valid."""
    return F.coalesce(F.col("symbol").rlike(r"\S") & (F.col("price") > 0) & (F.col("quantity") >= 0) & (F.col("event_ms") > 0), F.lit(False))


def validate_ticks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) ticks."""
    return df.where(valid_tick()), df.where(~valid_tick())


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks."""
    return as_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_ticks(events: DataFrame) -> DataFrame:
    """Events, or a stream of them, as ticks: time 60 times as fast, every seventh event up to three minutes late."""
    ticks = events.selectExpr(
        "event_id as seq",
        "event_type as symbol",
        "cast(value as decimal(18,6)) as price",
        "cast(cast(cast(get_json_object(props, '$.k') as bigint) as decimal(18,8)) * cast(0.01 as decimal(3,2)) as decimal(18,8)) as quantity",
        "ts",
        "user_id",
    )
    ticks = ticks.withColumn("arrival_ms", F.floor((ntz_to_millis(F.col("ts")) - 1704067200000) / F.lit(60).cast("decimal(2,0)")).cast("long") + 1704067200000).drop("ts")
    return ticks.withColumn("event_ms", F.expr("arrival_ms - case when seq % 7 = 3 then (seq % 5) * 45000 else 0 end"))
