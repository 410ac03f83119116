"""Fixed-point volumes, change in percent and null-safe extremes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000


def scale_volume(quantity: Column) -> Column:
    """Quantity, a decimal, times 10**8 as a bigint, digits beyond cut off; null, negative and too large values are errors.

    The error may be raised before an earlier filter has dropped the row, if a later filter looks at the result;
    where both are wanted, use try_scale_volume.
    """
    bad = quantity.isNull() | (quantity < 0)
    return F.when(bad, F.raise_error(F.lit("volume must not be null or negative")).cast("bigint")).otherwise(_units(quantity).cast("bigint"))


def try_scale_volume(quantity: Column) -> Column:
    """As scale_volume, but null where that is an error."""
    return F.when(quantity >= 0, _units(quantity).try_cast("bigint"))


def _units(quantity: Column) -> Column:
    """10**8 times the quantity, cut off first: a product of long decimals would be rounded."""
    return F.floor(quantity, F.lit(8)) * F.lit(SCALE).cast("decimal(10,0)")


def unscale_volume(volume: Column) -> Column:
    """Volume as decimal(28,8); multiplying avoids the scale rules of decimal division."""
    return (volume.cast("decimal(19,0)") * F.lit("0.00000001").cast("decimal(9,8)")).cast("decimal(28,8)")


def change_percent(open_: Column, current: Column) -> Column:
    """(current - open) * 100 / open, half up to 4 decimals; 0 where open is 0, null where either is."""
    wide = lambda c: c.cast("decimal(18,6)")
    ratio = (wide(current) - wide(open_)) * F.lit(100).cast("decimal(3,0)") / wide(open_)
    zero = F.lit(0).cast("decimal(18,4)")
    known = open_.isNotNull() & current.isNotNull()
    return F.when(known & (open_ == 0), zero).otherwise(F.when(known, F.round(ratio, 4).cast("decimal(18,4)")))


def null_safe_max(*columns: Column) -> Column:
    return F.greatest(*columns)


def null_safe_min(*columns: Column) -> Column:
    return F.least(*columns)


def candle_direction(open_: Column, close: Column) -> Column:
    """up where close is at least open, else down."""
    return F.when(close >= open_, "up").otherwise("down")
