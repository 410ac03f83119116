"""Ordered values over one key without one task for it: within chunks of the order, then over a row for each chunk.

A chunk is a bigint that never falls as the order rises. What a chunk passes on (its last row, its last known value,
its number of marks) is summed up before the shuffle, so a window over whole keys sees a row for each chunk only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.names import fresh

#: Values of a bigint order in one chunk.
CHUNK = 1_000_000


def chunk_of(order: str, chunk: int = CHUNK) -> Column:
    """The chunk of a bigint order."""
    return F.expr(f"`{order}` div {chunk}")


def _scan(df: DataFrame, key: tuple[str, ...], chunk: Column, order: str, to: str, value: Column, inside, passed, carried) -> DataFrame:
    """``df`` with ``to``: ``inside`` over ``value`` of the rows of a chunk, with what the chunks before pass on put first.

    ``passed`` sums up a chunk, ``carried`` the chunks before one. The row put first needs no join and goes again.
    """
    c, x, real = fresh(df, "_chunk", "_x", "_real")
    chunked = df.withColumn(c, chunk).withColumn(x, value)
    ends = chunked.groupBy(*key, c).agg(passed(x).alias(x))
    over = Window.partitionBy(*key).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    first = ends.select(*key, c, carried(x).over(over).alias(x), F.lit(False).alias(real)).where(F.col(x).isNotNull())
    both = chunked.withColumn(real, F.lit(True)).unionByName(first, allowMissingColumns=True)
    within = Window.partitionBy(*key, c).orderBy(real, order)
    return both.withColumn(to, inside(x, within)).where(real).select(*df.columns, to)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_max(df: DataFrame, key: tuple[str, ...], value: str, order: str, to: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the maximum of ``value`` over rows of the key up to this one, by ``order`` (a bigint)."""
    return _scan(df, key, chunk_of(order, chunk), order, to, F.col(value), lambda x, w: F.max(x).over(_upto(w)), F.max, F.max)


def running_count(df: DataFrame, key: tuple[str, ...], marked: Column, order: str, to: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the number of rows of the key where ``marked`` is true, up to and with this one."""
    one = F.when(marked, 1).otherwise(0).cast("long")
    return _scan(df, key, chunk_of(order, chunk), order, to, one, lambda x, w: F.sum(x).over(_upto(w)), F.sum, F.sum)


def _last(x: str) -> Column:
    return F.last(x, ignorenulls=True)


def row_before(df: DataFrame, key: tuple[str, ...], value: Column, order: str, to: str, chunk: Column) -> DataFrame:
    """``df`` with ``value`` of the row before in the key, in a struct: null where there is none."""
    return _scan(df, key, chunk, order, to, F.struct(value.alias("v")), lambda x, w: F.lag(x).over(w), lambda x: F.max_by(x, order), _last)


def last_known(df: DataFrame, key: tuple[str, ...], value: str, order: str, to: str, chunk: Column) -> DataFrame:
    """``df`` with the last ``value`` of the key that is not null, up to and with this row."""
    passed = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order)))
    return _scan(df, key, chunk, order, to, F.col(value), lambda x, w: _last(x).over(_upto(w)), passed, _last)
