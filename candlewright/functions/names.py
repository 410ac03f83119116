"""Names: of symbols, and of columns that no table has yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_symbol(symbol: Column) -> Column:
    """The key of a symbol: lower case; null stays null."""
    return F.lower(symbol)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
