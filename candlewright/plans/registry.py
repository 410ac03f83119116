"""Registered queries of the candle engine and the SQL they are checked against."""

from . import batch, stored, streams

QUERIES: dict = batch.QUERIES | streams.QUERIES | stored.QUERIES
SQL: dict = batch.SQL | streams.SQL | stored.SQL
