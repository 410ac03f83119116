"""Every registered query of the candle engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from candlewright.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, db):
    got = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["fan_out", "stream_fan_out"])
def test_fan_out_meets_every_event(name, spark, db):
    """By brute force: the subscribers of each tick's symbol, whatever its seq."""
    events = [r.seq for r in QUERIES["validate_ticks"](spark, SF).collect() if r.valid or name == "fan_out"]
    follows = QUERIES["active_subscriptions"](spark, SF).collect()
    want = sorted((s, f.symbol, f.session_id) for s in events for f in follows if f.symbol == f"s{s % 5}")
    assert sorted((r.seq, r.symbol, r.session_id) for r in QUERIES[name](spark, SF).collect()) == want


def test_no_query_is_empty(spark, db):
    """At sf0.01 every query's SQL has rows, so that agreement says something."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF.replace('0.001', '0.01')}/{t}.parquet'")
    empty = [n for n in sorted(SQL) if not con.sql(f"select 1 from ({SQL[n]}) limit 1").fetchall()]
    assert not empty


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
