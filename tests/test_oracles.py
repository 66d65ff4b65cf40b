"""Every registered query that has SQL against that SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpuskiln.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted([tuple(plain(r[i]) for i in order) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    ran = sql.execute(ORACLES[name])
    want = rows([d[0] for d in ran.description], ran.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_size_histogram_at_the_bounds(spark, tmp_path):
    # 50 times the price is half a byte off a bound, on either side of it: a half goes to the even number, as in SQL.
    prices = [(b + half) / 50 for b in (1024 << i for i in range(15)) for half in (-1.5, -0.5, 0.0, 0.5, 1.0, 1.5)] + [None]
    orders = spark.createDataFrame([(k, price) for price in prices for k in range(5)], "o_orderkey long, o_totalprice double")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["size_histogram"](spark, str(tmp_path))
    ran = con.execute(ORACLES["size_histogram"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in ran.description], ran.fetchall())


def test_error_rings_stream_with_nulls(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT event_id, ts, CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type, value, props
      FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["error_rings_stream"](spark, str(tmp_path))
    ran = con.execute(ORACLES["error_rings_stream"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in ran.description], ran.fetchall())
