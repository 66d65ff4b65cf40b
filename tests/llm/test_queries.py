"""The registered queries that have SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest

from corpuskiln.llm import queries

from ..test_oracles import rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got = queries.queries()[name](spark, DATA)
    ran = sql.execute(queries.oracle_sql()[name])
    want = rows([d[0] for d in ran.description], ran.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
