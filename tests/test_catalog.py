"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from longitrack.plans import catalog

D = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
