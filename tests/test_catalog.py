"""Every query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from isobar.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(values, names, order):
    return sorted(repr(tuple(float(f"{r[names.index(c)]:.10g}") if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in order)) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, DIR)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert rows([tuple(r) for r in got.collect()], got.columns, order) == rows(want.fetchall(), want.columns, order)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0
