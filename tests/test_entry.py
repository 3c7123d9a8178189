"""The driver contract: names, schemas and parity of a few queries with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from curatrix.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.queries()) > 70


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_parity(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = want.fetchall()
    at = [want.columns.index(c) for c in cols]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(key([r[c] for c in cols]) for r in df.collect()) == sorted(key([r[i] for i in at]) for r in rows)
