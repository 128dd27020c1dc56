"""Every query with SQL gives the rows that the SQL gives; every other one runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkwell.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = shown(result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert shown(tuple(r) for r in df.select(*columns).collect()) == want


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(catalogue.QUERIES) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).columns == ["gram", "count", "log_likelihood"]
