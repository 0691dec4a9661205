"""Every query of the library against DuckDB on the same tables."""

import duckdb
import pytest

from tessera.plans import analytics, catalog, reading

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in found)


QUERIES, SQL = catalog.queries() | analytics.queries() | reading.queries(), catalog.oracle_sql() | analytics.oracle_sql() | reading.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
