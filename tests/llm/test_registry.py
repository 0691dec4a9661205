import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm import registry

SF = "/root/testdata/sf0.001"
NATIVE = ("op1_pii", "op2_mix_sources", "op5_exact_dedup", "op7_license_scan")


def test_one_query_each():
    names = list(registry.QUERIES)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert {*names, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, found: sorted(str([r[names.index(c)] for c in columns]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
