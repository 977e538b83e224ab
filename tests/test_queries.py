"""Every registered query of the core against its DuckDB twin on the smallest tables; training-data queries have their own tests."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()
CORE = {n: q for n, q in entry.queries().items() if q.__module__.startswith("terrazzo.plans")}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in CORE if n in ORACLE])
def test_same_as_duckdb(spark, con, name):
    assert compare(spark, con, SF, CORE[name], ORACLE[name]) == []


@pytest.mark.parametrize("name", [n for n in CORE if n not in ORACLE])
def test_runs(spark, name):
    rows = CORE[name](spark, SF).collect()
    assert rows and len(set(rows[0].asDict())) == len(rows[0])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
