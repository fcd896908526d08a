"""Every registered query with comparison SQL, on the smallest tables."""

import pytest
from oracle_compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    assert compare(name, got, con.sql(SQL[name]).to_arrow_table()) is None


def test_entry_has_stable_columns(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["split", "n", "coverage"] and df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())
