"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import checker

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return checker.connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
    else:
        assert checker.difference(con, df, sql) in (None, "EMPTY")


# operators that rank or add up in order, each through many small cells as on large tables
RANKED = ("b24", "d5_", "d18", "d26", "d39", "d40", "d41", "e1_", "e2_", "e3_", "e4_", "e5_", "e6_", "e8_", "e9_", "e11", "e13", "e14",
          "e15", "e16", "e17", "e19", "e22", "i10", "i11")


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith(RANKED) and n in entry.oracle_sql()))
def test_query_in_small_cells(spark, con, small_cells, name):
    assert checker.difference(con, entry.queries()[name](spark, SF), entry.oracle_sql()[name]) in (None, "EMPTY")
