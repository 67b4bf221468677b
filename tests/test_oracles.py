"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["v", "h", "year", "n_pos", "N", "r_pos"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    diff = compare.differences(con, QUERIES[name](spark, SF), SQL[name])
    assert diff in (None, "EMPTY"), diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
