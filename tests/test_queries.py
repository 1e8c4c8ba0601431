"""Every registered query against its SQL on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    assert compare.difference(df, duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert entry_points.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
