"""Every query with an SQL twin against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def tables(sf_dir_module):
    return connect(sf_dir_module)


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, tables, sf_dir_module, name):
    assert compare(spark, tables, sf_dir_module, name) == ""


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["zone", "avg_risk", "avg_congestion", "event_count"]
    assert result.count() == 5
