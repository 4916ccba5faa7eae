"""Every registered query against its SQL twin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_point  # noqa: E402
from tools.check_sql import compare, connect  # noqa: E402

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
