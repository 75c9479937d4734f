"""Every registered query at the smallest scale, against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
import check_queries
from cellframe.retail.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return check_queries.connect(FOLDER)


contract.queries()  # registers them


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    state, rows, _, detail = check_queries.compare(spark, database, FOLDER, name)
    assert state == "ok", detail
    assert rows > 0


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["cellkey", "featurekey", "exprvalue"] and not frame.isEmpty()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())
