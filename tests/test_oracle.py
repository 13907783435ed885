"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from clickloom.plans.queries import QUERIES
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_no_sql_without_a_query():
    assert oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, QUERIES[name], oracle_sql().get(name), SF_DIR)
    assert verdict == "" or verdict.startswith("(")
