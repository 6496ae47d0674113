import os

import pytest

import __spark_entry__ as contract
import oracle
from inkwell.catalog.registry import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_sql(spark, database, name):
    function, sql = contract.queries()[name], contract.oracle_sql().get(name)
    assert oracle.compare(spark, database, name, function, sql, SF_DIR) is None


#: An iterated fit, which SQL cannot express; tests/test_lsa.py holds it against numpy.
FITTED = {"learned_neighbours"}


def test_every_query_has_sql():
    assert set(QUERIES) - FITTED == set(SQL)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 4
