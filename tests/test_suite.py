"""Every registered query against its SQL, on the smallest driver tables."""

import pytest

import suite
from suite.check import compare, oracle_connection


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, sf_dir, connection, name):
    problem = compare(spark, connection, sf_dir, name)
    assert problem is None, problem  # an empty expected result proves nothing and fails too


def test_registry_is_paired():
    assert set(suite.ORACLES) == set(suite.QUERIES)
