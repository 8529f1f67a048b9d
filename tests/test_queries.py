"""Every registered query against its expected result in SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from stmtwatch.plans import catalog, oracles

QUERIES, ORACLES = catalog.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert oracle.difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
