"""The driver contract: every query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks import oracles, registry
from checks.compare import duck, duck_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracles.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 157


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(entry.queries()[name](spark, SF_DIR)) == duck_rows(con, entry.oracle_sql()[name])
