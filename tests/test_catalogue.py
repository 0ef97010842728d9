"""Every catalogue query against its SQL check."""

import pytest

import __spark_entry__ as contract
from gaugelake.plans.queries import QUERIES
from oracle_check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(contract.queries()[name](spark, sf_dir), con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert len([c for c in df.columns if c.startswith("value_")]) == 27
