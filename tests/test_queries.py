"""Every query of the library against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__
from tessella.plans import registry

from .oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert difference(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
