"""Every registered query against its SQL text in DuckDB."""

import pytest
from oracle import compare, database

from tickloom.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in registry.SQL:
        assert compare(spark, con, sf_dir, name, registry.QUERIES[name], registry.SQL[name]) > 0
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
