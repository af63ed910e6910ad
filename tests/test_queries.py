"""Every registered query against its SQL on the smallest tables."""

import pytest

from parlance.plans import registry

from .compare import connection, rows
from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    want = con.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
