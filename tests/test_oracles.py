import pytest

import __spark_entry__ as entry
from oracle import connect, rows
from quarrykit.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        assert len(got) > 0 and len(got.columns) > 0
        return
    want = duck.execute(registry.ORACLES[name]).fetchdf()
    assert len(want) > 0, "a query that compares nothing with nothing"
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
