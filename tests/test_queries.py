"""Every registered query of the engine against the other engine, or for rows where it has no twin."""

import pytest
from compare import same

from corvella.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_oracle(spark, duck, data, name):
    same(catalog.QUERIES[name](spark, data), duck.execute(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, data, name):
    frame = catalog.QUERIES[name](spark, data)
    assert frame.columns
    frame.limit(5).collect()


def test_entry(spark, data):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, data).count() == 1
