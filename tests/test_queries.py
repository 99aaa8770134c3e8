import pytest

from cargolens.plans import registry

from .oracle import DATA, same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    same(registry.QUERIES[name](spark, DATA), registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
