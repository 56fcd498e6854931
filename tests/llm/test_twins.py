import pytest

from tessera.llm import registry
from tests.twins import connect, same

QUERIES, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, TWINS[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()
