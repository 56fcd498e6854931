import pytest

from tessera.plans import registry
from tests.twins import connect, same

QUERIES, TWINS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, TWINS[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs_and_repeats(spark, sf, name):
    first = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    assert first == sorted(map(repr, QUERIES[name](spark, sf).collect()))


@pytest.mark.parametrize("partitions", ["1", "50"])
@pytest.mark.parametrize("name", ["a1_metric_guarded", "a11_overall_scores", "a28_coverage", "p6_found", "r3_paired_advantages", "j9_related"])
def test_partitions_change_nothing(spark, sf, con, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        if name in TWINS:
            same(QUERIES[name](spark, sf), con, TWINS[name])
        else:
            assert QUERIES[name](spark, sf).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
