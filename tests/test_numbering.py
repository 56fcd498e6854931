import random

from tessera.functions.numbering import numbered


def test_places_are_those_of_a_sort(spark):
    values = random.Random(3).sample(range(10_000), 700)
    got = {r["v"]: r["place"] for r in numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(6), "v").collect()}
    assert got == {v: k for k, v in enumerate(sorted(values))}
    assert numbered(spark.createDataFrame([], "v int"), "v").count() == 0
