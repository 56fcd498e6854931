import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.groups import Forest, assign_splits, key, related_groups, share_out


def brute(rows):
    forest = Forest()
    for i, keys in rows:
        forest.join(f"r{i}", f"r{i}")
        for k in keys or []:
            if k is not None:
                forest.join(f"r{i}", f"z{k}")
    out = {}
    for i, _ in rows:
        out.setdefault(forest.root(f"r{i}"), set()).add(i)
    return {min(m): m for m in out.values()}


def classes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group"], set()).add(r["id"])
    return out


@pytest.mark.parametrize("forest_edges", [3, 10, 100_000])
def test_groups_like_brute_force(spark, forest_edges):
    rng = random.Random(4)
    rows = [(f"i{n:04d}", [f"k{rng.randrange(420)}" for _ in range(rng.randrange(3))] or None) for n in range(400)]
    rows += [(f"h{n:04d}", ["hot"]) for n in range(200)] + [("x", [None]), ("y", [])] + rows[:20]
    df = spark.createDataFrame(rows, "id string, keys array<string>").repartition(6)
    assert classes(related_groups(df, "id", F.col("keys"), forest_edges)) == brute(rows)


def test_a_long_chain(spark):
    rows = [(f"i{n:03d}", [f"k{n}", f"k{n + 1}"]) for n in range(120)]
    df = spark.createDataFrame(rows, "id string, keys array<string>").repartition(8)
    assert list(classes(related_groups(df, "id", F.col("keys"), 5))) == ["i000"]


def test_empty_null_and_clashing_names(spark):
    df = spark.createDataFrame([(None, ["a"], "g"), ("b", None, "g")], "id string, keys array<string>, root string")
    assert classes(related_groups(df, "id", F.col("keys"))) == {"b": {"b"}}
    assert related_groups(df.limit(0), "id", F.col("keys")).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([(" A\t",), ("a",), ("  ",), (None,)], "v string")
    assert [r[0] for r in df.select(key("p:", F.col("v"), fold=True)).collect()] == ["p:a", "p:a", None, None]


def one_by_one(sizes, shares):
    total = sum(s * c for s, c in sizes)
    lack = [total * x for x in shares.values()]
    out = {}
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(lack)
        for _ in range(count):
            k = max(range(len(lack)), key=lambda j: (lack[j], -j))
            got[k] += 1
            lack[k] -= size
        out[size] = got
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 300), min_size=1, max_size=12))
def test_share_out_like_one_by_one(counts):
    shares = {"train": 0.75, "dev": 0.125, "test": 0.125}
    assert share_out(list(counts.items()), shares) == one_by_one(list(counts.items()), shares)


def test_splits_keep_groups_and_shares(spark):
    rows = [(f"i{n}", f"g{n % 37 if n < 300 else n}") for n in range(1000)]
    out = assign_splits(spark.createDataFrame(rows, "id string, group string"), {"train": 0.8, "dev": 0.1, "test": 0.1}).collect()
    assert len(out) == 1000
    per = {}
    for r in out:
        per.setdefault(r["group"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    n = {s: sum(r["split"] == s for r in out) for s in ("train", "dev", "test")}
    assert n == {"train": 800, "dev": 100, "test": 100}
    assert assign_splits(spark.createDataFrame([], "id string, group string"), {"a": 1.0}).count() == 0
