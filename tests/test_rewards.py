import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import rewards as rw


def draws(spark, rows):
    return spark.createDataFrame(rows, "pair string, side string, i int, reward double")


def test_clipped_surrogate(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, -1.0), (0.1, -1.0), (0.1, 1.0)], "r double, a double")
    assert [round(r[0], 9) for r in df.select(rw.clipped(F.col("r"), F.col("a"))).collect()] == [1.2, -2.0, -0.8, 0.1]


@settings(max_examples=100, deadline=None)
@given(st.floats(-1, 1), st.floats(-1, 1), st.floats(0, 1))
def test_utility_identity(a, b, eta):
    assert (1 - eta) * (a + b) / 2 + eta * min(a, b) == pytest.approx((a + b) / 2 - eta * abs(a - b) / 2, abs=1e-12)


def test_no_pull_equals_leave_one_out(spark):
    rng = random.Random(0)
    rows = [("p", s, i, rng.uniform(-1, 1)) for s in "ab" for i in range(4)]
    paired = {(r["side"], r["i"]): r["advantage"] for r in rw.paired_advantages(draws(spark, rows), 0.0).collect()}
    plain = {(r["side"], r["i"]): r["advantage"] for r in rw.leave_one_out(draws(spark, rows), ["pair", "side"], "reward").collect()}
    assert paired == pytest.approx(plain)


def test_binary_rewards_slope(spark):
    strong = [("p", "a", i, float(i < 3)) for i in range(4)] + [("p", "b", i, float(i < 1)) for i in range(4)]
    got = {(r["side"], r["i"]): r["advantage"] for r in rw.paired_advantages(draws(spark, strong), 0.5).collect()}
    loo = {(r["side"], r["i"]): r["advantage"] for r in rw.leave_one_out(draws(spark, strong), ["pair", "side"], "reward").collect()}
    assert {k: got[k] / loo[k] for k in got} == pytest.approx({("a", i): 0.75 for i in range(4)} | {("b", i): 1.25 for i in range(4)})


def test_flat_groups_give_nothing(spark):
    rows = [("p", s, i, 0.5) for s in "ab" for i in range(3)]
    assert all(r["advantage"] == pytest.approx(0) for r in rw.paired_advantages(draws(spark, rows), 0.5).collect())
    assert all(r["advantage"] == pytest.approx(0) for r in rw.standardised(draws(spark, rows), ["pair", "side"], "reward").collect())
    assert rw.flat_groups(draws(spark, rows), ["pair", "side"], "reward").first().asDict() == {"flat_groups": 2, "groups": 2}


def test_joint_utility_and_sides_swapped(spark):
    rows = [("p", "a", 0, 1.0), ("p", "a", 1, 0.0), ("p", "b", 0, 0.0), ("p", "b", 1, -1.0)]
    swapped = [(p, "b" if s == "a" else "a", i, r) for p, s, i, r in rows]
    one, two = (rw.joint_utility(draws(spark, x), 0.3).first().asDict() for x in (rows, swapped))
    assert one == pytest.approx(two) and one["operations"] == 4 and one["draws"] == 4


def test_token_loss(spark):
    df = spark.createDataFrame([(-1.0, -1.2, -0.9)], "n double, o double, r double")
    got = df.select(rw.token_loss(F.col("n"), F.col("o"), F.col("r"), F.lit(1.0))).first()[0]
    d = 0.1
    assert got == pytest.approx(-min(math.exp(0.2), 1.2) + 0.04 * (math.expm1(d) - d))


def test_queries_over_all_draws_like_brute_force(spark, sf):
    import statistics
    from collections import defaultdict

    import pyarrow.parquet as pq

    from tessera.plans import measures

    groups = defaultdict(list)
    for e in sorted(pq.read_table(f"{sf}/events.parquet").to_pylist(), key=lambda e: e["event_id"]):
        groups[e["user_id"], e["event_id"] % 2].append(max(-1.0, min(1.0, (e["value"] - 50) / 50)))
    assert max(map(len, groups.values())) > 4
    mean = lambda x: sum(x) / len(x)
    utility = lambda a, b, eta: (1 - eta) * (a + b) / 2 + eta * min(a, b)
    q = lambda eta: {(p, s, i): mean([utility(x, y, eta) for y in groups[p, 1 - s]]) for (p, s), g in list(groups.items()) if (p, 1 - s) in groups for i, x in enumerate(g, 1)}
    others = lambda values, k: values[k] - (sum(values) - values[k]) / (len(values) - 1) if len(values) > 1 else None
    at = lambda query, column: {(r["pair"], r["side"], r["i"]): r[column] for r in query(spark, sf).collect()}

    assert at(measures.utilities, "q") == pytest.approx(q(0.25), abs=1e-8)
    half = q(0.5)
    per = {(p, s): [half[p, s, i] for i in range(1, len(g) + 1)] for (p, s), g in groups.items() if (p, s, 1) in half}
    assert at(measures.paired_rewards, "advantage") == pytest.approx({(p, s, i + 1): (x := others(g, i)) and 2 * x for (p, s), g in per.items() for i in range(len(g))}, abs=1e-8)
    both = {p: [utility(x, y, 0.5) for x in groups[p, 0] for y in groups[p, 1]] for p, s in list(groups) if s == 0 and (p, 1) in groups}
    assert {r["pair"]: (r["joint_utility"], r["operations"], r["draws"]) for r in measures.joint_rewards(spark, sf).collect()} == {p: (pytest.approx(mean(u), abs=1e-8), len(u), len(groups[p, 0]) + len(groups[p, 1])) for p, u in both.items()}
    assert at(measures.loo_rewards, "advantage") == pytest.approx({(p, s, i + 1): others(g, i) for (p, s), g in groups.items() for i in range(len(g))}, abs=2e-6)
    assert at(measures.group_rewards, "advantage") == pytest.approx({(p, s, i + 1): (x - mean(g)) / (statistics.pstdev(g) + 1e-8) for (p, s), g in groups.items() for i, x in enumerate(g)}, abs=2e-6)
    assert measures.flat(spark, sf).first().asDict() == {"flat_groups": sum(min(g) == max(g) for g in groups.values()), "groups": len(groups)}


@pytest.mark.parametrize("stretch", [7, 30, 1000])
def test_trailing_mean_across_stretches(spark, stretch):
    rng = random.Random(4)
    rows = [(arm, k, rng.choice((None, rng.random()))) for arm in "abc" for k in range(rng.randrange(5, 120))]
    df = spark.createDataFrame(rows, "arm string, k int, v double").repartition(5)
    got = {(r["arm"], r["k"]): r["trailing_mean"] for r in rw.trailing_mean(df, ["arm"], ["k"], "v", 5, stretch=stretch).collect()}
    want = {}
    for arm in "abc":
        series = [v for a, _, v in rows if a == arm]
        for k in range(len(series)):
            last = [v for v in series[max(0, k - 4) : k + 1] if v is not None]
            want[arm, k] = sum(last) / len(last) if last else None
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})
