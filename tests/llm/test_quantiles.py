import datetime as dt
import random

import numpy as np
import pytest

from tessera.llm.quantiles import day_runs, select

PS = [0.0, 0.05, 0.5, 0.95, 1.0]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, h int, id string, v double, at timestamp, n string").repartition(5)


def percentiles(df, **kw):
    runs = day_runs(df, ["g", "h"], "v", "id", "at", **{k: v for k, v in kw.items() if k in ("error", "run_values")})
    rows = select(runs, ["g", "h"], PS, **{k: v for k, v in kw.items() if k == "block"}).collect()
    return {(r["g"], r["h"], r["p"]): r for r in rows}


def test_exact_like_numpy(spark):
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        g = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        v = rng.choice([rng.gauss(0, 1), rng.choice([1.0, 2.0]), 10 ** rng.uniform(-300, 300), -rng.random() * 1e9])
        rows.append((g, rng.choice([1, None]), f"r{k}", v, dt.datetime(2025, 1, 1 + k % 20, 12), "x"))
    rows += rows[:200]
    rows += [("a", 1, f"bad{k}", v, dt.datetime(2025, 1, 1), "x") for k, v in enumerate([None, float("nan"), float("inf"), float("-inf")])]
    got = percentiles(table(spark, rows), block=64, run_values=50)
    once = {r[2]: r for r in rows}
    groups = {}
    for g, h, _, v, *_ in once.values():
        if v is not None and np.isfinite(v):
            groups.setdefault((g, h), []).append(v)
    assert len(got) == len(groups) * len(PS)
    for (g, h), vs in groups.items():
        for p in PS:
            r = got[g, h, p]
            assert r["n"] == len(vs) and r["rank_error"] == 0
            assert r["value"] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_bound_of_thinned_runs(spark):
    rng = random.Random(6)
    rows = [("a", 1, f"r{k}", rng.expovariate(1.0), dt.datetime(2025, 1, 1 + k % 4), "x") for k in range(8000)]
    vs = np.sort([r[3] for r in rows])
    for r in percentiles(table(spark, rows), error=0.01, run_values=1500).values():
        assert 0 < r["rank_error"] <= 0.02 * len(vs)
        at = r["p"] * (len(vs) - 1)
        low, high = np.searchsorted(vs, r["value"], "left"), np.searchsorted(vs, r["value"], "right")
        assert low - r["rank_error"] - 1 <= at <= high + r["rank_error"] + 1


def test_single_value_ties_null_day_and_empty(spark):
    rows = [("a", 1, "x", 3.0, None, "x"), ("b", 1, "y", 2.0, dt.datetime(2025, 1, 1), None), ("b", 1, "z", 2.0, dt.datetime(2025, 1, 2), None), ("b", 1, None, 9.0, None, None)]
    df = table(spark, rows)
    got = percentiles(df)
    assert {(k[0], k[2]): r["value"] for k, r in got.items()} == {**{("a", p): 3.0 for p in PS}, **{("b", p): 2.0 for p in PS}}
    assert percentiles(df.limit(0)) == {}


def test_days_combine_in_any_order(spark):
    rng = random.Random(7)
    rows = [("a", 1, f"r{k}", rng.random(), dt.datetime(2025, 1, 1 + k % 9), "x") for k in range(900)]
    runs = day_runs(table(spark, rows), ["g", "h"], "v", "id", "at")
    first, rest = runs.where("day < '2025-01-04'"), runs.where("day >= '2025-01-04'")
    whole = {r["p"]: r["value"] for r in select(runs, ["g", "h"], PS).collect()}
    assert {r["p"]: r["value"] for r in select(rest.union(first), ["g", "h"], PS).collect()} == whole
