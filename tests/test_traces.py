import hashlib

from pyspark.sql import functions as F

from tessera.operators import metrics, traces as tr

SCHEMA = "trace string, k int, n int, task_id string, pair_id string, side string"


def steps(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", "a")[: 6] if len(r) == 3 else r for r in rows], SCHEMA)


def test_order_and_terminal(spark):
    got = {(r["trace"], r["k"]): (r["in_place"], r["terminal"]) for r in tr.step_order(steps(spark, [("a", 0, 1), ("a", 1, 1), ("b", 1, 1)]), "trace", "k").collect()}
    assert got == {("a", 0): (True, False), ("a", 1): (True, True), ("b", 1): (False, True)}


def test_chain_is_the_fold(spark):
    df = steps(spark, [("a", 1, 8), ("a", 0, 7)])
    got = tr.hash_chain(df, "trace", "k", F.to_json(F.struct("n")), F.col("trace")).first()
    h = hashlib.sha256(b"a").hexdigest()
    for n in (7, 8):
        h = hashlib.sha256(f'{{"previous":"{h}","step":{{"n":{n}}}}}'.encode()).hexdigest()
    assert (got["n"], got["chain"]) == (2, h)


def test_whole_traces_are_kept_or_not(spark):
    df = steps(spark, [("a", 0, 1), ("a", 1, 9), ("b", 0, 1)])
    assert {r["trace"] for r in tr.within_budget(df, "trace", 1).collect()} == {"b"}
    assert {r["trace"] for r in tr.without_overlong(df, "trace", F.col("n") > 5).collect()} == {"b"}


def test_coverage(spark):
    full = steps(spark, [("a", k, 1) for k in range(3)] + [("b", 0, 1), ("c", 0, 1)])
    kept = full.where("(trace = 'a' AND k <> 1) OR trace = 'b'")
    got = {r["trace"]: r for r in tr.coverage(kept, full, "trace", "k", ["task_id"]).collect()}
    assert (got["a"]["missing"], got["a"]["terminal_retained"], got["a"]["complete"]) == ([1], True, False)
    assert got["b"]["complete"] and got["c"]["retained"] == 0
    fewer = {r["trace"]: r["retained"] for r in tr.coverage(kept.where("k = 0"), full, "trace", "k", []).collect()}
    assert all(fewer[t] <= got[t]["retained"] for t in got)


def test_pairs_need_both_sides(spark):
    traces = spark.createDataFrame([("t1", True, True), ("t2", True, False)], "task_id string, terminal_retained boolean, complete boolean")
    tasks = spark.createDataFrame([("t1", "p", "a"), ("t2", "p", "b"), ("t1", "q", "a")], "task_id string, pair_id string, side string")
    got = {r["pair_id"]: (r["both_terminal"], r["both_complete"]) for r in tr.pair_coverage(traces, tasks).collect()}
    assert got == {"p": (True, False), "q": (False, False)}


def test_repairs_and_running(spark):
    df = steps(spark, [("a", 0, -1), ("a", 1, 5), ("b", 0, -1), ("c", 0, 5)])
    got = {r["trace"]: (r["opportunities"], r["repaired"]) for r in tr.repairs(df, "trace", "k", F.col("n") > 0, F.col("n")).collect()}
    assert got == {"a": (1, True), "b": (1, False), "c": (0, False)}
    run = {(r["trace"], r["k"]): (r["cost"], r["seen"]) for r in tr.running(df, "trace", "k", {"cost": F.col("n")}, {"seen": F.col("n") > 0}).collect()}
    assert run["a", 1] == (4, True) and run["a", 0] == (-1, False)


def test_masks_and_padding(spark):
    df = spark.createDataFrame([(1, [5, 6], [7]), (1, [5], [7, 2]), (1, [], [])], "b int, p array<int>, c array<int>")
    rows = tr.padded(df.select("b", tr.masked(F.col("p"), F.col("c"), 2).alias("x")).select("b", "x.*"), ["b"], "labels", -100).collect()
    assert sorted(r["labels"] for r in rows) == sorted([[-100, -100, 7, 2], [-100, 7, 2, -100], [2, -100, -100, -100]])


def test_metric_status_in_order(spark):
    schema = "g string, islet_id string, dish_id string, value double, unit string, method string, dataset_version string, pipeline_version string"
    ok = ("ok", "i1", "d1", 1.0, "u", "m", "1", "1")
    rows = [ok, ("ok", "i1", "d1", 3.0, "u", "m", "1", "1"), ("ok", "i2", " ", 10.0, "u", "m", "1", "1"), ("bad", "i1", "d", float("nan"), "u", "m", "1", "1"), ("bad2", " ", "d", 1.0, "u", "m", "1", "1"), ("mixed", "i", "d", float("nan"), "u", "m", "1", "1"), ("mixed", "i", "d", 1.0, "v", "m", "1", "1"), ("versions", "i", "d", 1.0, "u", "m", "1", "1"), ("versions", "j", "d", 1.0, "u", "m", "1", None)]
    df = spark.createDataFrame(rows, schema)
    got = {r["g"]: r for r in metrics.two_level(df, ["g"]).collect()}
    assert {g: r["status"] for g, r in got.items()} == {"ok": "ok", "bad": "invalid_measurement", "bad2": "invalid_measurement", "mixed": "incompatible_measurements", "versions": "incompatible_measurements"}
    assert (got["ok"]["mean_value"], got["ok"]["median_value"], got["ok"]["n_rows"], got["ok"]["n_units"], got["ok"]["n_inner"]) == (6.0, 6.0, 3, 2, 1)
    asked = spark.createDataFrame([("ok", "mean"), ("none", "mean")], "g string, aggregation string")
    assert {r["g"]: (r["status"], r["value"]) for r in metrics.answer_requests(asked, metrics.two_level(df, ["g"]), ["g"]).collect()} == {"ok": ("ok", 6.0), "none": ("unavailable_in_authorized_snapshot", None)}
