import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.numeric import close, wilson
from tessera.operators import evaluation as ev

FOUR = [("supported", "supported"), ("supported", "insufficient"), ("insufficient", "supported"), ("contradicted", "invalid")]


def judged(spark, rows=FOUR):
    return spark.createDataFrame(rows, "truth string, guess string")


def test_four_rows(spark):
    row = ev.overall_scores(judged(spark), "truth", "guess").first()
    assert (row["accuracy"], row["false_support_rate"], row["withheld_rate"], row["invalid"]) == (0.25, 0.5, 0.5, 1)
    classes = {r["label"]: r for r in ev.class_scores(judged(spark), "truth", "guess").collect()}
    assert [classes["supported"][k] for k in ("precision", "recall", "f1")] == [0.5, 0.5, 0.5]
    assert classes["mixed"]["recall"] is None and classes["mixed"]["precision"] == 0
    assert row["macro_f1_observed"] == pytest.approx(0.5 / 3) and row["macro_f1_all"] == pytest.approx(0.125)
    matrix = {r["truth"]: r.asDict() for r in ev.confusion(judged(spark), "truth", "guess").collect()}
    assert matrix["contradicted"]["invalid"] == 1 and matrix["mixed"]["supported"] == 0 and len(matrix) == 4


def test_wilson(spark):
    df = spark.createDataFrame([(70, 80), (0, 0), (0, 5)], "s int, n int")
    a, none, zero = (r[0] for r in df.select(wilson(F.col("s"), F.col("n"))).collect())
    assert a["low"] < 0.875 < a["high"] < 1 and none is None and zero["low"] == pytest.approx(0, abs=1e-12)


def test_pairs_count_only_when_whole(spark):
    rows = [("p", 0, "a", True), ("p", 0, "b", True), ("p", 1, "a", True), ("q", 0, "a", True), ("q", 0, "b", False)]
    got = ev.paired_both(spark.createDataFrame(rows, "pair_id string, repeat int, side string, success boolean"), ["a", "b"]).first()
    assert got.asDict() == {"complete": 2, "successes": 1, "unique_pairs": 2, "unpaired": 1}


def test_majority_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4)], "label string, k int")
    assert ev.majority(df, "label", "k").first().asDict() == {"label": "b", "n": 2}


def test_length_report_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [4, 1, 3, 2, None]], "n int")
    got = ev.length_report(df, "n").first()
    assert (got["records"], got["total"], got["median"], got["p95"], got["shortest"], got["longest"]) == (4, 10, 3, 4, 1, 4)


def test_bootstrap_is_the_same_every_time(spark):
    rows = [(f"g{k % 9}", k % 3 == 0) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, ok boolean")
    one = ev.group_bootstrap(df, "g", "ok", 200).first()
    assert one == ev.group_bootstrap(df.repartition(7), "g", "ok", 200).first()
    assert one["low"] <= one["point"] <= one["high"]
    few = ev.group_bootstrap(df.where("g = 'g1'"), "g", "ok", 200).first()
    assert few["clusters"] == 1 and few["low"] is None


def test_feedback(spark):
    a = ("s", True, ["x", "y", "z"], ["o1", "o2", "o3"])
    other = lambda actions, observations, initial="s", success=True: (initial, success, actions, observations)
    rows = [
        (a, other(["x", "y", "w"], ["o1", "p2", "o3"]), True), (a, other(["x", "q", "w"], ["o1", "p2", "o3"]), False), (a, a, False), (a, other(["x", "y"], ["o1", "p2"]), False), (a, other(["x", "y", "z"], ["o1", "p2", "o3"]), False),
        (a, other(["x", "y", "w"], ["o1", "p2", "o3"], initial="t"), False), (a, other(["x", "y", "w"], ["o1", "p2", "o3"], success=False), False), (a, other([], []), False), (a, other(["x", None, "w"], ["o1", "p2", "o3"]), False),
    ]
    kind = "struct<initial: string, success: boolean, actions: array<string>, observations: array<string>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, want boolean")
    assert all(r["changed"] == r["want"] for r in ev.changed_after_feedback(df, "a", "b").collect())


def test_class_keys_and_parsed_predictions(spark):
    good = '{"labels": {"evidence_support": "mixed", "n": 1, "s": "1", "l": ["a"], "o": {"a": 1}, "none": null, "yes": true}}'
    df = spark.createDataFrame([(good,), ('{"labels": {"evidence_support": "maybe"}}',), ('{"labels": []}',), ("[1]",), ("{", ), (None,), ('{"labels": {"evidence_support": "mixed", "": 1}}',)], "t string")
    got = [r["p"] for r in df.select(ev.parse_prediction(F.col("t")).alias("p")).collect()]
    assert [(p["json_valid"], p["label_schema_valid"], p["error"]) for p in got] == [(True, True, None)] + [(True, False, "labels")] * 3 + [(False, False, "json")] * 2 + [(True, False, "labels")]
    assert got[0]["labels"] == {"evidence_support": '"mixed"', "n": "1", "s": '"1"', "l": '["a"]', "o": '{"a":1}', "none": "null", "yes": "true"} and got[1]["labels"] == {}
    keys = df.where("t LIKE '%yes%'").select(F.explode(F.expr("try_variant_get(try_parse_json(t), '$.labels', 'map<string, variant>')")).alias("k", "v")).select("k", ev.class_key(F.col("v")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in keys} == {"evidence_support": '"mixed"', "n": "1", "s": '"1"', "l": None, "o": None, "none": None, "yes": "true"}


def test_field_scores_of_classes_without_truths_and_lists(spark):
    rows = [({"f": '"a"', "l": '["x"]'}, {"f": '"b"'}, True), ({"f": '"a"'}, {"f": '"a"'}, True), ({"f": "null"}, {"f": '"a"'}, True), ({"g": '"z"'}, {}, False)]
    df = spark.createDataFrame(rows, "t map<string,string>, p map<string,string>, v boolean")
    got = {r["field"]: r for r in ev.field_scores(df, F.col("t"), F.col("p"), F.col("v"), {"f": ("a", "b", "c")}).collect()}
    f = got["f"]
    assert (f["evaluated"], f["not_applicable"], f["missed"], f["absent_classes"]) == (2, 2, 0, "b,c") and f["macro_f1"] == pytest.approx(2 / 3) and f["macro_f1_all"] == pytest.approx(2 / 9)
    assert (got["l"]["non_scalar"], got["l"]["evaluated"], got["l"]["accuracy"]) == (1, 0, None) and (got["g"]["missed"], got["g"]["accuracy"], got["g"]["macro_f1_all"]) == (1, 0, None)


def test_pair_faults(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "x", None), (4, "x", 1)], "id int, t string, n int")
    b = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "y", 2), (3, "x", None), (5, "x", 1)], "id int, t string, n int")
    assert sorted(map(tuple, ev.pair_faults(a, b, "id", "t", "n").collect())) == [(1, "repeated"), (2, "n"), (2, "t"), (4, "not_in_b"), (5, "not_in_a")]


def test_fields(spark):
    rows = [(1, {"f": "x", "g": None}, {"f": "x", "g": "y"}, True), (2, {"f": "x", "g": "y"}, {"f": "z"}, True), (3, {"f": "y", "g": "y"}, {"f": "y", "g": "y"}, False)]
    df = spark.createDataFrame(rows, "id int, t map<string,string>, p map<string,string>, v boolean")
    got = {r["field"]: r for r in ev.field_scores(df, F.col("t"), F.col("p"), F.col("v")).collect()}
    assert (got["f"]["evaluated"], got["f"]["missed"], got["g"]["not_applicable"], got["g"]["missed"]) == (3, 1, 1, 2)
    assert got["f"]["accuracy"] == pytest.approx(1 / 3) and got["f"]["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_close(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-10), (1.0, 1.1), (0.0, 1e-10), (1e12, 1e12 + 1)], "a double, b double")
    assert [r[0] for r in df.select(close(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


def test_macro_f1_bootstrap_like_brute_force(spark):
    import random

    rng = random.Random(5)
    labels = ev.SUPPORT_LABELS
    rows = [(f"t{rng.randrange(12):02d}", rng.choice(labels[:3]), rng.choice((*labels, "invalid")), rng.choice((*labels, "invalid"))) for _ in range(80)]
    rows += [(t, y, a, y if rng.random() < 0.5 else b) for t, y, a, b in rows]
    df = spark.createDataFrame([*rows, (None, "mixed", "mixed", "mixed")], "task string, truth string, a string, b string")

    def macro(chosen, p):
        f1 = []
        for label in {r[1] for r in chosen}:
            tp, fp, fn = (sum(test(r[1] == label, r[p] == label) for r in chosen) for test in (lambda y, z: y and z, lambda y, z: z and not y, lambda y, z: y and not z))
            f1.append(2 * tp / (2 * tp + fp + fn))
        return sum(f1) / len(f1)

    keys, samples = sorted({r[0] for r in rows}), 200
    slots = [int(hashlib.md5(f"20260908:{k}".encode()).hexdigest()[:15], 16) % len(keys) for k in range(samples * len(keys))]
    values = []
    for k in range(samples):
        chosen = [r for x in slots[k * len(keys) : (k + 1) * len(keys)] for r in rows if r[0] == keys[x]]
        values.append(macro(chosen, 3) - macro(chosen, 2))
    values.sort()
    got = ev.macro_f1_bootstrap(df, "task", "truth", "a", "b", samples).first()
    assert got["clusters"] == len(keys)
    assert (got["point"], got["low"], got["high"]) == pytest.approx((macro(rows, 3) - macro(rows, 2), values[int(199 * 0.025)], values[int(199 * 0.975)]))
    assert ev.macro_f1_bootstrap(df.where("task = 't01'"), "task", "truth", "a", "b").first()["low"] is None


def test_bootstrap_query_draws_as_often_as_the_reference(spark, sf):
    from tessera.plans import evaluation as plans

    full = ev.group_bootstrap(plans.episodes(spark, sf), "task_id", "success", 2000).first()
    assert plans.bootstrap(spark, sf).first() == pytest.approx(tuple(full), abs=1e-9)
    assert tuple(full) != tuple(ev.group_bootstrap(plans.episodes(spark, sf), "task_id", "success", 200).first())
