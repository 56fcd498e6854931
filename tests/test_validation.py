import pytest
from pyspark.sql import functions as F

from tessera.operators import validation as v


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_each_check_finds_its_violation_and_nothing_else(spark):
    ids = table(spark, [("a",), ("b",), ("b",), (" ",), (None,)], "id string")
    assert {r["id"] for r in v.duplicate_keys(ids, "id").collect()} == {"b", " ", None}
    splits = table(spark, [("g", "train"), ("g", "dev"), ("h", "train"), ("h", None), (None, "dev")], "g string, split string")
    assert [(r["group"], r["splits"]) for r in v.split_leaks(splits, F.col("g")).collect()] == [("g", ["dev", "train"])]
    pairs = table(spark, [("p", "x", "1"), ("p", "y", "2"), ("q", "x", "3"), ("r", "x", "4"), ("r", "x", "5"), (None, "x", "6")], "pair_id string, side string, id string")
    assert {r["pair_id"] for r in v.incomplete_pairs(pairs, ["x", "y"]).collect()} == {"q", "r"}
    same = table(spark, [("a", 1, None), ("a", 1, None), ("b", 1, None), ("b", 1, "z")], "id string, n int, t string")
    assert [r["id"] for r in v.conflicting_rows(same, "id", "n", "t").collect()] == ["b"]
    parts = table(spark, [("a", ["1"], ["1", "2"]), ("b", ["3"], ["1"]), ("c", [], ["1"]), ("d", None, None)], "id string, p array<string>, w array<string>")
    assert {r["id"]: r["extra"] for r in v.not_subset(parts, F.col("p"), F.col("w"), "id").collect()} == {"b": ["3"], "c": [], "d": []}
    a, b = table(spark, [(1,), (1,), (2,)], "k int"), table(spark, [(1,), (2,), (2,), (3,)], "k int")
    assert {r["k"]: (r["in_a"], r["in_b"]) for r in v.multiset_difference(a, b, "k").collect()} == {1: (2, 1), 2: (1, 2), 3: (0, 1)}
    assert {r["k"]: r["side"] for r in v.coverage_gaps(a, b, "k").collect()} == {3: "missing"}
    runs = table(spark, [(1, "x", None), (2, "x", None), (3, "y", 1)], "run int, m string, n int")
    assert [(r["run"], r["differs"]) for r in v.unequal_to_first(runs, "run", "m", "n").collect()] == [(3, ["m", "n"])]
    assert {r["dataset"] for r in v.count_mismatch(table(spark, [("a",), ("b",)], "dataset string"), {"a": 1, "b": 2, "c": 1}).collect()} == {"b", "c"}


def test_enforce(spark):
    df = table(spark, [("a",)], "id string")
    v.enforce(df.limit(0), "nothing")
    with pytest.raises(v.ConstraintError, match="ids"):
        v.enforce(df, "ids")


@pytest.mark.parametrize(
    "text, ok",
    [('{"a": 1}', True), ('{"a": 1, "a": 2}', False), ('{"a": NaN}', False), ('{"a": 1e999}', False), ('{"a": "1e999"}', True), ('{"a": 1} x', False), ("[1]", True), ("3", True), ("3 4", False), ("", False), ('{"a"', False), (" {} ", True), ('"x"', True)],
)
def test_strict_json(spark, text, ok):
    assert table(spark, [(text,)], "t string").select(v.strict_json(F.col("t")).isNotNull()).first()[0] is ok


SPEC = {"type": "object", "required": ["tool"], "properties": {"tool": {"enum": ["read", "stop"]}, "limit": {"type": "integer", "minimum": 1, "maximum": 9}, "x": {"type": "number"}, "names": {"type": "array", "items": {"type": "string"}}}}


@pytest.mark.parametrize(
    "text, ok",
    [
        ('{"tool": "read"}', True), ('{"tool": "go"}', False), ('{"limit": 3}', False), ('{"tool": "read", "limit": 3, "x": 1.5}', True), ('{"tool": "read", "limit": 10}', False), ('{"tool": "read", "limit": 1.5}', False),
        ('{"tool": "read", "limit": true}', False), ('{"tool": "read", "more": 1}', False), ('{"tool": "read", "names": ["a", "b"]}', True), ('{"tool": "read", "names": ["a", 1]}', False), ('{"tool": "read", "names": "a"}', False), ("[]", False), ("3", False),
        ('{"tool": "read", "names": [' + ",".join(['"a"'] * 21) + "]}", False), ('{"tool": "read", "x": "1"}', False),
    ],
)
def test_schema(spark, text, ok):
    df = table(spark, [(text,)], "t string").select(v.strict_json(F.col("t")).alias("j"))
    assert df.select(v.schema_predicate(F.col("j"), SPEC)).first()[0] is ok


def test_first_failure_in_order(spark):
    df = table(spark, [(1, 1), (0, 0), (1, None)], "a int, b int")
    rules = {"first": F.col("a") == 1, "second": F.col("b") == 1}
    assert [r[0] for r in df.select(v.first_failure(rules)).collect()] == [None, "first", "second"]


@pytest.mark.parametrize("block", [1, 100])
def test_anchors(spark, block):
    docs = table(spark, [(1, "All of THIS and that"), (2, None), (3, ""), (4, "this")], "doc int, text string")
    anchors = table(spark, [("a", "this and"), ("b", "This"), ("c", "this"), ("d", None), ("e", ""), ("f", "none")], "anchor string, words string")
    got = {tuple(r) for r in v.anchors_held(docs, "doc", "text", anchors, "anchor", "words", block).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (4, "b"), (4, "c")}
    assert v.anchors_held(docs, "doc", "text", anchors.limit(0), "anchor", "words").count() == 0


@pytest.mark.parametrize("block", [2, 1000])
def test_many_long_anchors_like_brute_force(spark, block):
    import random

    rng = random.Random(8)
    word = lambda: rng.choice(["islet", "胰岛", "Matrix", "βeta", "on", "of"])
    docs = [(k, " ".join(word() for _ in range(rng.choice((0, 3, 40))))) for k in range(40)]
    anchors = []
    for k in range(30):
        text = rng.choice(docs)[1]
        at = rng.randrange(len(text) + 1)
        anchors.append((f"a{k}", text[at : at + rng.choice((5, 16, 17, 60))].upper()))
    anchors.append(("none", "this stands in no document at all"))
    want = {(d, a) for d, t in docs for a, x in anchors if x and x.lower() in t.lower()}
    got = v.anchors_held(table(spark, docs, "doc int, text string"), "doc", "text", table(spark, anchors, "anchor string, words string"), "anchor", "words", block)
    assert {tuple(r) for r in got.collect()} == want


def test_anchors_query_seeks_whole_questions(spark, tmp_path):
    from tessera.plans.validation import anchors

    head = "what is the mean oxygen consumption of islets in hyperoxic media"
    assert len(head) > 60
    spark.createDataFrame([("long", head + " after 4 h?"), ("short", "Why so?"), ("empty", ""), ("none", None)], "item_id string, question string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(1, head + " after 9 h?"), (2, "so: " + head.upper() + " after 4 h? yes"), (3, "He asked: why so?"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in anchors(spark, str(tmp_path)).select("doc_id", "item_id").collect()} == {(2, "long"), (3, "short")}


def test_gap_ranges_of_a_dirty_step(spark):
    df = table(spark, [("a", 0), ("a", 1), ("a", 1), ("a", 2_000_000_000), ("b", 0), ("c", 3), ("d", -1), (None, None)], "t string, k int")
    got = {(r["t"], r["first"], r["last"]) for r in v.gap_ranges(df, "t", "k").collect()}
    assert got == {("a", 2, 1_999_999_999), ("c", 0, 2)}


def test_demonstrations_against_their_steps(spark):
    m = "array<struct<role: string, content: string>>"
    ok = [("system", "s"), ("user", "q"), ("assistant", "a")]
    steps = table(spark, [("t", 0, "x", "h0"), ("t", 1, "x", "h1")], "t string, k int, task string, digest string")
    rows = [
        ("good", "t", 0, "x", "h0", ok), ("task", "t", 1, "y", "h1", ok), ("again", "t", 1, "x", "h2", ok), ("out", "t", 2, "x", "h", ok), ("none", None, None, "x", "h", ok),
        ("later", "t", 0, "x", "h0", [ok[1], ok[0], ok[2]]), ("last", "t", 0, "x", "h0", ok[:2]), ("empty", "t", 0, "x", "h0", None),
    ]
    df = table(spark, rows, f"id string, t string, k int, task string, digest string, messages {m}")
    got = {r["id"]: r["faults"] for r in v.demonstration_faults(df, steps, "t", "k", ["task"]).collect()}
    many = "repeated_step"
    assert got == {"good": [many], "task": [many, "task"], "again": [many, "digest"], "out": ["no_reference"], "none": ["no_reference"], "later": [many, "messages"], "last": [many, "messages"], "empty": [many, "messages"]}


def test_label_contract(spark):
    df = table(spark, [('{"severity": "minor", "context_match": "no", "error_types": ["other"], "causal_evidence_in_source_study": ["none", "x"], "evidence_support": ["mixed"], "target_causal_status": null}',)], "t string")
    got = {r["field"]: r["state"] for r in df.select(F.inline(v.label_states(F.try_parse_json("t")))).collect()}
    assert got == {"severity": "ok", "context_match": "outside", "error_types": "ok", "causal_evidence_in_source_study": "outside", "evidence_support": "outside", "target_causal_status": "absent", "uncertainty_expression": "absent", "causal_evidence_in_target_experiment": "absent"}
