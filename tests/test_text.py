import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import review, views


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def sentences(text):
    out = []
    for m in re.finditer(r"[^.!?。！？]+(?:[.!?。！？]+|$)", text):
        bare = m.group().lstrip()
        if bare:
            out.append((m.end() - len(bare), m.end(), bare))
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 胰β😀.!。 \t\n"), max_size=30), min_size=1, max_size=20))
def test_sentence_spans_round_trip(spark_texts, texts):
    spark = spark_texts
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "evidence_id int, text string")
    got = {}
    for r in views.sentence_spans(rows).collect():
        got.setdefault(r["evidence_id"], []).append((r["char_start"], r["char_end"], r["text"]))
        assert texts[r["evidence_id"]][r["char_start"] : r["char_end"]] == r["text"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sentences(t) for k, t in enumerate(texts) if sentences(t)}


import pytest  # noqa: E402


@pytest.fixture(scope="module")
def spark_texts(spark):
    return spark


def test_word_sets(spark):
    assert sorted(one(spark, "The β-cell, the CELL-2 and Ca²⁺ in 胰岛细胞 ab", tx.word_set)) == sorted(["the", "β-cell", "cell-2", "and", "ca²", "胰岛细胞"])


def test_small_parsers(spark):
    assert one(spark, "C:\\a\\b/c.json", tx.basename) == "c.json" and one(spark, "c", tx.basename) == "c"
    assert one(spark, " A b --raises--> C ", tx.triple).asDict() == {"head": "A b", "relation": "raises", "tail": "C"}
    assert one(spark, "A -> C", tx.triple) is None
    assert one(spark, "PMID:12", tx.tag_value) == "12" and one(spark, "DOI:1", tx.tag_value) is None
    assert one(spark, '=1+"2"', tx.csv_cell) == '"\'=1+""2"""' and one(spark, None, tx.csv_cell) == '""'
    assert one(spark, '{"a":"</script>&\u2028"}', tx.script_safe) == '{"a":"\\u003c/script\\u003e\\u0026\\u2028"}'
    ids = ["R-10", "r-9", "R-009b", "R-2"]
    assert sorted(ids, key=lambda i: one(spark, i, tx.natural_key)) == ["R-2", "r-9", "R-009b", "R-10"]


def test_canonical_hash_is_that_of_sorted_json(spark):
    row = {"a": None, "b": "胰岛", "c": [1, 2], "d": 3}
    df = spark.createDataFrame([(None, "胰岛", [1, 2], 3)], "a string, b string, c array<int>, d int")
    want = hashlib.sha256(json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(tx.canonical_hash("a", "b", "c", "d")).first()[0] == want
    assert df.select(tx.short_id("x-", "a", "b", "c", "d")).first()[0] == "x-" + want[:24]


@pytest.mark.parametrize("text, hit", [("sk-" + "a1" * 10, True), ("Bearer abcdefghijklmnopqrstu", True), ("API key = zzz", True), ("password strength", False), ("token", False)])
def test_secrets(spark, text, hit):
    assert one(spark, text, lambda c: c.rlike(tx.SECRET)) is hit


def test_search_ranks_exact_first(spark):
    rows = [(3, "the islet core"), (1, "core of the islet"), (2, "nothing here"), (4, "THE ISLET CORE again"), (5, None)]
    got = views.search(spark.createDataFrame(rows, "evidence_id int, text string"), " islet core ", 3).collect()
    assert [(r["evidence_id"], r["exact_match"], r["exact_matches"]) for r in got] == [(3, True, 2), (4, True, 2), (1, False, 2)]


def test_listing_pages(spark):
    members = views.bridge(spark.createDataFrame([("v", ["c", "a", None, "b"]), ("w", []), ("x", None)], "view_id string, ids array<string>"), "ids", "evidence_id")
    page = views.listing(members, 1, 1).collect()
    assert [(r["evidence_id"], r["total"], r["complete"]) for r in page] == [("a", 3, False)]
    assert all(r["complete"] for r in views.listing(members, 0, 3).collect())
    asked = spark.createDataFrame([("v", "a"), ("v", "z"), ("w", "a")], "view_id string, evidence_id string")
    assert sorted(r["status"] for r in views.read_status(asked, members, "evidence_id").collect()) == ["ok"] + ["unavailable_in_authorized_snapshot"] * 2


def test_counters_flags_and_filters(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (True,)], "x boolean")
    assert {(r["x"], r["n"]) for r in review.counter(df, "x").collect()} == {("True", 2), ("False", 1), ("unknown", 1)}
    tags = spark.createDataFrame([(["b", "a"],), (["a", None],), (None,), (["c", "b"],)], "t array<string>")
    assert [(r["value"], r["n"], r["rank"]) for r in review.ranked_counter(tags, F.col("t")).orderBy("rank").collect()] == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]
    records = spark.createDataFrame([("d", "s", ["f"], "islet text"), ("d", "s", [], "islet text"), ("e", "s", ["f"], "islet")], "dataset string, status string, flags array<string>, search_text string")
    assert review.faceted(records, dataset="d", status="s", flagged=True, query=" ISLET ").count() == 1


def test_search_text_like_a_plain_walk(spark, sf):
    """The whole record of every question, against a walk over its leaves in Python."""
    import unicodedata

    import pyarrow.parquet as pq

    from tessera.plans.review import ALIASES
    from tessera.plans.search import search_texts

    def leaves(x):
        if x is None:
            return []
        if isinstance(x, bool):
            return ["true" if x else "false"]
        if isinstance(x, dict):
            return [t for v in x.values() for t in leaves(v)]
        return [t for v in x for t in leaves(v)] if isinstance(x, list) else [str(x)]

    want = {}
    for row in pq.read_table(f"{sf}/pilot_5_questions.parquet").to_pylist():
        text = " ".join(leaves({k: v for k, v in row.items() if k not in ("ingested_at", "created_at")}))
        for sign, more in ALIASES.items():
            text += more if sign in text else ""
        text = unicodedata.normalize("NFKC", text).casefold()
        want[row["question_id"]] = (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert {r["question_id"]: (r["length"], r["hash"]) for r in search_texts(spark, sf).collect()} == want


def test_titles_in_chinese_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("次",), ("阿",), ("波",), ("a",)], "t string")
    assert [r["t"] for r in df.orderBy(F.collate("t", "zh")).collect()][-3:] == ["阿", "波", "次"] or [r["t"] for r in df.orderBy(F.collate("t", "zh")).collect()][:3] == ["阿", "波", "次"]


def test_half_even(spark):
    from tessera.functions.numeric import half_even
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"), 2)).collect()] == [0.12, 0.38, -0.12, 2.5, None]
