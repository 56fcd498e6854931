import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.nested import children_of, rest, routed, shred_columns, shred_json, subtype, variants

MEMBERS = {"claims": {"evidence": {}}, "full": {"sections": {"paragraphs": {}}}}


def places(body):
    return {(p, o) for p, o, *_ in children_of(body if isinstance(body, str) or body is None else json.dumps(body), MEMBERS)}


def test_forms_of_bodies():
    assert places({"claims": [{"evidence": [{"a": 1}, None]}, None, "x"]}) == {("claims", "0"), ("claims", "2"), ("claims.evidence", "0.0")}
    assert places({"claims": {"evidence": {"a": 1}}}) == {("claims", "0"), ("claims.evidence", "0.0")}
    assert places({"claims": json.dumps([{"evidence": json.dumps({"a": 1})}])}) == {("claims", "0"), ("claims.evidence", "0.0")}
    assert places({"by": "x", "record": {"full": [{"sections": [None, {"paragraphs": [1]}]}]}}) == {("full", "0"), ("full.sections", "0.1"), ("full.sections.paragraphs", "0.1.0")}
    assert places({"record": json.dumps({"claims": ["PMID:1"]})}) == {("claims", "0")}
    for none in (None, "", "{", '{"claims": [', "[]", "3", "null", {"claims": None}, {"claims": []}, {"other": [1]}, "[" * 5000):
        assert places(none) == set()


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["claims", "evidence", "full", "sections", "paragraphs", "record", "z"]), x, max_size=3), max_leaves=25))
def test_any_body_gives_linked_nodes(body):
    nodes = {(p, o): before for p, o, before, *_ in children_of(json.dumps(body), MEMBERS)}
    for (path, _), before in nodes.items():
        assert (before is None) == ("." not in path)
        assert before is None or (path.rpartition(".")[0], before) in nodes


def test_columns_and_json_agree(spark):
    schema = "id string, claims array<struct<text: string, core: boolean, evidence: array<struct<source: string, span: struct<a: int>>>>>, full struct<status: string, sections: array<struct<heading: string, paragraphs: array<struct<n: int>>>>>, record string"
    rows = [
        ("a", [("x", True, [("s", (1,)), None, ("t", None)]), None, ("y", None, None)], ("ok", [(None, [(1,), None]), None]), "z"),
        ("a", [("x", True, [("s", (1,)), None, ("t", None)]), None, ("y", None, None)], ("ok", [(None, [(1,), None]), None]), "z"),
        ("b", None, None, None), ("c", [], (None, []), None), (None, [("x", True, None)], None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    flat = shred_columns(df, "id", MEMBERS)
    body = df.selectExpr("id", "to_json(struct(claims, full)) AS body", "record")
    as_json = shred_json(body, "id", "body", MEMBERS)
    pick = lambda d: {tuple(r) for r in d.select("record_key", "child_path", "ordinals", "parent_ordinals", "variant").collect()}
    assert pick(flat) == pick(as_json) and flat.count() == len(pick(flat)) == 8
    typed = {(r["ordinals"], r["parent_ordinals"], r["source"]) for r in subtype(flat, "claims.evidence", "source string").collect()}
    assert typed == {("0.0", "0", "s"), ("0.2", "0", "t")}
    assert variants(flat).agg({"children": "sum"}).first()[0] == 8
    assert shred_columns(df.limit(0), "id", MEMBERS).count() == 0 and shred_json(body.limit(0), "id", "body", MEMBERS).count() == 0


def test_long_bodies(spark):
    body = json.dumps({"claims": [{"text": "t" * 100, "evidence": [{"a": k}]} for k in range(5000)]})
    df = spark.createDataFrame([("a", body, 1)], "id string, body string, ordinals int")
    assert shred_json(df, "id", "body", MEMBERS).count() == 10_000


def test_states_route_children_to_their_subtypes(spark):
    body = json.dumps({"claims": ["bare", {"text": "t", "n": 1}, 3, [1, "x"], None, True, json.dumps({"text": "in a text"})]})
    nodes = shred_json(spark.createDataFrame([("a", body)], "id string, body string"), "id", "body", MEMBERS)
    assert {r["ordinals"]: r["subtype"] for r in routed(nodes).collect()} == {"0": "str", "1": "object", "2": "num", "3": "list", "5": "bool", "6": "object"}
    typed = {r["ordinals"]: r["text"] for r in subtype(nodes, "claims", "text string", lone="text").collect()}
    assert typed == {"0": "bare", "1": "t", "6": "in a text"}
    assert {r["ordinals"] for r in subtype(nodes, "claims", "text string").collect()} == {"1", "6"}
    assert {(r["ordinals"], r["payload"]) for r in rest(nodes, "claims", "object", "str").collect()} == {("2", "3"), ("3", '[1, "x"]'), ("5", "true")}


def test_every_child_is_in_one_typed_table(spark, sf):
    from tessera.plans import p6

    every = {(r["record_key"], r["child_path"], r["ordinals"]) for r in p6.found(spark, sf).collect()}
    tables = {"required_claims": p6.claims, "required_claims.evidence": p6.evidence, "source_reviews": p6.reviews, "fulltext": p6.texts, "fulltext.sections": p6.sections, "fulltext.sections.paragraphs": p6.paragraphs}
    typed = {(r["record_key"], path, r["ordinals"]) for path, query in tables.items() for r in query(spark, sf).collect()}
    assert typed <= every and len(every - typed) == sum(r["children"] for r in p6.others(spark, sf).collect())
