"""Problem 6: claims, reviews and full texts of nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.nested import Members, rest, routed, shred_columns, shred_json, subtype, variants
from tessera.session import table

CLAIMS = {"required_claims": {"evidence": {}}, "source_reviews": {}}
TEXTS = {"fulltext": {"sections": {"paragraphs": {}}}}


def _nodes(spark: SparkSession, sf_dir: str, members: Members) -> DataFrame:
    """The children under ``members``, of the tables that have them."""
    raw = shred_json(table(spark, sf_dir, "raw_records"), "record_id", "body", members)
    for name, key, own in (("pilot_5_questions", "question_id", CLAIMS), ("review_pool_assessment", "assessment_id", TEXTS)):
        if mine := {m: more for m, more in members.items() if m in own}:
            raw = raw.unionByName(shred_columns(table(spark, sf_dir, name), key, mine))
    return raw


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supertype table: every child of the three tables, with its parent link, shape, subtype and content."""
    return routed(_nodes(spark, sf_dir, CLAIMS | TEXTS))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("record_key", "child_path", "ordinals").distinct()


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of the tables whose columns are nested already."""
    pilot = shred_columns(table(spark, sf_dir, "pilot_5_questions"), "question_id", CLAIMS)
    pool = shred_columns(table(spark, sf_dir, "review_pool_assessment"), "assessment_id", TEXTS)
    return pilot.unionByName(pool).select("record_key", "child_path", "ordinals", "parent_ordinals")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_nodes(spark, sf_dir, CLAIMS | TEXTS))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims; one that is a bare text is its own text."""
    return subtype(_nodes(spark, sf_dir, {"required_claims": CLAIMS["required_claims"]}), "required_claims", "text string, is_core boolean, ai_confidence string", lone="text")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of claims; one that is a bare text is the review that it names."""
    out = subtype(_nodes(spark, sf_dir, {"required_claims": CLAIMS["required_claims"]}), "required_claims.evidence", "source_review string, span struct<start_char: int, end_char: int>", lone="source_review")
    return out.select("record_key", "ordinals", "parent_ordinals", "variant", "source_review", F.col("span.start_char").alias("start_char"), F.col("span.end_char").alias("end_char"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source reviews, which are bare texts, or objects that name one."""
    return subtype(_nodes(spark, sf_dir, {"source_reviews": {}}), "source_reviews", "source_review string", lone="source_review")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtype(_nodes(spark, sf_dir, TEXTS), "fulltext", "status string, path string, sha256 string, error string", lone="path")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections; one that is a bare text is its heading."""
    return subtype(_nodes(spark, sf_dir, TEXTS), "fulltext.sections", "heading string", lone="heading")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtype(_nodes(spark, sf_dir, TEXTS), "fulltext.sections.paragraphs", "paragraph_id string, n_chars int", lone="paragraph_id")


def others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that are neither objects nor bare texts, by path: no typed table has them."""
    every = _nodes(spark, sf_dir, CLAIMS | TEXTS)
    parts = [rest(every, path, "object", "str").withColumn("child_path", F.lit(path)) for path in ("required_claims", "required_claims.evidence", "source_reviews", "fulltext", "fulltext.sections", "fulltext.sections.paragraphs")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("child_path", "subtype").agg(F.count("*").alias("children"))


_P = "(SELECT question_id AS k, required_claims AS c, source_reviews AS r FROM pilot_5_questions)"
_F = "(SELECT assessment_id AS k, fulltext.sections AS s FROM review_pool_assessment WHERE fulltext IS NOT NULL)"
_AT = "unnest({0}) AS {1}, unnest(range(len({0}))) AS {2}"
def _decoded(x: str) -> str:
    """What a JSON value is, JSON in a string being what it encodes."""
    once = f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches(json_extract_string({x}, '$'), '^\\s*[\\[{{\"]') AND json_valid(json_extract_string({x}, '$')) THEN CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"
    return once


_MEMBERS = "'required_claims', 'source_reviews', 'fulltext'"


def _opened(x: str) -> str:
    """A record without one wrapping: a list of one, or the member ``record`` where no other member is there."""
    return _decoded(f"(CASE WHEN json_type({x}) = 'ARRAY' AND json_array_length({x}) = 1 THEN json_extract({x}, '$[0]') WHEN json_type({x}) = 'OBJECT' AND list_contains(json_keys({x}), 'record') AND NOT list_has_any(json_keys({x}), [{_MEMBERS}]) THEN json_extract({x}, '$.record') ELSE {x} END)")


def _elements(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def _below(parent: str, member: str, path: str, before: str = "") -> str:
    """The children of a member of the rows (k, o, x) of a table."""
    place = "CAST(i AS VARCHAR)" if not before else "o || '.' || i"
    return f"""SELECT k, '{path}' AS path, o, x FROM (SELECT k, {place} AS o, {_decoded('e')} AS x FROM (SELECT k, o, unnest(l) AS e, unnest(range(len(l))) AS i FROM (SELECT k, o, {_elements('v')} AS l FROM (SELECT k, o, {_decoded('v')} AS v FROM (SELECT k, o, json_extract(x, '$.{member}') AS v FROM {parent} WHERE json_type(x) = 'OBJECT') WHERE v IS NOT NULL)))) WHERE json_type(x) <> 'NULL'"""


_RAW = f"""
b0 AS (SELECT DISTINCT record_id AS k, CAST(body AS JSON) AS x FROM raw_records WHERE record_id IS NOT NULL AND json_valid(body)),
b1 AS (SELECT k, {_decoded('x')} AS x FROM b0), b2 AS (SELECT k, {_opened('x')} AS x FROM b1), b3 AS (SELECT k, {_opened('x')} AS x FROM b2), b4 AS (SELECT k, {_opened('x')} AS x FROM b3), b5 AS (SELECT k, '' AS o, {_opened('x')} AS x FROM b4),
c1 AS ({_below('b5', 'required_claims', 'required_claims')}), c2 AS ({_below('c1', 'evidence', 'required_claims.evidence', 'o')}), c3 AS ({_below('b5', 'source_reviews', 'source_reviews')}),
c4 AS ({_below('b5', 'fulltext', 'fulltext')}), c5 AS ({_below('c4', 'sections', 'fulltext.sections', 'o')}), c6 AS ({_below('c5', 'paragraphs', 'fulltext.sections.paragraphs', 'o')})"""

QUERIES = {"p6_found": found, "p6_nodes": nodes, "p6_columns": columns, "p6_variants": shapes, "p6_claims": claims, "p6_evidence": evidence, "p6_reviews": reviews, "p6_texts": texts, "p6_sections": sections, "p6_paragraphs": paragraphs, "p6_others": others}
_COLUMNS_WITH = f"""
c AS (SELECT DISTINCT k, x, i FROM (SELECT k, {_AT.format('c', 'x', 'i')} FROM {_P}) WHERE x IS NOT NULL),
s AS (SELECT DISTINCT k, x, i FROM (SELECT k, {_AT.format('s', 'x', 'i')} FROM {_F}) WHERE x IS NOT NULL)"""
_COLUMNS = f"""SELECT k AS record_key, 'required_claims' AS child_path, CAST(i AS VARCHAR) AS ordinals, NULL AS parent_ordinals FROM c
UNION SELECT k, 'required_claims.evidence', i || '.' || j, CAST(i AS VARCHAR) FROM (SELECT k, i, {_AT.format('x.evidence', 'e', 'j')} FROM c) WHERE e IS NOT NULL
UNION SELECT k, 'source_reviews', CAST(i AS VARCHAR), NULL FROM (SELECT k, {_AT.format('r', 'x', 'i')} FROM {_P}) WHERE x IS NOT NULL
UNION SELECT k, 'fulltext', '0', NULL FROM {_F}
UNION SELECT k, 'fulltext.sections', '0.' || i, '0' FROM s
UNION SELECT k, 'fulltext.sections.paragraphs', '0.' || i || '.' || j, '0.' || i FROM (SELECT k, i, {_AT.format('x.paragraphs', 'e', 'j')} FROM s) WHERE e IS NOT NULL"""
ORACLES = {
    "p6_columns": f"WITH {_COLUMNS_WITH}\n{_COLUMNS}",
    "p6_reviews": f"WITH {_RAW} SELECT k AS record_key, o AS ordinals, CAST(NULL AS VARCHAR) AS parent_ordinals, 'str' AS variant, json_extract_string(x, '$') AS source_review FROM c3 UNION SELECT k, CAST(i AS VARCHAR), NULL, 'str', x FROM (SELECT k, {_AT.format('r', 'x', 'i')} FROM {_P}) WHERE x IS NOT NULL",
    "p6_found": f"WITH {_COLUMNS_WITH}, {_RAW}\nSELECT DISTINCT record_key, child_path, ordinals FROM ({_COLUMNS}) UNION " + " UNION ".join(f"SELECT k, path, o FROM c{n}" for n in range(1, 7)),
}
