"""Queries of the view, search and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.numbering import numbered
from tessera.functions.unicode import search_form
from tessera.operators import views
from tessera.plans.review import ALIASES
from tessera.session import table
from tessera.sources.files import public_records

QUERY = "cristae remodelling in the matrix"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "paper_id", "section", "title", "source", "text")


def view_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view a paper: its documents in the order of their ids."""
    return passages(spark, sf_dir).where("paper_id IS NOT NULL").groupBy(F.col("paper_id").alias("view_id")).agg(F.array_sort(F.collect_list("evidence_id")).alias("passage_ids"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = views.bridge(view_table(spark, sf_dir), "passage_ids", "evidence_id")
    page = views.listing(members, 0, 2)
    return page.join(passages(spark, sf_dir).select("evidence_id", "section", "title"), "evidence_id").select("view_id", "evidence_id", "section", "title", "total", "complete")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(passages(spark, sf_dir).select("evidence_id", "section", "text"), QUERY).select("evidence_id", "section", "exact_match", "lexical_overlap", "exact_matches", "snippet")


def search_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(passages(spark, sf_dir).select("evidence_id", "source", "text"), "ATP synthesis", 3, by="source").select("source", "evidence_id", "exact_match", "lexical_overlap", "exact_matches")


def catalog_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages whose section and title share most words with a question."""
    rows = passages(spark, sf_dir).where("title IS NOT NULL").select("evidence_id", tx.word_overlap(tx.word_set(F.concat_ws(" ", "section", "title"), r"[\p{L}\p{N}_]{3,}"), tx.word_set(F.lit(QUERY), r"[\p{L}\p{N}_]{3,}")).alias("overlap"))
    return rows.where("overlap > 0").orderBy(F.desc("overlap"), "evidence_id").limit(25)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sentence_spans(passages(spark, sf_dir).select("evidence_id", "text")).select("evidence_id", "index", "char_start", "char_end", F.sha2("text", 256).alias("hash"))


def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("source", F.size(tx.statements(F.col("text"))).alias("n")).groupBy("source").agg(F.sum("n").alias("statements"), F.max("n").alias("most"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("evidence_id", F.size(tx.word_set(F.col("text"))).alias("words"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents each paper's view may read, of those of its neighbours by number."""
    members = views.bridge(view_table(spark, sf_dir), "passage_ids", "evidence_id")
    asked = passages(spark, sf_dir).where("paper_id IS NOT NULL").select(F.col("paper_id").alias("view_id"), (F.col("evidence_id") + F.col("evidence_id") % 2).alias("evidence_id"))
    return views.read_status(asked, members, "evidence_id").groupBy("status").agg(F.count("*").alias("requests"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id"), F.lit(" --"), F.col("event_type"), F.lit("--> "), F.col("props")).alias("t"))
    return rows.select("event_id", tx.triple(F.col("t")).alias("x")).select("event_id", "x.*")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "title", "text", "source")
    return rows.select("doc_id", tx.csv_cell(F.col("title")).alias("title"), F.sha2(tx.csv_cell(F.col("text")), 256).alias("text"), tx.csv_cell(F.concat(F.lit("="), F.col("source"))).alias("source"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_records").select("record_id", F.sha2(tx.script_safe(F.col("body")), 256).alias("hash")).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they may be published, out of records with whole paths: the bare name, and that all else is as it was."""
    rows = table(spark, sf_dir, "verifier_records").drop("ingested_at").dropDuplicates(["id"])
    rows = rows.withColumn("metadata", F.col("metadata").withField("original_record.file", F.concat(F.lit("C:\\data/"), F.col("metadata.original_record.file"))))
    out = public_records(rows)
    digest = lambda df: F.md5(F.to_json(F.struct(*(c for c in df.columns if c != "metadata"))).cast("binary"))
    both = rows.select("id", digest(rows).alias("before")).join(out.select("id", "metadata", digest(out).alias("after")), "id")
    return both.select("id", F.col("metadata.original_record.file").alias("file"), F.col("metadata.split").alias("split"), (F.col("before") == F.col("after")).alias("unchanged"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pilot_5_questions").select("question_id").distinct()
    return rows.select("question_id", tx.natural_key(F.col("question_id")).alias("sort_key")).orderBy("sort_key")


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search text of each whole record, as its length and hash."""
    rows = table(spark, sf_dir, "pilot_5_questions").drop("ingested_at", "created_at").dropDuplicates(["question_id"])
    full = rows.select("question_id", search_form(tx.with_aliases(tx.record_text(rows), ALIASES)).alias("t"))
    return full.select("question_id", F.length("t").alias("length"), F.sha2("t", 256).alias("hash"), F.contains("t", F.lit(" beta ")).alias("has_beta"))


def leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf values of the reviews' nested members, as one text each."""
    rows = table(spark, sf_dir, "review_pool_assessment").drop("ingested_at").dropDuplicates(["assessment_id"])
    return rows.select("assessment_id", F.sha2(tx.record_text(rows, "bibliography", "coverage", "reference_count", "fulltext"), 256).alias("hash"))


def title_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of the documents in the order of Chinese readers."""
    rows = table(spark, sf_dir, "documents").where("title IS NOT NULL").select("title").distinct()
    return numbered(rows, F.collate("title", "zh"), F.col("title")).select("title", "place")


_W = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_-]{{3,}}'))"
_DOC_WORDS = _W.format("text")
_Q_WORDS = _W.format(f"'{QUERY}'")

QUERIES = {
    "proj3_listing": listing, "o1_search": search, "o1_search_by_source": search_by_source, "o2_catalog_rank": catalog_rank, "f7_sentence_spans": spans, "f7_span_counts": span_counts, "f6_word_sets": words,
    "proj2_read_status": reads, "f14_triples": triples, "s15_csv_cells": cells, "s17_script_safe": escaped, "s18_public_files": files, "o4_natural_order": natural_order, "f13_search_text": search_texts, "f12_leaf_values": leaf_values, "o4_title_order": title_order,
}
ORACLES = {
    "f12_leaf_values": """SELECT assessment_id, sha256(array_to_string(list_filter(list_concat([b.pmid, b.doi, b.pmcid, b.title, CAST(b.year AS VARCHAR)], coalesce(coverage, []), [CAST(reference_count AS VARCHAR), f.status, f.path, f.sha256, f.error],
coalesce(flatten(list_transform(f.sections, lambda s: list_concat([s.heading], coalesce(flatten(list_transform(s.paragraphs, lambda p: [p.paragraph_id, CAST(p.n_chars AS VARCHAR)])), [])))), [])), lambda x: x IS NOT NULL), ' ')) AS hash FROM (SELECT DISTINCT ON (assessment_id) assessment_id, bibliography AS b, coverage, reference_count, fulltext AS f FROM review_pool_assessment)""",
    "proj3_listing": "SELECT paper_id AS view_id, doc_id AS evidence_id, section, title, total, total <= 2 AS complete FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS total, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS k FROM documents WHERE paper_id IS NOT NULL) WHERE k <= 2",
    "o1_search": f"WITH h AS (SELECT doc_id AS evidence_id, section, contains(lower(text), lower('{QUERY}')) AS exact_match, CAST(len(list_intersect({_DOC_WORDS}, {_Q_WORDS})) AS INTEGER) AS lexical_overlap, left(text, 240) AS snippet FROM documents) SELECT evidence_id, section, exact_match, lexical_overlap, (SELECT count(*) FROM h WHERE exact_match) AS exact_matches, snippet FROM h WHERE exact_match OR lexical_overlap > 0 ORDER BY exact_match DESC, lexical_overlap DESC, evidence_id LIMIT 20",
    "o1_search_by_source": f"WITH h AS (SELECT doc_id AS evidence_id, source, contains(lower(text), 'atp synthesis') AS exact_match, CAST(len(list_intersect({_DOC_WORDS}, ['atp', 'synthesis'])) AS INTEGER) AS lexical_overlap FROM documents), r AS (SELECT *, count(*) FILTER (exact_match) OVER (PARTITION BY source) AS exact_matches, row_number() OVER (PARTITION BY source ORDER BY exact_match DESC, lexical_overlap DESC, evidence_id) AS k FROM h WHERE exact_match OR lexical_overlap > 0) SELECT source, evidence_id, exact_match, lexical_overlap, exact_matches FROM r WHERE k <= 3",
    "o2_catalog_rank": "SELECT evidence_id, overlap FROM (SELECT doc_id AS evidence_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', section, title)), '[\\p{L}\\p{N}_]{3,}')), ['cristae', 'remodelling', 'the', 'matrix'])) AS INTEGER) AS overlap FROM documents WHERE title IS NOT NULL) WHERE overlap > 0 ORDER BY overlap DESC, evidence_id LIMIT 25",
    "f6_word_sets": f"SELECT doc_id AS evidence_id, CAST(len({_DOC_WORDS}) AS INTEGER) AS words FROM documents",
    "f7_sentence_spans": r"""
WITH p AS (SELECT doc_id, length(regexp_extract(text, '^[.!?。！？]*')) AS lead, regexp_extract_all(text, '[^.!?。！？]+(?:[.!?。！？]+|$)') AS ps FROM documents),
e AS (SELECT doc_id, lead, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM p),
o AS (SELECT doc_id, k, piece, lead + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM e),
b AS (SELECT doc_id, k, e, regexp_replace(piece, '^[\s\x{0B}\x{85}\p{Z}]+', '') AS bare FROM o)
SELECT doc_id AS evidence_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS "index", CAST(e - length(bare) AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, sha256(bare) AS hash FROM b WHERE length(bare) > 0""",
    "f7_span_counts": r"SELECT source, CAST(sum(n) AS BIGINT) AS statements, CAST(max(n) AS INTEGER) AS most FROM (SELECT source, len(list_filter(regexp_extract_all(text, '[^.!?。！？]+(?:[.!?。！？]+|$)'), lambda x: regexp_replace(x, '[\s\x{0B}\x{85}\p{Z}]', '', 'g') <> '')) AS n FROM documents) GROUP BY 1",
    "proj2_read_status": "SELECT CASE WHEN b.doc_id IS NULL THEN 'unavailable_in_authorized_snapshot' ELSE 'ok' END AS status, count(*) AS requests FROM (SELECT paper_id, doc_id + doc_id % 2 AS d FROM documents WHERE paper_id IS NOT NULL) a LEFT JOIN documents b ON a.paper_id = b.paper_id AND a.d = b.doc_id GROUP BY 1",
    "f14_triples": "SELECT event_id, 'u' || user_id AS head, event_type AS relation, props AS tail FROM events",
    "s15_csv_cells": """SELECT doc_id, '"' || replace(CASE WHEN regexp_matches(coalesce(title, ''), '^[=+\\-@]') THEN '''' || title ELSE coalesce(title, '') END, '"', '""') || '"' AS title,
sha256('"' || replace(CASE WHEN regexp_matches(coalesce(text, ''), '^[=+\\-@]') THEN '''' || text ELSE coalesce(text, '') END, '"', '""') || '"') AS text, '"''=' || source || '"' AS source FROM documents""",
    "s17_script_safe": "SELECT DISTINCT record_id, sha256(replace(replace(replace(replace(replace(body, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'), chr(8232), '\\u2028'), chr(8233), '\\u2029')) AS hash FROM raw_records",
    "s18_public_files": "SELECT DISTINCT id, metadata.original_record.file AS file, metadata.split AS split, true AS unchanged FROM verifier_records",
    "o4_natural_order": "SELECT DISTINCT question_id, lower(split_part(question_id, '-', 1)) || '-' || lpad(regexp_replace(split_part(question_id, '-', 2), '^0+(.)', '\\1'), 20, '0') || '-' || lpad(regexp_replace(split_part(question_id, '-', 3), '^0+(.)', '\\1'), 20, '0') AS sort_key FROM pilot_5_questions",
}
