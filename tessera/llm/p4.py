"""Problem 4: planner records of dev or test that also occur in train."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.overlaps import overlapping_records, split_overlaps, split_side
from tessera.llm.roles import speaker
from tessera.llm.suffixes import shared_spans
from tessera.session import table


def _spoken(df: DataFrame) -> DataFrame:
    said = F.filter("messages", lambda m: speaker(m["role"]).isin("user", "assistant") & m["content"].isNotNull())
    return df.select("id", "split", F.array_join(F.transform(said, lambda m: m["content"]), "\n").alias("text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlaps(_spoken(table(spark, sf_dir, "planner_sft"))).select("id_a", "id_b")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dev and test rows that occur in train, with task and how much of them does."""
    rows = table(spark, sf_dir, "planner_sft")
    hits = overlapping_records(_spoken(rows)).where("side = 'held_out'").select("id", "class", F.col("others").alias("train_rows"), "coverage")
    held_out = rows.where(split_side(F.col("split")) == 2).select("id", "split", "target_provenance", "task_id").dropDuplicates(["id"])
    return held_out.join(hits, "id")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and provenance: rows, rows that occur in train, and the tasks these belong to."""
    rows = table(spark, sf_dir, "planner_sft").where(split_side(F.col("split")) == 2).select("id", "split", "target_provenance").dropDuplicates(["id"])
    hits = records(spark, sf_dir).select("id", "task_id", F.lit(1).alias("hit"))
    return rows.join(hits, "id", "left").groupBy("split", "target_provenance").agg(F.count("*").alias("held_out_rows"), F.count("hit").alias("overlapping_rows"), F.count_distinct("task_id").alias("tasks"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dev and test rows with the words of theirs that stand in spans which train rows have."""
    return shared_spans(_spoken(table(spark, sf_dir, "planner_sft"))).select("id", "words", "covered", "longest", F.round("coverage", 9).alias("coverage"))


def span_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and provenance: rows, their words, those in shared spans, and rows of which three quarters are."""
    rows = table(spark, sf_dir, "planner_sft").where(split_side(F.col("split")) == 2).select("id", "split", "target_provenance").dropDuplicates(["id"])
    return rows.join(spans(spark, sf_dir), "id").groupBy("split", "target_provenance").agg(F.count("*").alias("held_out_rows"), F.sum("words").alias("words"), F.sum("covered").alias("covered"), F.count_if(F.col("coverage") >= 0.75).alias("mostly_covered"))


QUERIES = {"p4_found": found, "p4_records": records, "p4_report": report, "p4_spans": spans, "p4_span_report": span_report}
_SPANS = """
WITH r AS (SELECT DISTINCT ON (id) id, CASE WHEN split = 'train' THEN 1 WHEN split IN ('dev', 'test') THEN 2 END AS side, lower(array_to_string(list_transform(list_filter(messages, lambda m: m.content IS NOT NULL AND lower(regexp_replace(m.role, '^\\s+|\\s+$', '', 'g')) IN ('user', 'human', '用户', 'assistant', 'ai', 'bot', 'model', '助手')), lambda m: m.content), chr(10))) AS t FROM planner_sft WHERE split IS NOT NULL),
w AS (SELECT id, side, regexp_extract_all(regexp_replace(t, '(\\p{Han})', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w FROM r WHERE side IS NOT NULL AND t IS NOT NULL),
k AS (SELECT id, side, w, len(w) AS n FROM w WHERE len(w) > 0),
g AS (SELECT id, side, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, side, w, unnest(range(1, n - 3)) AS i FROM k WHERE n >= 5)),
b AS (SELECT DISTINCT g FROM g WHERE side = 1), c AS (SELECT DISTINCT array_to_string(w, ' ') AS whole FROM k WHERE side = 1),
p AS (SELECT DISTINCT id, unnest(range(i, i + 5)) AS pos FROM g WHERE side = 2 AND g IN (SELECT g FROM b) UNION SELECT id, unnest(range(1, n + 1)) FROM k WHERE side = 2 AND array_to_string(w, ' ') IN (SELECT whole FROM c)),
o AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM p),
l AS (SELECT id, sum(m) AS covered, max(m) AS longest FROM (SELECT id, island, count(*) AS m FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT k.id, CAST(n AS INTEGER) AS words, CAST(coalesce(covered, 0) AS INTEGER) AS covered, CAST(coalesce(longest, 0) AS INTEGER) AS longest, round(coalesce(covered, 0) / n, 9) AS coverage FROM k LEFT JOIN l ON l.id = k.id WHERE side = 2"""
ORACLES = {
    "p4_spans": _SPANS,
    "p4_span_report": f"SELECT split, target_provenance, count(*) AS held_out_rows, CAST(sum(words) AS BIGINT) AS words, CAST(sum(covered) AS BIGINT) AS covered, count(*) FILTER (coverage >= 0.75) AS mostly_covered FROM (SELECT DISTINCT ON (id) id, split, target_provenance FROM planner_sft) JOIN ({_SPANS}) USING (id) GROUP BY 1, 2",
}
