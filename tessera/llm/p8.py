"""Problem 8: documents that hold passages of held-out evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.leaks import text_leaks
from tessera.session import table


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "item_id")


def mostly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks that cover half of an item or more, in whatever order its parts come."""
    return text_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_coverage=0.5)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out item: how many documents hold part of it, and how much the fullest one holds."""
    held = table(spark, sf_dir, "eval_items").select("item_id", "split", "task_kind").distinct()
    hits = leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest").alias("longest"), F.max(F.col("covered") / F.col("item_size")).alias("coverage"))
    return held.join(hits, "item_id")


QUERIES = {"p8_found": found, "p8_leaks": leaks, "p8_mostly": mostly, "p8_items": items}
_RUN = "array_to_string(list_slice(w, i, i + 11), ' ')"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
ORACLES = {
    "p8_found": f"""
WITH p AS (SELECT DISTINCT item_id, lang, t FROM (SELECT item_id, lang, passage AS t FROM eval_items UNION ALL SELECT item_id, lang, question FROM eval_items) WHERE t IS NOT NULL),
pw AS (SELECT item_id, lang, {_WORDS.format('t')} AS w FROM p), dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
pg AS (SELECT DISTINCT item_id, {_RUN} AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM pw)),
dg AS (SELECT DISTINCT doc_id, {_RUN} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
pc AS (SELECT DISTINCT item_id, substr(c, i, 30) AS g FROM (SELECT item_id, c, unnest(range(1, length(c) - 28)) AS i FROM (SELECT item_id, array_to_string(w, '') AS c FROM pw WHERE lang = 'zh'))),
dc AS (SELECT DISTINCT doc_id, substr(c, i, 30) AS g FROM (SELECT doc_id, c, unnest(range(1, length(c) - 28)) AS i FROM (SELECT doc_id, array_to_string(w, '') AS c FROM dw)))
SELECT doc_id, item_id FROM dg JOIN pg USING (g) UNION SELECT doc_id, item_id FROM dc JOIN pc USING (g)""",
}
