"""Problem 2: tasks in splits that keep related tasks together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.groups import assign_splits, key, related_groups
from tessera.session import table

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def _groups(tasks: DataFrame) -> DataFrame:
    papers = F.transform(F.coalesce("paper_ids", F.array().cast("array<string>")), lambda p: key("paper:", p, fold=True))
    return related_groups(tasks, "id", F.array_compact(F.concat(F.array(key("pair:", F.col("pair_id"))), papers)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose related group now holds two or more splits."""
    tasks = table(spark, sf_dir, "tasks").select("id", "split", "pair_id", "paper_ids")
    groups = _groups(tasks)
    now = tasks.select("id", "split").where("id IS NOT NULL").distinct().join(groups, "id")
    mixed = now.groupBy("group").agg(F.min("split").alias("a"), F.max("split").alias("z")).where("a <> z").select("group")
    return groups.join(mixed, "group", "left_semi").select("id")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task with its group and the split it gets."""
    return assign_splits(_groups(table(spark, sf_dir, "tasks").select("id", "pair_id", "paper_ids")), SHARES)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, tasks and share of each new split."""
    out = splits(spark, sf_dir).groupBy("split").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("tasks"))
    total = out.agg(F.sum("tasks").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("split", "groups", "tasks", F.round(F.col("tasks") / F.col("total"), 6).alias("share"))


QUERIES = {"p2_found": found, "p2_splits": splits, "p2_shares": shares}
ORACLES = {
    "p2_found": """
WITH RECURSIVE t AS (SELECT DISTINCT id, split, pair_id, paper_ids FROM tasks WHERE id IS NOT NULL),
k AS (SELECT id, 'q' || pair_id AS k FROM t WHERE trim(pair_id) <> ''
      UNION SELECT id, 'p' || lower(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) FROM (SELECT id, unnest(paper_ids) AS p FROM t) WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> ''),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a FROM r JOIN t ON t.id = r.b GROUP BY r.a HAVING count(DISTINCT t.split) > 1)
SELECT a AS id FROM m
""",
}
