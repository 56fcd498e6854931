"""Problem 1: verifier records whose completion does not answer its prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pairs import broken_pairs
from tessera.llm.roles import speaker
from tessera.session import table


def _texts(messages: str, *who: str):
    kept = F.filter(messages, lambda m: m["content"].isNotNull() & (speaker(m["role"]).isin(*who) if who else F.lit(True)))
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of each broken record."""
    return broken_pairs(table(spark, sf_dir, "verifier_records"), "id", _texts("prompt", "user"), _texts("completion"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first defect of each broken record, in the order of the rules."""
    return defects(spark, sf_dir).select("id", F.col("defects")[0].alias("defect"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by split and defect, with their share of the split."""
    rows = table(spark, sf_dir, "verifier_records").select("id", F.col("metadata.split").alias("split")).where("id IS NOT NULL").dropDuplicates(["id"])
    total = rows.groupBy("split").agg(F.count("*").alias("records"))
    hits = rows.join(found(spark, sf_dir), "id").groupBy("split", "defect").agg(F.count("*").alias("broken"))
    return hits.alias("h").join(total.alias("t"), F.col("h.split").eqNullSafe(F.col("t.split"))).select("h.split", "defect", "broken", "records", F.round(F.col("broken") / F.col("records"), 6).alias("share"))


QUERIES = {"p1_found": found, "p1_defects": defects, "p1_report": report}
ORACLES: dict[str, str] = {}
