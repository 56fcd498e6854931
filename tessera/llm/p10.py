"""Problem 10: documents that are not, or not wholly, real content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.residue import residue_documents, train
from tessera.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with residue, its kinds and its share of the text."""
    return residue_documents(table(spark, sf_dir, "documents"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, and those left when the ones with residue are taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(found(spark, sf_dir).withColumn("out", F.lit(1)), "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("out").isNull()).alias("kept"))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the fitted model does on segments of unseen sources."""
    report = train(table(spark, sf_dir, "documents")).report
    return spark.createDataFrame(sorted(report.items()), "measure string, value double")


QUERIES = {"p10_found": found, "p10_documents": documents, "p10_clean": clean, "p10_validation": validation}
ORACLES: dict[str, str] = {}
