"""Problem 9: documents mixed so that each source has its share of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.session import table


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their tokens and how often each is used."""
    return _mixture(spark, sf_dir)[0].where("repeats > 0").withColumnRenamed("domain", "source")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.shares(*_mixture(spark, sf_dir)).withColumnRenamed("domain", "source")


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the classifier for unlabelled documents tells the sources of a held-out fifth of the documents."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("source").alias("domain"), F.expr("pmod(xxhash64(doc_id), 5) = 0").alias("unseen"))
    names = sorted(r[0] for r in docs.select("domain").distinct().collect())
    model = mixing.word_model(docs.where("NOT unseen"), names)
    got = mixing.posteriors(docs.where("unseen"), model, "doc_id", "text").join(docs.where("unseen").select("doc_id", "domain"), "doc_id")
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int"))
    return got.groupBy("domain").agg(F.count("*").alias("documents"), F.count_if(best == F.col("domain")).alias("told")).withColumnRenamed("domain", "source")


QUERIES = {"p9_mixture": mixed, "p9_shares": shares, "p9_posteriors": posteriors}
ORACLES: dict[str, str] = {}
