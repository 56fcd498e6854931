"""Annotation records: flags, counters, links between datasets, filters and shares."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered
from tessera.functions.numeric import ratio


def flags(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))


def counter(rows: DataFrame, value: str, unknown: str = "unknown") -> DataFrame:
    """(value, n): how often each value occurs, null as ``unknown``, booleans as True and False."""
    text = F.col(value).cast("string")
    if dict(rows.dtypes)[value] == "boolean":
        text = F.initcap(text)
    return rows.groupBy(F.coalesce(text, F.lit(unknown)).alias(value)).agg(F.count("*").alias("n"))


def ranked_counter(rows: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """(name, n, rank) over the members of arrays: most frequent first, of equals by name."""
    counts = rows.select(F.explode(values).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return numbered(counts, F.desc("n"), F.asc(name), name="_place").withColumn("rank", (F.col("_place") + 1).cast("int")).drop("_place")


def length_sum(column: str) -> Column:
    """The members of an array column over all rows; a null array has none, though it is not empty."""
    return F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.size(column))), F.lit(0)).cast("long")


def filled(column: str) -> Column:
    """How many rows have a member in an array column."""
    return F.count_if(F.coalesce(F.size(column), F.lit(0)) > 0)


def linked(rows: DataFrame, id: str, refs: Column, others: DataFrame, other_id: str, key: str) -> DataFrame:
    """(id, other_id, ref): each resolved reference, once."""
    named = rows.select(id, F.explode(F.array_distinct(refs)).alias("ref")).where("ref IS NOT NULL")
    return named.join(others.select(F.col(key).alias("ref"), other_id).where("ref IS NOT NULL"), "ref").select(id, other_id, "ref")


def link_counts(rows: DataFrame, refs: Column, others: DataFrame, key: str) -> DataFrame:
    """(occurrences, distinct_refs, resolvable): resolvable counts occurrences, not distinct references."""
    flat = rows.select(F.explode(refs).alias("ref")).where("ref IS NOT NULL")
    per = flat.groupBy("ref").agg(F.count("*").alias("n"))
    known = others.select(F.col(key).alias("ref")).where("ref IS NOT NULL").distinct().withColumn("known", F.lit(1))
    return per.join(known, "ref", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count("*").alias("distinct_refs"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("resolvable"))


def faceted(records: DataFrame, *, dataset: str | None = None, status: str | None = None, flagged: bool = False, preset: Column | None = None, query: str | None = None) -> DataFrame:
    """The records that pass all the filters given; a query is looked for in search_text, in the same form."""
    out = records
    if dataset:
        out = out.where(F.col("dataset") == dataset)
    if status:
        out = out.where(F.col("status") == status)
    if flagged:
        out = out.where(F.size("flags") > 0)
    if preset is not None:
        out = out.where(preset)
    if query and query.strip():
        out = out.where(F.contains("search_text", F.lit(unicodedata.normalize("NFKC", query.strip()).casefold())))
    return out


def shares(rows: DataFrame, by: Sequence[str], part: str, n: str = "n") -> DataFrame:
    """``rows`` with ``share``: the part of its group's total, 0 where that is 0."""
    return rows.withColumn("share", F.coalesce(ratio(F.col(n), F.sum(n).over(Window.partitionBy(*by))), F.lit(0.0)))
