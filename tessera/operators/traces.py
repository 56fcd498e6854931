"""Traces: steps in order, running sums, hash chains, histories, coverage and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_order(steps: DataFrame, trace: str, step: str) -> DataFrame:
    """``steps`` with ``in_place`` (its number is its place, from 0) and ``terminal`` (none follows)."""
    w = Window.partitionBy(trace).orderBy(step)
    return steps.withColumn("in_place", F.row_number().over(w) - 1 == F.col(step)).withColumn("terminal", F.lead(step).over(w).isNull())


def running(steps: DataFrame, trace: str, step: str, sums: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """``steps`` with running sums, and flags that stay set once they were."""
    w = Window.partitionBy(trace).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    out = steps
    for name, value in sums.items():
        out = out.withColumn(name, F.sum(value).over(w))
    for name, value in flags.items():
        out = out.withColumn(name, F.max(F.coalesce(value, F.lit(False))).over(w))
    return out


def within_budget(steps: DataFrame, trace: str, most: int) -> DataFrame:
    """The steps of traces of at most ``most`` steps; longer traces are left out whole."""
    few = steps.groupBy(trace).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(trace)
    return steps.join(few, trace, "left_semi")


def without_overlong(steps: DataFrame, trace: str, too_long: Column) -> DataFrame:
    """The steps of traces none of which is too long; nothing is cut."""
    bad = steps.where(too_long).select(trace).distinct()
    return steps.join(bad, trace, "left_anti")


def hash_chain(steps: DataFrame, trace: str, step: str, payload: Column, seed: Column) -> DataFrame:
    """(trace, n, chain): the hash over all steps in order, each over the one before and its payload.

    A fold over the sorted steps of a trace: a chain can't be split, so a trace
    has to fit in memory as payloads.
    """
    rows = steps.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("k"), payload.alias("p")))).alias("_s"), F.first(seed).alias("_seed"))
    link = lambda h, x: F.sha2(F.concat(F.lit('{"previous":"'), h, F.lit('","step":'), x["p"], F.lit("}")), 256)
    return rows.select(trace, F.size("_s").alias("n"), F.aggregate("_s", F.sha2("_seed", 256), link).alias("chain"))


def histories(steps: DataFrame, trace: str, step: str, length: Column) -> DataFrame:
    """``steps`` with ``history_chars`` and ``history_steps``: what went before, not this step."""
    w = Window.partitionBy(trace).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("history_chars", F.coalesce(F.sum(length).over(w), F.lit(0))).withColumn("history_steps", F.count("*").over(w))


def repairs(steps: DataFrame, trace: str, step: str, valid: Column, action: Column) -> DataFrame:
    """(trace, opportunities, repaired): invalid actions, and whether a later valid one differs from the last invalid one before it."""
    w = Window.partitionBy(trace).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~valid, action), ignorenulls=True).over(w)
    rows = steps.withColumn("_valid", valid).withColumn("_action", action).withColumn("_last", last)
    return rows.groupBy(trace).agg(F.count_if(~F.col("_valid")).alias("opportunities"), F.bool_or(F.col("_valid") & F.col("_last").isNotNull() & (F.col("_action") != F.col("_last"))).alias("repaired"))


def coverage(kept: DataFrame, full: DataFrame, trace: str, step: str, attributes: Sequence[str]) -> DataFrame:
    """(trace, attributes..., expected, retained, missing, terminal_retained, complete) of every trace of ``full``.

    Steps are told by their numbers; a trace without any kept step is in it.
    """
    have = kept.select(trace, step).distinct().withColumn("_have", F.lit(1))
    rows = full.select(trace, step, *attributes).dropDuplicates([trace, step]).join(have, [trace, step], "left")
    return rows.groupBy(trace).agg(
        *(F.min(a).alias(a) for a in attributes),
        F.count("*").alias("expected"), F.count("_have").alias("retained"),
        F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col(step)))).alias("missing"),
        F.max_by(F.col("_have").isNotNull(), step).alias("terminal_retained"), (F.count("*") == F.count("_have")).alias("complete"),
    )


def coverage_by(traces: DataFrame, *by: str) -> DataFrame:
    """(by..., traces, retained_steps, any_step, with_terminal, complete, excluded)"""
    return traces.groupBy(*by).agg(F.count("*").alias("traces"), F.sum("retained").alias("retained_steps"), F.count_if(F.col("retained") > 0).alias("any_step"), F.count_if("terminal_retained").alias("with_terminal"), F.count_if("complete").alias("complete"), F.count_if(F.col("retained") == 0).alias("excluded"))


def pair_coverage(traces: DataFrame, tasks: DataFrame, pair: str = "pair_id", task: str = "task_id", side: str = "side") -> DataFrame:
    """(pair, sides, both_terminal, both_complete): whether all sides of a pair are covered."""
    per = traces.groupBy(task).agg(F.bool_or("terminal_retained").alias("_t"), F.bool_or("complete").alias("_c"))
    rows = tasks.where(F.col(pair).isNotNull()).join(per, task, "left")
    two = (F.count("*") == 2) & (F.count_distinct(side) == 2)
    yes = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return rows.groupBy(pair).agg(F.array_sort(F.collect_set(side)).alias("sides"), (two & yes(F.col("_t"))).alias("both_terminal"), (two & yes(F.col("_c"))).alias("both_complete"))


def with_variants(tasks: DataFrame, first: DataFrame, keys: Sequence[str], id: str, variant: str, name: str) -> DataFrame:
    """``tasks`` and, once more under a new id and ``name``, those whose keys ``first`` has."""
    derived = tasks.join(first.select(*keys).distinct(), list(keys), "left_semi").withColumn(variant, F.lit(name)).withColumn(id, F.concat(F.col(id), F.lit(f"-{name}")))
    return tasks.unionByName(derived.select(*tasks.columns))


# ---- token rows ----


def masked(prompt: Column, completion: Column, end: int, ignore: int = -100) -> Column:
    """struct<input, labels, attention>: the prompt's labels ignored, exactly one end token."""
    closed = F.when(F.try_element_at(completion, F.lit(-1)) == end, completion).otherwise(F.concat(completion, F.array(F.lit(end))))
    whole = F.concat(prompt, closed)
    return F.struct(whole.alias("input"), F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), closed).alias("labels"), F.array_repeat(F.lit(1), F.size(whole)).alias("attention"))


def padded(rows: DataFrame, batch: Sequence[str], column: str, pad: int) -> DataFrame:
    """``column`` padded on the right to the width of its batch."""
    width = F.max(F.size(column)).over(Window.partitionBy(*batch))
    return rows.withColumn(column, F.concat(column, F.array_repeat(F.lit(pad), width - F.size(column))))
