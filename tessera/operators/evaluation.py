"""Evaluation statistics: success by subgroup, pairs, confusion, F1, lengths and bootstraps."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered
from tessera.functions.numeric import ratio, wilson
from tessera.functions.staging import sized
from tessera.operators.validation import SUPPORT_LABELS, strict_json


def success_summary(rows: DataFrame, by: Sequence[str] = (), task: str = "task_id", success: str = "success") -> DataFrame:
    """(by..., episodes, unique_tasks, successes, success_rate, low, high): the rate is null without episodes."""
    out = rows.groupBy(*by).agg(F.count("*").alias("episodes"), F.count_distinct(task).alias("unique_tasks"), F.count_if(success).alias("successes"))
    w = wilson(F.col("successes"), F.col("episodes"))
    return out.select(*by, "episodes", "unique_tasks", "successes", ratio(F.col("successes"), F.col("episodes")).alias("success_rate"), w["low"].alias("low"), w["high"].alias("high"))


def by_subgroups(rows: DataFrame, subgroups: Mapping[str, Column], task: str = "task_id", success: str = "success") -> DataFrame:
    """The summary of each subgroup; a row may be in several.  One pass and one shuffle for all."""
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in subgroups.items())))
    return success_summary(rows.select(task, success, F.explode(named).alias("subgroup")), ["subgroup"], task, success)


def paired_both(rows: DataFrame, sides: Sequence[str], pair: str = "pair_id", repeat: str = "repeat", side: str = "side", success: str = "success") -> DataFrame:
    """(complete, successes, unique_pairs, unpaired): draws of a pair in which exactly both sides are there, and all of them succeed."""
    want = F.array(*(F.lit(s) for s in sorted(sides)))
    each = rows.groupBy(pair, repeat).agg(F.array_sort(F.collect_set(side)).alias("_sides"), F.bool_and(success).alias("_all"))
    whole = F.col("_sides") == want
    return each.agg(F.count_if(whole).alias("complete"), F.count_if(whole & F.col("_all")).alias("successes"), F.count_distinct(F.when(whole, F.col(pair))).alias("unique_pairs"), F.count_if(~whole).alias("unpaired"))


def over_draws(rows: DataFrame, task: str = "task_id", success: str = "success") -> DataFrame:
    """(task, k, mean_success, any_success): average and best of the draws of a task."""
    return rows.groupBy(task).agg(F.count("*").alias("k"), F.avg(F.col(success).cast("double")).alias("mean_success"), F.bool_or(success).alias("any_success"))


def crossed_pairs(rows: DataFrame, sides: Sequence[str], pair: str = "pair_id", side: str = "side", success: str = "success") -> DataFrame:
    """(pair, paired_success): the share of all combinations of draws of both sides in which both succeed."""
    a, b = (F.avg(F.when(F.col(side) == s, F.col(success).cast("double"))) for s in sides)
    return rows.groupBy(pair).agg((a * b).alias("paired_success")).where("paired_success IS NOT NULL")


def confusion(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str] = SUPPORT_LABELS, invalid: str = "invalid") -> DataFrame:
    """(truth, one column a prediction): a row for every label, zeros where nothing was counted."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], "truth string")
    seen = F.when(F.col(predicted).isin(*labels), F.col(predicted)).otherwise(invalid)
    counts = rows.select(F.col(truth).alias("truth"), seen.alias("_p")).groupBy("truth").pivot("_p", [*labels, invalid]).count()
    return F.broadcast(every).join(counts, "truth", "left").na.fill(0)


def class_scores(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str] = SUPPORT_LABELS, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, support, tp, fp, fn, precision, recall, f1) for every label.

    Precision is 0 where nothing was predicted, recall null where nothing was to
    be found; a prediction that is none of the labels misses its truth.
    """
    both = rows.select(*by, F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), (F.col(truth) == F.col(predicted)).alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), (F.col(truth) == F.col(predicted)).alias("hit")))).alias("x")).select(*by, "x.*")
    hit = F.coalesce("hit", F.lit(False))
    counts = both.where(F.col("label").isin(*labels)).groupBy(*by, "label").agg(F.sum("t").alias("support"), F.count_if((F.col("t") == 1) & hit).alias("tp"), F.count_if((F.col("t") == 0) & ~hit).alias("fp"))
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    if by:
        every = rows.select(*by).distinct().crossJoin(F.broadcast(every))
    out = every.join(counts, [*by, "label"], "left").na.fill(0, ["support", "tp", "fp"]).withColumn("fn", F.col("support") - F.col("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(*by, "label", "support", "tp", "fp", "fn", F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"), ratio(tp, F.col("support")).alias("recall"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def overall_scores(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str] = SUPPORT_LABELS, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, macro_f1_observed, macro_f1_all, unrepresented, false_support, false_support_rate, withheld, withheld_rate, invalid): one row a group.

    unrepresented are the labels that no truth has, joined by commas.
    """
    scores = class_scores(rows, truth, predicted, labels, by)
    macro = scores.groupBy(*by).agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_observed"), F.avg("f1").alias("macro_f1_all"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("support") == 0, F.col("label")))), ",").alias("unrepresented"))
    t, p = F.col(truth), F.coalesce(F.col(predicted), F.lit("invalid"))
    yes, none = labels[0], labels[1]
    plain = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((t == p).cast("double")).alias("accuracy"),
        F.count_if((t != yes) & (p == yes)).alias("false_support"), ratio(F.count_if((t != yes) & (p == yes)), F.count_if(t != yes)).alias("false_support_rate"),
        F.count_if((t == yes) & (p == none)).alias("withheld"), ratio(F.count_if((t == yes) & (p == none)), F.count_if(t == yes)).alias("withheld_rate"),
        F.count_if(~p.isin(*labels)).alias("invalid"),
    )
    return plain.join(macro, list(by)) if by else plain.crossJoin(F.broadcast(macro))


# ---- predictions ----


def class_key(value: Column) -> Column:
    """A VARIANT scalar as JSON text, so that "1" and 1 differ; null for null, objects and arrays."""
    return F.when(~F.schema_of_variant(value).rlike("^(?:OBJECT|ARRAY|VOID)"), F.to_json(value))


def parse_prediction(text: Column, labels: Sequence[str] = SUPPORT_LABELS, field: str = "evidence_support") -> Column:
    """struct<json_valid, label_schema_valid, labels: map<string, string>, error> of a model's answer.

    labels has the JSON text of each label and is empty if the schema does not
    hold: an object ``labels`` whose ``field`` is one of the labels.  error is
    json or labels, null where both hold.
    """
    value = strict_json(text)
    held = F.try_variant_get(value, "$.labels", "map<string, variant>")
    fits = F.coalesce(F.try_variant_get(value, f"$.labels.{field}", "string").isin(*labels) & ~F.coalesce(F.array_contains(F.map_keys(held), ""), F.lit(True)), F.lit(False))
    texts = F.transform_values(held, lambda _, v: F.to_json(v))
    none = F.create_map().cast("map<string,string>")
    read = value.isNotNull()
    return F.struct(read.alias("json_valid"), fits.alias("label_schema_valid"), F.when(fits, texts).otherwise(none).alias("labels"), F.when(~read, "json").when(~fits, "labels").alias("error"))


def valid_rates(rows: DataFrame, prediction: str, truncated: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, json_valid_rate, label_schema_valid_rate, truncated) of parsed predictions."""
    p = F.col(prediction)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(p["json_valid"].cast("double")).alias("json_valid_rate"), F.avg(p["label_schema_valid"].cast("double")).alias("label_schema_valid_rate"), F.count_if(truncated).alias("truncated"))


def field_scores(rows: DataFrame, target: Column, predicted: Column, valid: Column, closed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(field, evaluated, not_applicable, non_scalar, missed, accuracy, macro_f1, absent_classes, macro_f1_all): agreement of label maps, field by field.

    ``target`` and ``predicted`` are map<string, string> of JSON texts, as of
    ``parse_prediction``.  A null or absent target is not applicable, an object
    or array not scored; an invalid or absent prediction is a miss.  Macro F1
    runs over the labels that targets have.  A field in ``closed`` also has the
    labels that no target has, joined by commas, and the macro F1 over all of them.
    """
    scalar = lambda t: F.when(~t.rlike(r"^(?:null$|[\[{])"), t)
    total = rows.agg(F.count("*").alias("_rows"))
    long = rows.select(F.explode(target).alias("field", "_t"), predicted.alias("_p"), valid.alias("_v")).where("_t IS NOT NULL AND _t <> 'null'")
    long = long.select("field", scalar(F.col("_t")).alias("truth"), F.when(F.col("_v"), scalar(F.try_element_at("_p", F.col("field")))).alias("guess"))
    pairs = long.groupBy("field", "truth", "guess").count()
    known = F.col("truth").isNotNull()
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).cast("long")
    plain = pairs.groupBy("field").agg(n(known).alias("evaluated"), n(~known).alias("non_scalar"), n(known & F.col("guess").isNull()).alias("missed"), n(F.col("truth") == F.col("guess")).alias("_hits"))
    sides = pairs.where(known).select("field", "count", F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.col("truth").eqNullSafe(F.col("guess")).alias("hit")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(False).alias("hit")))).alias("x")).select("field", "count", "x.*").where("label IS NOT NULL")
    per = sides.groupBy("field", "label").agg(n(F.col("t") == 1).alias("support"), n(F.col("hit")).alias("tp"), n(F.col("t") == 0).alias("said"))
    per = per.withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), F.col("support") + F.col("said")), F.lit(0.0)))
    every = F.create_map(*(x for f, ls in (closed or {}).items() for x in (F.lit(f), F.array(*(F.lit(json.dumps(v)) for v in ls))))) if closed else F.lit(None).cast("map<string,array<string>>")
    there = F.when(F.col("support") > 0, F.col("label"))
    macro = per.withColumn("_all", every[F.col("field")]).groupBy("field").agg(
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), F.collect_set(there).alias("_there"), F.first("_all").alias("_all"),
        F.sum(F.when(F.array_contains("_all", F.col("label")), F.col("f1"))).alias("_sum"),
    )
    absent = F.array_join(F.array_sort(F.transform(F.array_except("_all", "_there"), lambda x: F.regexp_replace(x, '^"|"$', ""))), ",")
    out = plain.join(macro, "field", "left").crossJoin(F.broadcast(total))
    return out.select("field", "evaluated", (F.col("_rows") - F.col("evaluated") - F.col("non_scalar")).alias("not_applicable"), "non_scalar", "missed", ratio(F.col("_hits"), F.col("evaluated")).alias("accuracy"), "macro_f1", absent.alias("absent_classes"), (F.col("_sum") / F.size("_all")).alias("macro_f1_all"))


def predicted_distribution(rows: DataFrame, predicted: str, labels: Sequence[str] = SUPPORT_LABELS, invalid: str = "invalid") -> DataFrame:
    """(prediction, n): how often each label was predicted, 0 included; what is no label is ``invalid``."""
    every = rows.sparkSession.createDataFrame([(x,) for x in (*labels, invalid)], "prediction string")
    counts = rows.groupBy(F.when(F.col(predicted).isin(*labels), F.col(predicted)).otherwise(invalid).alias("prediction")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "prediction", "left").na.fill(0, ["n"])


def cost_totals(rows: DataFrame, costs: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., one sum a cost): what episodes cost; nulls cost nothing, no episodes cost 0."""
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in costs.items()))


def pair_faults(a: DataFrame, b: DataFrame, id: str, *fields: str) -> DataFrame:
    """(id, fault): what forbids comparing two prediction tables: repeated ids, ids of one table alone, and fields that differ, by name.

    Both tables must judge the same objects; nothing is silently left out.
    """
    count = lambda t: t.groupBy(id).agg(F.count("*").alias("n"), F.first(F.struct(*fields)).alias("x"))
    both = count(a).alias("a").join(count(b).alias("b"), id, "full")
    named = [F.when(~F.col(f"a.x.{f}").eqNullSafe(F.col(f"b.x.{f}")), F.lit(f)) for f in fields]
    faults = F.when(F.col("a.n").isNull(), F.array(F.lit("not_in_a"))).when(F.col("b.n").isNull(), F.array(F.lit("not_in_b"))).otherwise(F.array_compact(F.array(F.when((F.col("a.n") > 1) | (F.col("b.n") > 1), F.lit("repeated")), *named)))
    return both.select(id, F.explode(faults).alias("fault"))


def majority(rows: DataFrame, label: str, position: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n): the most frequent label; of equals the one met first, by ``position``."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    best = F.min_by(F.struct(F.col(label).alias("label"), F.col("n")), F.struct(-F.col("n"), F.col("_first")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def length_report(rows: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., records, total, shortest, median, p95, longest): the upper median and the nearest-rank 95th percentile.

    The two ranks come from counts of each length, cumulated by a window over
    the distinct lengths, so that no group's rows are gathered.
    """
    counts = rows.where(F.col(length).isNotNull()).groupBy(*by, length).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(length)
    sums = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda rank: F.min(F.when(F.col("_to") >= rank, F.col(length)))
    return sums.groupBy(*by).agg(F.max("_n").alias("records"), F.sum(F.col(length) * F.col("_c")).alias("total"), F.min(length).alias("shortest"), at(F.floor(F.col("_n") / 2) + 1).alias("median"), at(F.ceil(F.col("_n") * 0.95)).alias("p95"), F.max(length).alias("longest"))


def _drawn(clusters: DataFrame, n: int, samples: int, seed: int) -> DataFrame:
    """The rows of ``clusters`` (numbered by k) as drawn with replacement, n for each sample.

    A draw is the MD5 of seed and slot, which any engine can repeat.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 15)
    slots = clusters.sparkSession.range(samples * n).select(F.floor(F.col("id") / n).alias("sample"), F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n)).alias("k"))
    return slots.join(sized(clusters, n), "k")


def group_bootstrap(rows: DataFrame, cluster: str, value: str, samples: int = 2000, seed: int = 20260909) -> DataFrame:
    """(clusters, point, low, high): percentile interval of a pooled mean, whole clusters drawn with replacement.

    Clusters are summed first; a draw is a hash of (seed, sample, slot), so the
    interval is the same on every run and machine.  Bounds are null for fewer
    than two clusters.  Every sample is one row of sums, made from the sums of
    the clusters drawn.
    """
    sums = rows.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("c"))
    clusters = numbered(sums, F.col(cluster), name="k")
    n = clusters.count()
    point = sums.agg(ratio(F.sum("s"), F.sum("c")).alias("point"))
    if n < 2:
        return point.select(F.lit(n).cast("long").alias("clusters"), "point", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    means = _drawn(clusters, n, samples, seed).groupBy("sample").agg(ratio(F.sum("s"), F.sum("c")).alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("ms"))  # of length samples
    low, high = int(samples * 0.025) - 1, int(samples * 0.975) - 1
    return ordered.crossJoin(F.broadcast(point)).select(F.lit(n).cast("long").alias("clusters"), "point", F.col("ms")[low].alias("low"), F.col("ms")[high].alias("high"))


def macro_f1_bootstrap(rows: DataFrame, cluster: str, truth: str, a: str, b: str, samples: int = 2000, seed: int = 20260908, labels: Sequence[str] = SUPPORT_LABELS) -> DataFrame:
    """(clusters, point, low, high): percentile interval of the macro F1 of ``b`` less that of ``a``.

    Whole clusters are drawn as in ``group_bootstrap``; macro F1 runs over the
    labels that a sample's truths have.  Rows without a cluster or of another
    truth take no part.  Bounds are null for fewer than two clusters.
    """
    counts = {}
    for k, label in enumerate(labels):
        true = F.col(truth) == label
        counts |= {f"n{k}": true} | {f"{x}{k}_{what}": test for x, p in (("a", a), ("b", b)) for what, test in (("tp", true & (F.col(p) == label)), ("said", F.col(p) == label))}
    rows = rows.where(F.col(cluster).isNotNull() & F.col(truth).isin(*labels))
    clusters = numbered(rows.groupBy(cluster).agg(*(F.count_if(test).alias(name) for name, test in counts.items())), F.col(cluster), name="k")
    n = clusters.count()
    seen = sum((F.col(f"n{k}") > 0).cast("int") for k in range(len(labels)))
    f1 = lambda x: sum(F.when(F.col(f"n{k}") > 0, 2 * F.col(f"{x}{k}_tp") / (F.col(f"n{k}") + F.col(f"{x}{k}_said"))).otherwise(0.0) for k in range(len(labels)))
    change = ratio(f1("b") - f1("a"), seen)
    total = [F.sum(name).alias(name) for name in counts]
    point = clusters.agg(*total).select(change.alias("point"))
    if n < 2:
        return point.select(F.lit(n).cast("long").alias("clusters"), "point", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    ordered = _drawn(clusters, n, samples, seed).groupBy("sample").agg(*total).agg(F.sort_array(F.collect_list(change)).alias("ms"))  # of length samples
    low, high = int((samples - 1) * 0.025), int((samples - 1) * 0.975)
    return ordered.crossJoin(F.broadcast(point)).select(F.lit(n).cast("long").alias("clusters"), "point", F.col("ms")[low].alias("low"), F.col("ms")[high].alias("high"))


def changed_after_feedback(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``changed``: whether two episodes go different ways after, and only after, what they observed differs.

    ``a`` and ``b`` are columns struct<initial, success, actions: array, observations:
    array>.  Both must succeed from the same initial state, act alike up to and at
    the first different observation, and then go on, differently.
    """
    steps = F.sequence(F.lit(1), F.least(*(F.size(F.col(f"{x}.{y}")) for x in (a, b) for y in ("actions", "observations"))))
    unlike = lambda what: F.array_min(F.filter(steps, lambda i: (i > 0) & ~F.try_element_at(F.col(f"{a}.{what}"), i).eqNullSafe(F.try_element_at(F.col(f"{b}.{what}"), i))))
    fork, split_ = unlike("observations"), unlike("actions")
    rest = lambda x: F.slice(F.col(f"{x}.actions"), fork + 1, F.greatest(F.size(F.col(f"{x}.actions")) - fork, F.lit(0)))
    same_before = split_.isNull() | (split_ > fork)
    began = (F.col(f"{a}.initial") == F.col(f"{b}.initial")) & F.col(f"{a}.success") & F.col(f"{b}.success")
    return pairs.withColumn("changed", F.coalesce(began & fork.isNotNull() & same_before & (F.size(rest(a)) > 0) & (F.size(rest(b)) > 0) & (rest(a) != rest(b)), F.lit(False)))
