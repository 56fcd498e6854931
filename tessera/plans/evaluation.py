"""Queries of the evaluation operators.

Judged rows are the verifier records: the truth is the support label of a
completion's JSON, the base and tuned predictions follow from hashes of the id.
Episodes are the planner rows: a step succeeds by its input's length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.session import table

SIDES = ("available", "view_without_target")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, task_id, version, truth, base, tuned, position, length)"""
    rows = table(spark, sf_dir, "verifier_records").dropDuplicates(["id"])
    content = F.get("completion", F.lit(0))["content"]
    truth = F.get_json_object(content, "$.labels.evidence_support")
    rows = rows.where(truth.isin(*ev.SUPPORT_LABELS)).select("id", "task_id", F.col("metadata.annotation_version").alias("version"), truth.alias("truth"), F.length(content).alias("length"))
    d = lambda k: F.conv(F.substring(F.sha2("id", 256), k, 2), 16, 10).cast("int")
    other = lambda k: F.element_at(F.array(*(F.lit(x) for x in (*ev.SUPPORT_LABELS, "invalid"))), d(k) % 5 + 1)
    return rows.select("*", F.when(d(1) < 150, F.col("truth")).otherwise(other(3)).alias("base"), F.when(d(5) < 180, F.col("truth")).otherwise(other(7)).alias("tuned"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, task_id, pair_id, side, repeat, kind, variant, success, calls)"""
    steps = table(spark, sf_dir, "planner_sft").dropDuplicates(["id"]).select("id", "task_id", F.col("trace_step_index").alias("repeat"), (F.col("input_char_count") % 3 != 0).alias("success"), F.coalesce(F.size("messages"), F.lit(-1)).alias("calls"))
    tasks = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).select(F.col("id").alias("task_id"), "pair_id", "side", F.col("task_kind").alias("kind"), "variant")
    return steps.join(tasks, "task_id")


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.success_summary(episodes(spark, sf_dir)), "success_rate", "low", "high")


def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"answerable": F.col("side") == SIDES[0], "missing_in_authorized_view": F.col("side") == SIDES[1], "repair_setup": F.col("variant") == "tool_error_repair", "observed_tool_error": F.col("calls") == 1, "text": F.col("kind") == "text_evidence", "numeric": F.col("kind") == "finite_metric"}
    return _r(ev.by_subgroups(episodes(spark, sf_dir), tests), "success_rate", "low", "high")


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.paired_both(episodes(spark, sf_dir).where("pair_id IS NOT NULL AND repeat IS NOT NULL"), SIDES)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.over_draws(episodes(spark, sf_dir)), "mean_success")


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.crossed_pairs(episodes(spark, sf_dir).where("pair_id IS NOT NULL"), SIDES), "paired_success")


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What steps cost by kind of task: messages stand for calls, blank ones for invalid calls, characters for tokens."""
    steps = table(spark, sf_dir, "planner_sft").dropDuplicates(["id"])
    tasks = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).select(F.col("id").alias("task_id"), F.col("task_kind").alias("kind"))
    said = F.coalesce("messages", F.array().cast(dict(steps.dtypes)["messages"]))
    how_many = lambda test: F.size(F.filter(said, lambda m: F.coalesce(test(m), F.lit(False))))
    chars = lambda role: F.aggregate(F.filter(said, lambda m: m["role"] == role), F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    costs = {
        "calls": F.size(said), "invalid_calls": how_many(lambda m: m["content"].isNull() | (F.trim(m["content"]) == "")), "action_attempts": how_many(lambda m: m["role"] == "assistant"),
        "rule_interventions": F.col("expert_trajectory").cast("int"), "prompt_chars": F.col("input_char_count"), "completion_chars": chars("assistant"), "wall_seconds": F.unix_seconds("ingested_at") - F.unix_seconds("created_at"),
    }
    rows = table(spark, sf_dir, "planner_sft").groupBy("id").agg(F.min("ingested_at").alias("ingested_at"))
    return ev.cost_totals(steps.drop("ingested_at").join(rows, "id").join(tasks, "task_id"), costs, ["kind"])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(judged(spark, sf_dir), "truth", "base")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.class_scores(judged(spark, sf_dir), "truth", "base"), "precision", "recall", "f1")


_OVERALL = ("accuracy", "macro_f1_observed", "macro_f1_all", "false_support_rate", "withheld_rate")


def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.overall_scores(judged(spark, sf_dir), "truth", "base"), *_OVERALL)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.predicted_distribution(judged(spark, sf_dir), "base")


def overall_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.overall_scores(judged(spark, sf_dir), "truth", "tuned", by=["version"]), *_OVERALL)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split, text, parsed): verifier answers, parsed."""
    rows = table(spark, sf_dir, "verifier_records").dropDuplicates(["id"])
    text = F.get("completion", F.lit(0))["content"]
    return rows.select("id", F.col("metadata.split").alias("split"), text.alias("text"), ev.parse_prediction(text).alias("parsed"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every field against predictions made of them: a quarter unknown, a sixteenth of the records invalid."""
    d = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    rows = _answers(spark, sf_dir).where("parsed.label_schema_valid").withColumn("d", d).where("d % 7 <> 3 OR parsed.labels['evidence_support'] <> '\"mixed\"'")
    guess = F.transform_values("parsed.labels", lambda k, v: F.when((F.col("d") + F.length(k)) % 4 == 0, F.lit('"unknown"')).otherwise(v))
    out = ev.field_scores(rows, F.col("parsed.labels"), guess, F.col("d") % 16 != 0, {"evidence_support": ev.SUPPORT_LABELS, "severity": ("none", "minor", "major", "critical", "fatal")})
    return _r(out, "accuracy", "macro_f1", "macro_f1_all")


def class_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels of each field are scalars, as class keys, and how many are none."""
    rows = _answers(spark, sf_dir).select(F.explode(F.try_variant_get(F.try_parse_json("text"), "$.labels", "map<string, variant>")).alias("field", "v"))
    return rows.groupBy("field", ev.class_key(F.col("v")).alias("class_key")).agg(F.count("*").alias("n"))


def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How base and tuned predictions of the same record compare."""
    rows = judged(spark, sf_dir)
    a, b = rows.select("id", "truth", "base"), rows.select("id", F.col("truth").alias("truth_b"), "tuned")
    return a.join(b, "id").where("truth = truth_b").groupBy("truth").agg(F.count("*").alias("n"), F.count_if((F.col("base") != F.col("truth")) & (F.col("tuned") == F.col("truth"))).alias("gained"), F.count_if((F.col("base") == F.col("truth")) & (F.col("tuned") != F.col("truth"))).alias("lost"))


def pair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction tables of which the second lacks records, repeats some and judges some against another truth or version."""
    rows = judged(spark, sf_dir)
    d = F.conv(F.substring(F.sha2("id", 256), 9, 2), 16, 10).cast("int")
    other = rows.where(d % 10 != 0).withColumn("truth", F.when(d % 10 == 1, "other").otherwise(F.col("truth"))).withColumn("length", F.when(d % 5 == 1, F.col("length") + 1).otherwise(F.col("length")))
    other = other.unionByName(rows.where(d % 10 == 2))
    return ev.pair_faults(rows.where(d % 10 != 3), other, "id", "task_id", "version", "length", "truth")


def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.majority(judged(spark, sf_dir), "truth", "id", ["version"])


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.length_report(table(spark, sf_dir, "documents").select("source", F.length("text").alias("n")), "n", ["source"])


def valid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of answers that are JSON and that hold the label schema; an object left open counts as truncated."""
    text = F.trim("text")
    cut = F.coalesce(text.startswith("{") & ~text.endswith("}"), F.lit(False))
    return _r(ev.valid_rates(_answers(spark, sf_dir), "parsed", cut, ["split"]), "json_valid_rate", "label_schema_valid_rate")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _answers(spark, sf_dir)
    return out.select("id", "parsed.json_valid", "parsed.label_schema_valid", F.size("parsed.labels").alias("labels"), "parsed.error")


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.group_bootstrap(episodes(spark, sf_dir), "task_id", "success"), "point", "low", "high")


def f1_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ev.macro_f1_bootstrap(judged(spark, sf_dir), "task_id", "truth", "base", "tuned"), "point", "low", "high")


def multipath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that two or more different routes solve."""
    rows = table(spark, sf_dir, "planner_sft").dropDuplicates(["id"]).where("input_char_count % 3 <> 0 AND task_id IS NOT NULL")
    return rows.groupBy("task_id").agg(F.count_distinct("route").alias("paths")).where("paths >= 2")


_J = """(SELECT *, CASE WHEN d1 < 150 THEN truth ELSE list_extract(['supported', 'insufficient', 'contradicted', 'mixed', 'invalid'], d3 % 5 + 1) END AS base,
CASE WHEN d5 < 180 THEN truth ELSE list_extract(['supported', 'insufficient', 'contradicted', 'mixed', 'invalid'], d7 % 5 + 1) END AS tuned FROM (
SELECT *, CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) AS d1, CAST('0x' || substr(sha256(id), 3, 2) AS INTEGER) AS d3, CAST('0x' || substr(sha256(id), 5, 2) AS INTEGER) AS d5, CAST('0x' || substr(sha256(id), 7, 2) AS INTEGER) AS d7 FROM (
SELECT DISTINCT ON (id) id, task_id, metadata.annotation_version AS version, CASE WHEN json_valid(completion[1].content) THEN json_extract_string(completion[1].content, '$.labels.evidence_support') END AS truth, length(completion[1].content) AS length FROM verifier_records)
WHERE truth IN ('supported', 'insufficient', 'contradicted', 'mixed')))"""
_E = """(SELECT s.*, t.pair_id, t.side, t.kind, t.variant FROM (SELECT DISTINCT ON (id) id, task_id, trace_step_index AS repeat, input_char_count % 3 <> 0 AS success, coalesce(len(messages), -1) AS calls FROM planner_sft) s
JOIN (SELECT DISTINCT ON (id) id AS task_id, pair_id, side, task_kind AS kind, variant FROM tasks) t USING (task_id))"""
_WILSON = """round(((s / n + 1.959963984540054 ** 2 / (2 * n)) - 1.959963984540054 * sqrt(s / n * (1 - s / n) / n + 1.959963984540054 ** 2 / (4 * n * n))) / (1 + 1.959963984540054 ** 2 / n), 9) AS low,
round(((s / n + 1.959963984540054 ** 2 / (2 * n)) + 1.959963984540054 * sqrt(s / n * (1 - s / n) / n + 1.959963984540054 ** 2 / (4 * n * n))) / (1 + 1.959963984540054 ** 2 / n), 9) AS high"""
_SUMMARY = "SELECT {by} CAST(n AS BIGINT) AS episodes, u AS unique_tasks, CAST(s AS BIGINT) AS successes, round(s / n, 9) AS success_rate, " + _WILSON + " FROM (SELECT {by} CAST(count(*) AS DOUBLE) AS n, count(DISTINCT task_id) AS u, CAST(count(*) FILTER (success) AS DOUBLE) AS s FROM {rows} {group})"
_LABELS = "(SELECT unnest(['supported', 'insufficient', 'contradicted', 'mixed']) AS label)"
_SCORES = "(SELECT {by} label, count(*) FILTER (truth = label) AS support, count(*) FILTER (truth = label AND p = label) AS tp, count(*) FILTER (truth <> label AND p = label) AS fp, count(*) FILTER (truth = label AND p <> label) AS fn FROM (SELECT *, {p} AS p FROM " + _J + "), " + _LABELS + " GROUP BY ALL)"
_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


def _overall_sql(p: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys.replace(by, 'a.' + by) if by else ''} n, accuracy, macro_f1_observed, macro_f1_all, unrepresented, false_support, false_support_rate, withheld, withheld_rate, invalid FROM
(SELECT {keys} count(*) AS n, round(avg(CASE WHEN truth = {p} THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(count(*) FILTER (truth <> 'supported' AND {p} = 'supported') / nullif(count(*) FILTER (truth <> 'supported'), 0), 9) AS false_support_rate, count(*) FILTER (truth <> 'supported' AND {p} = 'supported') AS false_support, count(*) FILTER (truth = 'supported' AND {p} = 'insufficient') AS withheld,
round(count(*) FILTER (truth = 'supported' AND {p} = 'insufficient') / nullif(count(*) FILTER (truth = 'supported'), 0), 9) AS withheld_rate, count(*) FILTER ({p} = 'invalid') AS invalid FROM {_J} {group}) a
JOIN (SELECT {keys} round(avg(CASE WHEN support > 0 THEN {_F1} END), 9) AS macro_f1_observed, round(avg({_F1}), 9) AS macro_f1_all, coalesce(string_agg(label, ',' ORDER BY label) FILTER (support = 0), '') AS unrepresented FROM {_SCORES.format(by=keys, p=p)} {group}) b ON {f'a.{by} = b.{by}' if by else 'true'}"""


_A = "(SELECT id, split, c, coalesce(json_valid(c), false) AS j, coalesce(CASE WHEN json_valid(c) THEN json_extract_string(c, '$.labels.evidence_support') END IN ('supported', 'insufficient', 'contradicted', 'mixed'), false) AS l FROM (SELECT DISTINCT ON (id) id, metadata.split AS split, completion[1].content AS c FROM verifier_records))"
_LABEL_ROWS = f"(SELECT id, d, field, json_extract(c, '$.labels.' || field) AS v FROM (SELECT id, c, unnest(json_keys(c, '$.labels')) AS field, CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) AS d FROM {_A} WHERE l) WHERE d % 7 <> 3 OR json_extract_string(c, '$.labels.evidence_support') <> 'mixed')"


def _bootstrap_sql(draws: str, stat: str, seed: int, low: int, high: int, clusters: str, point: str) -> str:
    """The interval by the same draws: MD5 of seed and slot over the clusters in order."""
    return f"""
WITH c AS ({clusters}), n AS (SELECT count(*) AS n FROM c),
slots AS (SELECT i // n AS sample, CAST('0x' || substr(md5('{seed}:' || i), 1, 15) AS BIGINT) % n AS k FROM n, range((SELECT 2000 * n FROM n)) t(i)),
m AS (SELECT sample, {draws} FROM slots JOIN c USING (k) GROUP BY 1), o AS (SELECT list({stat} ORDER BY {stat}) AS ms FROM m)
SELECT n AS clusters, round({point}, 9) AS point, round(ms[{low}], 9) AS low, round(ms[{high}], 9) AS high FROM o, n"""


_F1_CLUSTERS = f"SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS k, " + ", ".join(f"count(*) FILTER (truth = '{x}') AS n{k}, " + ", ".join(f"count(*) FILTER (truth = '{x}' AND {p} = '{x}') AS {p}{k}_tp, count(*) FILTER ({p} = '{x}') AS {p}{k}_said" for p in ("base", "tuned")) for k, x in enumerate(ev.SUPPORT_LABELS)) + f" FROM {_J} WHERE task_id IS NOT NULL GROUP BY 1"
_F1_SUMS = ", ".join(f"sum(n{k}) AS n{k}, " + ", ".join(f"sum({p}{k}_tp) AS {p}{k}_tp, sum({p}{k}_said) AS {p}{k}_said" for p in ("base", "tuned")) for k in range(4))
_F1_DELTA = "((" + " + ".join(f"CASE WHEN n{k} > 0 THEN 2 * tuned{k}_tp / (n{k} + tuned{k}_said) ELSE 0 END" for k in range(4)) + ") - (" + " + ".join(f"CASE WHEN n{k} > 0 THEN 2 * base{k}_tp / (n{k} + base{k}_said) ELSE 0 END" for k in range(4)) + ")) / (" + " + ".join(f"CAST(n{k} > 0 AS INTEGER)" for k in range(4)) + ")"
_F1_DELTA_OF_SUMS = re.sub(r"\b(n\d|(?:base|tuned)\d_(?:tp|said))\b", r"sum(\1)", _F1_DELTA)

QUERIES = {
    "a4_success_summary": summary, "a5_success_by_subgroup": subgroups, "a6_paired_both": both, "a7_over_draws": draws, "a7_crossed_pairs": crossed, "a8_cost_totals": costs,
    "a9_confusion": confusion, "a10_class_scores": classes, "a11_overall_scores": overall, "a11_predicted_distribution": predictions, "f16_class_keys": class_keys, "f17_parsed_predictions": parsed, "j5_pair_faults": pair_faults, "a12_field_scores": fields, "a13_scores_by_version": overall_by_version,
    "a14_valid_rates": valid_rates, "a15_majority_label": majority, "a17_a18_group_bootstrap": bootstrap, "a18_macro_f1_bootstrap": f1_bootstrap, "a20_length_report": lengths, "a30_multipath_tasks": multipath, "j5_paired_predictions": paired_predictions,
}
ORACLES = {
    "a4_success_summary": _SUMMARY.format(by="", rows=_E, group=""),
    "a5_success_by_subgroup": _SUMMARY.format(by="subgroup,", group="GROUP BY subgroup", rows=f"(SELECT task_id, success, unnest(list_filter([CASE WHEN side = 'available' THEN 'answerable' END, CASE WHEN side = 'view_without_target' THEN 'missing_in_authorized_view' END, CASE WHEN variant = 'tool_error_repair' THEN 'repair_setup' END, CASE WHEN calls = 1 THEN 'observed_tool_error' END, CASE WHEN kind = 'text_evidence' THEN 'text' END, CASE WHEN kind = 'finite_metric' THEN 'numeric' END], lambda x: x IS NOT NULL)) AS subgroup FROM {_E})"),
    "a6_paired_both": f"SELECT count(*) FILTER (b) AS complete, count(*) FILTER (b AND ok) AS successes, count(DISTINCT pair_id) FILTER (b) AS unique_pairs, count(*) FILTER (NOT b) AS unpaired FROM (SELECT pair_id, repeat, count(DISTINCT side) = 2 AS b, bool_and(success) AS ok FROM {_E} WHERE pair_id IS NOT NULL AND repeat IS NOT NULL GROUP BY 1, 2)",
    "a7_over_draws": f"SELECT task_id, count(*) AS k, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 9) AS mean_success, bool_or(success) AS any_success FROM {_E} GROUP BY 1",
    "a7_crossed_pairs": f"SELECT * FROM (SELECT pair_id, round(avg(CASE WHEN side = 'available' THEN CAST(success AS INTEGER) END) * avg(CASE WHEN side = 'view_without_target' THEN CAST(success AS INTEGER) END), 9) AS paired_success FROM {_E} WHERE pair_id IS NOT NULL GROUP BY 1) WHERE paired_success IS NOT NULL",
    "a8_cost_totals": """SELECT kind, CAST(sum(len(m)) AS BIGINT) AS calls, CAST(sum(len(list_filter(m, lambda x: coalesce(trim(x.content), '') = ''))) AS BIGINT) AS invalid_calls, CAST(sum(len(list_filter(m, lambda x: x.role = 'assistant'))) AS BIGINT) AS action_attempts,
CAST(coalesce(sum(CAST(e AS INTEGER)), 0) AS BIGINT) AS rule_interventions, CAST(coalesce(sum(i), 0) AS BIGINT) AS prompt_chars, CAST(sum(coalesce(list_sum(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: coalesce(length(x.content), 0))), 0)) AS BIGINT) AS completion_chars, CAST(sum(w) AS BIGINT) AS wall_seconds
FROM (SELECT id, any_value(task_id) AS task_id, coalesce(any_value(messages), []) AS m, any_value(expert_trajectory) AS e, any_value(input_char_count) AS i, CAST(floor(epoch(min(ingested_at))) AS BIGINT) - CAST(floor(epoch(any_value(created_at))) AS BIGINT) AS w FROM planner_sft GROUP BY 1) p JOIN (SELECT DISTINCT ON (id) id AS task_id, task_kind AS kind FROM tasks) USING (task_id) GROUP BY 1""",
    "a9_confusion": f"SELECT label AS truth, {', '.join(f'''count(*) FILTER (truth = label AND base = '{x}') AS {x}''' for x in (*ev.SUPPORT_LABELS, 'invalid'))} FROM {_J}, {_LABELS} GROUP BY 1",
    "a10_class_scores": f"SELECT label, support, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(tp / nullif(support, 0), 9) AS recall, round({_F1}, 9) AS f1 FROM {_SCORES.format(by='', p='base')}",
    "a11_overall_scores": _overall_sql("base"),
    "a13_scores_by_version": _overall_sql("tuned", "version"),
    "a11_predicted_distribution": f"SELECT p AS prediction, count(base) AS n FROM (SELECT unnest(['supported', 'insufficient', 'contradicted', 'mixed', 'invalid']) AS p) LEFT JOIN {_J} ON base = p GROUP BY 1",
    "a12_field_scores": f"""
WITH l AS (SELECT id, field, CASE WHEN json_type(v) NOT IN ('ARRAY', 'OBJECT') THEN CAST(v AS VARCHAR) END AS truth, CASE WHEN d % 16 = 0 OR json_type(v) IN ('ARRAY', 'OBJECT') AND (d + length(field)) % 4 <> 0 THEN NULL WHEN (d + length(field)) % 4 = 0 THEN '"unknown"' ELSE CAST(v AS VARCHAR) END AS guess FROM {_LABEL_ROWS} WHERE json_type(v) <> 'NULL'),
n AS (SELECT count(DISTINCT id) AS n FROM {_LABEL_ROWS}),
p AS (SELECT field, x.label AS label, sum(x.s) AS support, sum(x.tp) AS tp, sum(x.g) AS said FROM (SELECT field, unnest([{{'label': truth, 's': 1, 'g': 0, 'tp': CASE WHEN truth = guess THEN 1 ELSE 0 END}}, {{'label': guess, 's': 0, 'g': 1, 'tp': 0}}]) AS x FROM l WHERE truth IS NOT NULL) WHERE x.label IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, 2.0 * tp / (support + said) AS f1 FROM p),
c AS (SELECT 'evidence_support' AS field, unnest(['supported', 'insufficient', 'contradicted', 'mixed']) AS label UNION ALL SELECT 'severity', unnest(['none', 'minor', 'major', 'critical', 'fatal'])),
m AS (SELECT field, round(avg(f1) FILTER (support > 0), 9) AS macro_f1 FROM f GROUP BY 1),
a AS (SELECT c.field, coalesce(string_agg(c.label, ',' ORDER BY c.label) FILTER (coalesce(support, 0) = 0), '') AS absent_classes, round(sum(coalesce(f1, 0)) / count(*), 9) AS macro_f1_all FROM c LEFT JOIN f ON f.field = c.field AND f.label = '"' || c.label || '"' GROUP BY 1)
SELECT field, count(truth) AS evaluated, any_value(n) - count(*) AS not_applicable, count(*) FILTER (truth IS NULL) AS non_scalar, count(*) FILTER (truth IS NOT NULL AND guess IS NULL) AS missed, round(count(*) FILTER (truth = guess) / nullif(count(truth), 0), 9) AS accuracy, any_value(macro_f1) AS macro_f1, any_value(absent_classes) AS absent_classes, any_value(macro_f1_all) AS macro_f1_all
FROM l LEFT JOIN m USING (field) LEFT JOIN a USING (field), n GROUP BY field""",
    "a14_valid_rates": f"SELECT split, count(*) AS n, round(avg(CAST(j AS INTEGER)), 9) AS json_valid_rate, round(avg(CAST(l AS INTEGER)), 9) AS label_schema_valid_rate, count(*) FILTER (trim(c) LIKE '{{%' AND trim(c) NOT LIKE '%}}') AS truncated FROM {_A} GROUP BY 1",
    "f17_parsed_predictions": f"SELECT id, j AS json_valid, l AS label_schema_valid, CAST(CASE WHEN l THEN len(json_keys(c, '$.labels')) ELSE 0 END AS INTEGER) AS labels, CASE WHEN NOT j THEN 'json' WHEN NOT l THEN 'labels' END AS error FROM {_A}",
    "f16_class_keys": f"SELECT field, CASE WHEN json_type(v) NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN CAST(v AS VARCHAR) END AS class_key, count(*) AS n FROM (SELECT field, json_extract(c, '$.labels.' || field) AS v FROM (SELECT c, unnest(json_keys(c, '$.labels')) AS field FROM {_A} WHERE j)) GROUP BY 1, 2",
    "j5_pair_faults": f"""
WITH r AS (SELECT *, CAST('0x' || substr(sha256(id), 9, 2) AS INTEGER) AS h FROM {_J}),
a AS (SELECT id, truth, length FROM r WHERE h % 10 <> 3), b AS (SELECT id, count(*) AS n, any_value(h) AS h FROM (SELECT id, h FROM r WHERE h % 10 <> 0 UNION ALL SELECT id, h FROM r WHERE h % 10 = 2) GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, unnest(CASE WHEN a.id IS NULL THEN ['not_in_a'] WHEN b.id IS NULL THEN ['not_in_b'] ELSE list_filter([CASE WHEN b.n > 1 THEN 'repeated' END, CASE WHEN b.h % 5 = 1 THEN 'length' END, CASE WHEN b.h % 10 = 1 THEN 'truth' END], lambda x: x IS NOT NULL) END) AS fault FROM a FULL JOIN b ON a.id = b.id""",
    "a17_a18_group_bootstrap": _bootstrap_sql("sum(s) / sum(c) AS m", "m", 20260909, 50, 1950, f"SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS k, sum(CAST(success AS INTEGER)) AS s, count(success) AS c FROM {_E} GROUP BY 1", "(SELECT sum(s) / sum(c) FROM c)"),
    "a18_macro_f1_bootstrap": _bootstrap_sql(f"{_F1_DELTA_OF_SUMS} AS m", "m", 20260908, 50, 1950, _F1_CLUSTERS, f"(SELECT {_F1_DELTA} FROM (SELECT {_F1_SUMS} FROM c))"),
    "a15_majority_label": f"SELECT version, label, n FROM (SELECT version, truth AS label, count(*) AS n, row_number() OVER (PARTITION BY version ORDER BY count(*) DESC, min(id)) AS k FROM {_J} GROUP BY 1, 2) WHERE k = 1",
    "a20_length_report": "SELECT source, count(*) AS records, CAST(sum(n) AS BIGINT) AS total, CAST(min(n) AS INTEGER) AS shortest, CAST(list_extract(list(n ORDER BY n), CAST(floor(count(*) / 2) AS INTEGER) + 1) AS INTEGER) AS median, CAST(list_extract(list(n ORDER BY n), CAST(ceil(count(*) * 0.95) AS INTEGER)) AS INTEGER) AS p95, CAST(max(n) AS INTEGER) AS longest FROM (SELECT source, length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "a30_multipath_tasks": "SELECT task_id, count(DISTINCT route) AS paths FROM planner_sft WHERE input_char_count % 3 <> 0 AND task_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT route) >= 2",
    "j5_paired_predictions": f"SELECT truth, count(*) AS n, count(*) FILTER (base <> truth AND tuned = truth) AS gained, count(*) FILTER (base = truth AND tuned <> truth) AS lost FROM {_J} GROUP BY 1",
}
