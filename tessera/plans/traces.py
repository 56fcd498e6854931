"""Queries of the trace and preparation operators, over the planner rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import traces as tr
from tessera.session import table

T, S = "reference_trace_id", "trace_step_index"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a trace and step, the least id where there are more."""
    rows = table(spark, sf_dir, "planner_sft").where(f"{T} IS NOT NULL AND {S} IS NOT NULL")
    return rows.groupBy(T, S).agg(F.min_by(F.struct("id", "task_id", "route", "split", "input_char_count"), "id").alias("r")).select(T, S, "r.*")


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.step_order(steps(spark, sf_dir), T, S).select(T, S, "in_place", "terminal")


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.running(steps(spark, sf_dir), T, S, {"chars": F.col("input_char_count")}, {"long_seen": F.col("input_char_count") > 500}).select(T, S, "chars", "long_seen")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.to_json(F.struct("id", S, "route"))
    return tr.hash_chain(steps(spark, sf_dir), T, S, payload, F.col(T))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.histories(steps(spark, sf_dir), T, S, F.col("input_char_count")).select(T, S, "history_chars", "history_steps")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.repairs(steps(spark, sf_dir), T, S, F.col("input_char_count") % 4 != 0, F.col("input_char_count") % 7)


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    return tr.within_budget(rows, T, 4).groupBy("split", "route").agg(F.count("*").alias("rows"), F.count_distinct(T).alias("traces"))


def budget_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = steps(spark, sf_dir).groupBy(T).agg(F.min("split").alias("split"), F.min("route").alias("route"), (F.count("*") <= 4).alias("within_budget"))
    return per.groupBy("split", "route", "within_budget").agg(F.count("*").alias("traces"))


def overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    return tr.without_overlong(rows, T, F.col("input_char_count") > 900).select("id", T, S)


def _kept(rows: DataFrame) -> DataFrame:
    return rows.where("input_char_count % 5 <> 0")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    return tr.coverage(_kept(rows), rows, T, S, ["task_id", "route"]).withColumn("missing", F.array_join("missing", ","))


def coverage_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    return tr.coverage_by(tr.coverage(_kept(rows), rows, T, S, ["task_id", "route"]), "route")


def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    tasks = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).select(F.col("id").alias("task_id"), "pair_id", "side")
    return tr.pair_coverage(tr.coverage(_kept(rows), rows, T, S, ["task_id"]), tasks)


def route_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("route").agg(F.round(F.avg("input_char_count"), 6).alias("mean_chars"), F.max("input_char_count").alias("most_chars"), F.max(S).alias("last_step"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of orders as token ids: the first two are the prompt."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    built = rows.select("l_orderkey", tr.masked(F.slice("ids", 1, 2), F.slice("ids", 3, 100), 2).alias("x")).select("l_orderkey", "x.*")
    out = tr.padded(tr.padded(built.withColumn("batch", F.col("l_orderkey") % 997), ["batch"], "input", 0), ["batch"], "labels", -100)
    return out.select("l_orderkey", F.array_join("input", ",").alias("input"), F.array_join("labels", ",").alias("labels"), F.size("attention").alias("attended"))


def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pair of each split and group, by id: the tasks that repair variants are made of."""
    tasks = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).where("pair_id IS NOT NULL AND split IS NOT NULL")
    first = tasks.groupBy("split", "group_id").agg(F.min_by("pair_id", "id").alias("pair_id"))
    return tasks.join(first, ["split", "group_id", "pair_id"], "left_semi").select("id", "split", F.lit("tool_error_repair").alias("variant"))


def repair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paired tasks, and the repair variants of the first pair of each split and group besides."""
    tasks = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).where("pair_id IS NOT NULL AND split IS NOT NULL").select("id", "split", "group_id", "pair_id", "variant")
    first = tasks.groupBy("split", "group_id").agg(F.min_by("pair_id", "id").alias("pair_id"))
    return tr.with_variants(tasks, first, ["split", "group_id", "pair_id"], "id", "variant", "tool_error_repair").select("id", "split", "variant")


_S = f"(SELECT * FROM (SELECT {T}, {S}, id, task_id, route, split, input_char_count, row_number() OVER (PARTITION BY {T}, {S} ORDER BY id) AS k FROM (SELECT DISTINCT ON (id) * FROM planner_sft) WHERE {T} IS NOT NULL AND {S} IS NOT NULL) WHERE k = 1)"
_C = f"(SELECT {T}, min(task_id) AS task_id, min(route) AS route, count(*) AS expected, count(*) FILTER (kept) AS retained, coalesce(string_agg(CASE WHEN NOT kept THEN CAST({S} AS VARCHAR) END, ',' ORDER BY {S}), '') AS missing, arg_max(kept, {S}) AS terminal_retained, bool_and(kept) AS complete FROM (SELECT *, input_char_count % 5 <> 0 AS kept FROM {_S}) GROUP BY 1)"

QUERIES = {
    "w1_step_order": order, "w5_w7_running": running, "w6_hash_chain": chain, "w8_histories": history, "w10_repairs": repaired, "f26_step_budget": budget, "a25_budget_audit": budget_audit, "f25_overlong": overlong,
    "a28_coverage": coverage, "a28_coverage_by_route": coverage_by_route, "a28_pair_coverage": pair_coverage, "a26_route_costs": route_costs, "f23_f24_token_rows": tokens, "j15_w11_first_of_group": first_of_group, "j15_repair_variants": repair_variants,
}
ORACLES = {
    "w6_hash_chain": f"""
WITH RECURSIVE s AS (SELECT {T} AS t, row_number() OVER (PARTITION BY {T} ORDER BY {S}) AS k, count(*) OVER (PARTITION BY {T}) AS n, '{{"id":' || to_json(id) || ',"{S}":' || {S} || ',"route":' || to_json(route) || '}}' AS p FROM {_S}),
c AS (SELECT t, CAST(0 AS BIGINT) AS k, n, sha256(t) AS h FROM s WHERE s.k = 1 UNION ALL SELECT c.t, s.k, c.n, sha256('{{"previous":"' || c.h || '","step":' || s.p || '}}') FROM c JOIN s ON s.t = c.t AND s.k = c.k + 1)
SELECT t AS {T}, CAST(n AS INTEGER) AS n, h AS chain FROM c WHERE k = n""",
    "w1_step_order": f"SELECT {T}, {S}, row_number() OVER w - 1 = {S} AS in_place, lead({S}) OVER w IS NULL AS terminal FROM {_S} WINDOW w AS (PARTITION BY {T} ORDER BY {S})",
    "w5_w7_running": f"SELECT {T}, {S}, CAST(sum(input_char_count) OVER w AS BIGINT) AS chars, bool_or(input_char_count > 500) OVER w AS long_seen FROM {_S} WINDOW w AS (PARTITION BY {T} ORDER BY {S} ROWS UNBOUNDED PRECEDING)",
    "w8_histories": f"SELECT {T}, {S}, CAST(coalesce(sum(input_char_count) OVER w, 0) AS BIGINT) AS history_chars, count(*) OVER w AS history_steps FROM {_S} WINDOW w AS (PARTITION BY {T} ORDER BY {S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "w10_repairs": f"SELECT {T}, count(*) FILTER (NOT v) AS opportunities, bool_or(v AND l IS NOT NULL AND a <> l) AS repaired FROM (SELECT *, last_value(CASE WHEN NOT v THEN a END IGNORE NULLS) OVER (PARTITION BY {T} ORDER BY {S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM (SELECT {T}, {S}, input_char_count % 4 <> 0 AS v, input_char_count % 7 AS a FROM {_S})) GROUP BY 1",
    "f26_step_budget": f"SELECT split, route, count(*) AS rows, count(DISTINCT {T}) AS traces FROM (SELECT *, count(*) OVER (PARTITION BY {T}) AS n FROM {_S}) WHERE n <= 4 GROUP BY 1, 2",
    "a25_budget_audit": f"SELECT split, route, within_budget, count(*) AS traces FROM (SELECT {T}, min(split) AS split, min(route) AS route, count(*) <= 4 AS within_budget FROM {_S} GROUP BY 1) GROUP BY 1, 2, 3",
    "f25_overlong": f"SELECT id, {T}, {S} FROM (SELECT *, max(CASE WHEN input_char_count > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY {T}) AS m FROM {_S}) WHERE m = 0",
    "a28_coverage": f"SELECT * FROM {_C}",
    "a28_coverage_by_route": f"SELECT route, count(*) AS traces, CAST(sum(retained) AS BIGINT) AS retained_steps, count(*) FILTER (retained > 0) AS any_step, count(*) FILTER (terminal_retained) AS with_terminal, count(*) FILTER (complete) AS complete, count(*) FILTER (retained = 0) AS excluded FROM {_C} GROUP BY 1",
    "a28_pair_coverage": f"SELECT pair_id, list_sort(list(DISTINCT side)) AS sides, count(*) = 2 AND count(DISTINCT side) = 2 AND bool_and(coalesce(t, false)) AS both_terminal, count(*) = 2 AND count(DISTINCT side) = 2 AND bool_and(coalesce(c, false)) AS both_complete FROM (SELECT DISTINCT ON (id) * FROM tasks WHERE pair_id IS NOT NULL) k LEFT JOIN (SELECT task_id, bool_or(terminal_retained) AS t, bool_or(complete) AS c FROM {_C} GROUP BY 1) x ON x.task_id = k.id GROUP BY 1",
    "a26_route_costs": f"SELECT route, round(avg(input_char_count), 6) AS mean_chars, max(input_char_count) AS most_chars, max({S}) AS last_step FROM {_S} GROUP BY 1",
    "f23_f24_token_rows": """
WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, ids[1:2] AS p, CASE WHEN ids[3:][-1] = 2 THEN ids[3:] ELSE list_append(ids[3:], 2) END AS q FROM o),
w AS (SELECT *, len(p) + len(q) AS n, max(len(p) + len(q)) OVER (PARTITION BY l_orderkey % 997) AS width FROM c)
SELECT l_orderkey, array_to_string(list_concat(p, q, list_transform(range(width - n), lambda x: 0)), ',') AS input,
array_to_string(list_concat(list_transform(p, lambda x: -100), q, list_transform(range(width - n), lambda x: -100)), ',') AS labels, CAST(n AS INTEGER) AS attended FROM w""",
    "j15_repair_variants": "WITH t AS (SELECT DISTINCT ON (id) * FROM tasks WHERE pair_id IS NOT NULL AND split IS NOT NULL) SELECT id, split, variant FROM t UNION ALL SELECT id || '-tool_error_repair', split, 'tool_error_repair' FROM t JOIN (SELECT split, group_id, arg_min(pair_id, id) AS pair_id FROM t GROUP BY 1, 2) USING (split, group_id, pair_id)",
    "j15_w11_first_of_group": "WITH t AS (SELECT DISTINCT ON (id) * FROM tasks WHERE pair_id IS NOT NULL AND split IS NOT NULL) SELECT id, split, 'tool_error_repair' AS variant FROM t JOIN (SELECT split, group_id, arg_min(pair_id, id) AS pair_id FROM t GROUP BY 1, 2) USING (split, group_id, pair_id)",
}
