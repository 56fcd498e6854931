"""Queries of the metric, measurement and reward operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions.numeric import DIGITS, half_even
from tessera.functions.text import canonical_hash, short_id
from tessera.operators import metrics, rewards
from tessera.session import table

GROUP = ("experiment_id", "metric", "wavelength_nm")


_USED = (*GROUP, "islet_id", "dish_id", "value", "unit", "method", "dataset_version", "pipeline_version")


def measured(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The measurements by row_id and the columns given (those of the metrics if none are), copies of a row once.

    Copies are equal but for when they came, so a distinct over the columns read
    is enough, and is hashed where first values by row_id would be sorted.
    """
    return table(spark, sf_dir, "measurements").select("row_id", *(columns or _USED)).distinct()


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})  # -0.0 is 0.0


def metric_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.valid_rows(measured(spark, sf_dir)).where("experiment_id IS NOT NULL")
    return _rounded(metrics.two_level(rows, (*GROUP, "unit", "method", "dataset_version", "pipeline_version")), "mean_value", "median_value")


def metric_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.two_level(measured(spark, sf_dir), GROUP), "mean_value", "median_value")


def lineitem_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_suppkey").cast("string").alias("islet_id"), (F.col("l_partkey") % 50).cast("string").alias("dish_id"), F.col("l_extendedprice").alias("value"), F.lit("a.u.").alias("unit"))
    return _rounded(metrics.two_level(rows, ("l_returnflag", "l_linenumber"), same=(("unit",),)), "mean_value", "median_value")


def metric_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.col("actor_observation.measurement_request")
    tasks = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).where(request.isNotNull())
    asked = tasks.select("id", *(request[c].alias(c) for c in (*GROUP, "aggregation")))
    return _rounded(metrics.answer_requests(asked, metrics.two_level(measured(spark, sf_dir), GROUP), GROUP), "value")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.col("actor_observation.measurement_request")
    asked = table(spark, sf_dir, "tasks").dropDuplicates(["id"]).where(request.isNotNull()).select("id", *(request[c].alias(c) for c in GROUP))
    rows = measured(spark, sf_dir, *GROUP, "islet_id", "dish_id", "value", "source_row_sha256")
    return metrics.evidence_rows(asked, rows, GROUP, "id", "row_id", "islet_id", "dish_id", "value", "source_row_sha256")


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("id", "row_id")


def metric_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.unit_values(_evidence(spark, sf_dir), "id"), "value")


def metric_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evidence_summary(_evidence(spark, sf_dir), "id")


def roundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as costs, rewards and means, ties to even."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", half_even(F.floor("value") / 512, DIGITS["cost"]).alias("cost"), half_even(F.floor("value") / 128, DIGITS["reward"]).alias("reward"), half_even(F.floor("value") / 8, DIGITS["mean"]).alias("mean"))


def measurement_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.catalog(table(spark, sf_dir, "measurements"), "experiment_id", "wavelength_nm", "metric", "unit")


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.valid_rows(measured(spark, sf_dir, "experiment_id", "islet_id", "value", "wavelength_nm")).groupBy("experiment_id").agg(F.count("*").alias("rows"), F.count_distinct("islet_id").alias("islets"), F.min(F.col("value") + F.lit(0.0)).alias("low"), F.max(F.col("value") + F.lit(0.0)).alias("high"))


def pushed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "measurements").where("split = 'dev' AND wavelength_nm = 488 AND metric = 'intensity_mean'")
    return rows.select("row_id", "experiment_id", "value", "unit").distinct().orderBy("experiment_id", "row_id")


def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tasks").dropDuplicates(["id"])
    return rows.select("id", canonical_hash(F.col("group_id"), F.col("id"), F.col("question"), F.col("split")).alias("hash"), short_id("pair-", F.col("pair_id"), F.col("side")).alias("short_id"))


_M = "(SELECT DISTINCT ON (row_id) * EXCLUDE (ingested_at) FROM measurements)"


def _two_level_sql(source: str, keys: str, same: str, unit: str = "islet_id", inner: str = "dish_id") -> str:
    guards = " OR ".join(f"count(DISTINCT coalesce(CAST({s} AS VARCHAR), '\\0')) > 1" for s in same.split(";"))
    return f"""
WITH r AS ({source}),
u AS (SELECT {keys}, {unit} AS u, median(CASE WHEN isfinite(value) THEN value END) AS m, bool_or(value IS NULL OR NOT isfinite(value) OR coalesce(trim({unit}), '') = '') AS bad FROM r GROUP BY ALL),
g AS (SELECT {keys}, count(*) AS n_rows, count(DISTINCT CASE WHEN trim({unit}) <> '' THEN {unit} END) AS n_units, count(DISTINCT CASE WHEN trim({inner}) <> '' THEN {inner} END) AS n_inner, ({guards}) AS mixed FROM r GROUP BY ALL),
a AS (SELECT {keys}, avg(m) AS mean_value, median(m) AS median_value, bool_or(bad) AS bad FROM u GROUP BY ALL),
s AS (SELECT g.*, a.mean_value AS mv, a.median_value AS dv, CASE WHEN mixed THEN 'incompatible_measurements' WHEN bad THEN 'invalid_measurement' ELSE 'ok' END AS status FROM g JOIN a ON {' AND '.join(f'g.{k.strip()} IS NOT DISTINCT FROM a.{k.strip()}' for k in keys.split(','))})
SELECT {keys}, status, CASE WHEN status = 'ok' THEN round(mv, 6) + 0.0 END AS mean_value, CASE WHEN status = 'ok' THEN round(dv, 6) + 0.0 END AS median_value, n_rows, n_units, n_inner FROM s
"""


_GUARDED = _two_level_sql(f"SELECT * FROM {_M}", "experiment_id, metric, wavelength_nm", "unit;method;struct_pack(a := dataset_version, b := pipeline_version)")

# ---- rewards, over draws made of the events ----



def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, side, i, reward): the draws of each user and parity of event, all of them."""
    side = (F.col("event_id") % 2).cast("int")
    place = F.row_number().over(Window.partitionBy("user_id", side).orderBy("event_id"))
    reward = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pair"), side.alias("side"), place.alias("i"), reward.alias("reward"))


def paired_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewards.paired_advantages(draws(spark, sf_dir), 0.5)
    # a hair is added, so that ties of the last digit fall the same way whatever the order of a sum
    return _rounded(_rounded(out.withColumn("advantage", F.col("advantage") + 3e-14), "reward", "q", digits=12), "advantage", digits=9)


def loo_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rewards.leave_one_out(draws(spark, sf_dir), ["pair", "side"], "reward"), "reward", "advantage", digits=12)


def group_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rewards.standardised(draws(spark, sf_dir), ["pair", "side"], "reward"), "reward", "advantage")


def joint_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rewards.joint_utility(draws(spark, sf_dir), 0.5), "joint_utility", digits=9)


def utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rewards.conditional_utilities(draws(spark, sf_dir), 0.25), "reward", "q", digits=12)


def surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped surrogates of event values taken as likelihood ratios."""
    ratio, advantage = F.col("value") / 50, F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(rewards.clipped(ratio, advantage), 6).alias("surrogate"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tokens of their orders, a line number of 1 not being the policy's."""
    new, old, ref = -F.col("l_discount") * 10, -F.col("l_tax") * 10, -(F.col("l_discount") + F.col("l_tax")) * 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") > 1, 1).otherwise(0).alias("mask"), F.round(new, 6).alias("new"), F.round(old, 6).alias("old"), F.round(ref, 6).alias("ref"))


def _loss():
    return rewards.token_loss(F.col("new"), F.col("old"), F.col("ref"), F.lit(1.0))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token losses by order."""
    return _tokens(spark, sf_dir).where("mask = 1").groupBy("l_orderkey").agg(F.round(F.avg(_loss()), 6).alias("loss"))


def loss_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose loss is refused, their log probabilities being stretched by the price."""
    stretched = _tokens_by_price(spark, sf_dir)
    faults = rewards.loss_faults(stretched, "l_orderkey", "mask", rewards.token_fault(F.col("new"), F.col("old"), F.col("ref")))
    return faults.groupBy("fault").agg(F.count("*").alias("orders"), F.sum("tokens").alias("tokens"))


def _tokens_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    new = F.when(F.col("l_quantity") == 50, float("nan")).otherwise(-F.col("l_extendedprice") / 1000)
    return rows.select("l_orderkey", F.when(F.col("l_linenumber") > 1, 1).otherwise(0).alias("mask"), new.alias("new"), F.lit(-1.0).alias("old"), F.lit(-2.0).alias("ref"))


def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rewards.episode_loss(_tokens(spark, sf_dir), "l_orderkey", "mask", _loss()), "loss")


def unequal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.unequal_sides(draws(spark, sf_dir))


def reward_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards before they are cut to -1 and 1, by what is wrong with them."""
    x = (F.col("value") - 50) / 50
    state = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "not_finite").when(x < -1, "below").when(x > 1, "above").otherwise("ok")
    return table(spark, sf_dir, "events").groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return _rounded(rewards.trailing_mean(rows, ["event_type"], ["ts", "event_id"], "value"), "trailing_mean").select("event_id", "event_type", "trailing_mean")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.flat_groups(draws(spark, sf_dir), ["pair", "side"], "reward")


_D = """(SELECT user_id AS pair, CAST(event_id % 2 AS INTEGER) AS side, CAST(row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS INTEGER) AS i,
greatest(-1.0, least(1.0, (value - 50) / 50)) AS reward FROM events)"""
_Q = "(SELECT a.pair, a.side, a.i, a.reward, avg((1 - {eta}) * (a.reward + b.reward) / 2 + {eta} * least(a.reward, b.reward)) AS q FROM " + _D + " a JOIN " + _D + " b ON a.pair = b.pair AND a.side <> b.side GROUP BY ALL)"
_LOSS = "-least(exp(new - old), least(greatest(exp(new - old), 0.8), 1.2)) + 0.04 * (exp(ref - new) - 1 - (ref - new))"
_TOKENS = "(SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END AS mask, round(-l_discount * 10, 6) AS new, round(-l_tax * 10, 6) AS old, round(-(l_discount + l_tax) * 5, 6) AS ref FROM lineitem)"

_EVIDENCE = f"(SELECT t.id, m.row_id, m.islet_id, m.dish_id, m.value, m.source_row_sha256 FROM (SELECT DISTINCT ON (id) id, actor_observation.measurement_request AS q FROM tasks WHERE actor_observation.measurement_request IS NOT NULL) t JOIN {_M} m ON m.experiment_id = q.experiment_id AND m.metric = q.metric AND m.wavelength_nm = q.wavelength_nm)"

QUERIES = {
    "a1_metric_by_condition": metric_by_condition,
    "a1_metric_guarded": metric_guarded,
    "a1_metric_lineitem": lineitem_metric,
    "a2_metric_requests": metric_requests,
    "a2_metric_rows": metric_rows,
    "a2_metric_units": metric_units,
    "a2_metric_evidence": metric_evidence,
    "f28_roundings": roundings,
    "r3_unequal_pairs": unequal_pairs,
    "r7_loss_faults": loss_faults,
    "v19_reward_ranges": reward_ranges,
    "a3_measurement_catalog": measurement_catalog,
    "f2_row_hashes": row_hashes,
    "proj10_clean_measurements": clean_counts,
    "s6_pushed_scan": pushed_scan,
    "r1_r2_conditional_utilities": utilities,
    "r3_paired_advantages": paired_rewards,
    "r4_joint_utility": joint_rewards,
    "r6_clipped_surrogate": surrogate,
    "r7_token_loss": losses,
    "r8_batch_loss": batch_loss,
    "w2_leave_one_out": loo_rewards,
    "w3_group_z_score": group_rewards,
    "w4_trailing_mean": trailing,
    "a33_flat_groups": flat,
}
ORACLES = {
    "a1_metric_by_condition": _two_level_sql(f"SELECT * FROM {_M} WHERE value IS NOT NULL AND isfinite(value) AND trim(islet_id) <> '' AND wavelength_nm IS NOT NULL AND experiment_id IS NOT NULL", "experiment_id, metric, wavelength_nm, unit, method, dataset_version, pipeline_version", "unit"),
    "a1_metric_guarded": _GUARDED,
    "a1_metric_lineitem": _two_level_sql("SELECT l_returnflag, l_linenumber, CAST(l_suppkey AS VARCHAR) AS islet_id, CAST(l_partkey % 50 AS VARCHAR) AS dish_id, l_extendedprice AS value, 'a.u.' AS unit FROM lineitem", "l_returnflag, l_linenumber", "unit"),
    "a2_metric_requests": f"""
WITH m AS ({_GUARDED}), t AS (SELECT DISTINCT ON (id) id, actor_observation.measurement_request AS q FROM tasks WHERE actor_observation.measurement_request IS NOT NULL)
SELECT t.id, q.experiment_id, q.metric, q.wavelength_nm, q.aggregation, coalesce(m.status, 'unavailable_in_authorized_snapshot') AS status,
CASE q.aggregation WHEN 'mean' THEN m.mean_value WHEN 'median' THEN m.median_value END AS value, m.n_rows, m.n_units
FROM t LEFT JOIN m ON m.experiment_id = q.experiment_id AND m.metric = q.metric AND m.wavelength_nm = q.wavelength_nm""",
    "a2_metric_rows": f"SELECT id, row_id FROM {_EVIDENCE}",
    "a2_metric_units": f"SELECT id, islet_id, round(median(value), 6) + 0.0 AS value, count(*) AS rows FROM {_EVIDENCE} WHERE value IS NOT NULL AND isfinite(value) AND trim(islet_id) <> '' GROUP BY 1, 2",
    "a2_metric_evidence": f"SELECT id, count(*) AS n_images, count(DISTINCT nullif(trim(islet_id), '')) AS n_islets, count(DISTINCT nullif(trim(dish_id), '')) AS n_dishes, CAST(NULL AS BIGINT) AS n_mice, min(row_id) AS first_row, max(row_id) AS last_row, CAST(sum(CAST('0x' || substr(md5(row_id || '|' || source_row_sha256), 1, 15) AS BIGINT)) AS VARCHAR) AS snapshot FROM {_EVIDENCE} GROUP BY 1",
    "f28_roundings": "SELECT event_id, round_even(floor(value) / 512, 8) AS cost, round_even(floor(value) / 128, 6) AS reward, round_even(floor(value) / 8, 2) AS mean FROM events",
    "r3_unequal_pairs": f"SELECT pair, count(*) AS sides, min(n) AS least, max(n) AS most FROM (SELECT pair, side, count(*) AS n FROM {_D} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) <> 2 OR min(n) <> max(n) OR min(n) < 2",
    "r7_loss_faults": """WITH t AS (SELECT l_orderkey AS o, l_linenumber > 1 AS m, l_quantity = 50 AS bad, -l_extendedprice / 1000 AS new FROM lineitem),
f AS (SELECT o, CASE WHEN bad THEN 'not_finite' WHEN abs(new + 1) > 60 OR abs(-2 - new) > 60 THEN 'unstable' END AS fault FROM t WHERE m)
SELECT fault, count(*) AS orders, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT o, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT o, 'empty_mask', 0 FROM t GROUP BY 1 HAVING NOT bool_or(m)) GROUP BY 1""",
    "v19_reward_ranges": "SELECT CASE WHEN value IS NULL OR NOT isfinite(value) THEN 'not_finite' WHEN (value - 50) / 50 < -1 THEN 'below' WHEN (value - 50) / 50 > 1 THEN 'above' ELSE 'ok' END AS state, count(*) AS rows FROM events GROUP BY 1",
    "a3_measurement_catalog": "SELECT DISTINCT experiment_id, wavelength_nm, metric, unit FROM measurements",
    "proj10_clean_measurements": f"SELECT experiment_id, count(*) AS rows, count(DISTINCT islet_id) AS islets, min(value + 0.0) AS low, max(value + 0.0) AS high FROM {_M} WHERE value IS NOT NULL AND isfinite(value) AND trim(islet_id) <> '' AND wavelength_nm IS NOT NULL GROUP BY 1",
    "s6_pushed_scan": "SELECT DISTINCT row_id, experiment_id, value, unit FROM measurements WHERE split = 'dev' AND wavelength_nm = 488 AND metric = 'intensity_mean'",
    "f2_row_hashes": """SELECT DISTINCT id, sha256('{"group_id":' || to_json(group_id) || ',"id":' || to_json(id) || ',"question":' || to_json(question) || ',"split":' || coalesce(CAST(to_json(split) AS VARCHAR), 'null') || '}') AS hash,
'pair-' || left(sha256('{"pair_id":' || coalesce(CAST(to_json(pair_id) AS VARCHAR), 'null') || ',"side":' || to_json(side) || '}'), 24) AS short_id FROM tasks""",
    "r1_r2_conditional_utilities": f"SELECT pair, side, i, round(reward, 12) + 0.0 AS reward, round(q, 12) + 0.0 AS q FROM {_Q.format(eta=0.25)}",
    "r3_paired_advantages": f"SELECT pair, side, i, round(reward, 12) + 0.0 AS reward, round(q, 12) + 0.0 AS q, round(2 * (q - (sum(q) OVER w - q) / (count(*) OVER w - 1)) + 3e-14, 9) + 0.0 AS advantage FROM {_Q.format(eta=0.5)} WINDOW w AS (PARTITION BY pair, side)",
    "r4_joint_utility": f"SELECT a.pair, round(avg(0.5 * (a.reward + b.reward) / 2 + 0.5 * least(a.reward, b.reward)), 9) + 0.0 AS joint_utility, count(*) AS operations, any_value(n) AS draws FROM {_D} a JOIN {_D} b ON a.pair = b.pair AND a.side < b.side JOIN (SELECT pair, count(*) AS n FROM {_D} GROUP BY 1) s ON s.pair = a.pair GROUP BY a.pair",
    "r6_clipped_surrogate": "SELECT event_id, round(least(value / 50 * a, least(greatest(value / 50, 0.8), 1.2) * a), 6) AS surrogate FROM (SELECT event_id, value, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END AS a FROM events)",
    "r7_token_loss": f"SELECT l_orderkey, round(avg({_LOSS}), 6) AS loss FROM {_TOKENS} WHERE mask = 1 GROUP BY 1",
    "r8_batch_loss": f"SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS episodes, round(sum(x) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS loss FROM (SELECT avg({_LOSS}) AS x FROM {_TOKENS} WHERE mask = 1 GROUP BY l_orderkey)",
    "w2_leave_one_out": f"SELECT pair, side, i, round(reward, 12) + 0.0 AS reward, round(reward - (sum(reward) OVER w - reward) / nullif(count(*) OVER w - 1, 0), 12) + 0.0 AS advantage FROM {_D} WINDOW w AS (PARTITION BY pair, side)",
    "w3_group_z_score": f"SELECT pair, side, i, round(reward, 6) + 0.0 AS reward, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8), 6) + 0.0 AS advantage FROM {_D} WINDOW w AS (PARTITION BY pair, side)",
    "w4_trailing_mean": "SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM events",
    "a33_flat_groups": f"SELECT count(*) FILTER (a = b) AS flat_groups, count(*) AS groups FROM (SELECT min(reward) AS a, max(reward) AS b FROM {_D} GROUP BY pair, side)",
}
