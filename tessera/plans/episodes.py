"""Queries of the join, episode and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import close
from tessera.functions.staging import Stage
from tessera.functions.unicode import casefold, nfkc
from tessera.operators import episodes as ep
from tessera.operators.evaluation import changed_after_feedback
from tessera.plans.measures import GROUP, measured
from tessera.plans.traces import S, T, steps
from tessera.session import table


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").drop("ingested_at").dropDuplicates(["id"])


def task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks joined with their recorded steps: one row a task, steps counted."""
    rows = steps(spark, sf_dir).select("task_id", T)
    return _tasks(spark, sf_dir).select(F.col("id").alias("task_id"), "side", "task_kind").join(rows, "task_id").groupBy("task_id", "side", "task_kind").agg(F.count("*").alias("steps"), F.count_distinct(T).alias("traces"))


def task_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks against the views they name, some of which are lost and some made anew."""
    d = F.conv(F.substring(F.sha2("view_id", 256), 1, 2), 16, 10).cast("int") % 11
    views = _tasks(spark, sf_dir).groupBy("view_id").agg(F.min("view_sha256").alias("view_sha256")).where(d != 0).withColumn("view_sha256", F.when(d == 1, F.sha2("view_id", 256)).otherwise(F.col("view_sha256")))
    return ep.bound_views(_tasks(spark, sf_dir).select("id", "view_id", "view_sha256"), views).select("id", "binding")


def task_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that have not exactly one verifier record, and records of no task."""
    scorers = table(spark, sf_dir, "verifier_records").dropDuplicates(["id"]).select("task_id")
    return ep.not_one_to_one(_tasks(spark, sf_dir).select(F.col("id").alias("task_id")), scorers, "task_id")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side and variant of questions, by whether they can be answered and what may go wrong."""
    rows = table(spark, sf_dir, "pilot_5_questions").drop("ingested_at").dropDuplicates(["question_id"])
    side = F.when(F.col("answerability") == "answerable", "available").otherwise("view_without_target")
    variant = F.when(F.size("required_context_slots") > 0, "slots_missing").when(F.coalesce(F.size("known_conflicts"), F.lit(0)) > 0, "conflicting").otherwise("plain")
    return rows.select("question_id", side.alias("side"), variant.alias("variant"))


def task_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each measurement request may use."""
    q = F.col("actor_observation.measurement_request")
    asked = _tasks(spark, sf_dir).where(q.isNotNull()).select("id", *(q[c].alias(c) for c in GROUP))
    return asked.join(measured(spark, sf_dir, *GROUP, "islet_id"), list(GROUP)).groupBy("id").agg(F.count("*").alias("rows"), F.count_distinct("islet_id").alias("islets"))


def pair_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each pair side by side, with whether they ask the same."""
    rows = _tasks(spark, sf_dir).where("pair_id IS NOT NULL").select("pair_id", "side", "id", "question")
    a, b = rows.where("side = 'available'"), rows.where("side = 'view_without_target'").toDF("pair_id", "side_b", "id_b", "question_b")
    return a.join(b, "pair_id").select("pair_id", "id", "id_b", (F.col("question") == F.col("question_b")).alias("same_question"))


def unseen_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out verifier records whose task no training record has."""
    rows = table(spark, sf_dir, "verifier_records").select("id", "task_id", F.col("metadata.split").alias("split")).distinct()
    return rows.where("split = 'dev' AND task_id IS NOT NULL").join(rows.where("split = 'train'").select("task_id").distinct(), "task_id", "left_anti").select("id")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the three tables that have some, with where they come from."""
    parts = [_tasks(spark, sf_dir).select(F.lit("tasks").alias("origin"), "question"), table(spark, sf_dir, "pilot_5_questions").dropDuplicates(["question_id"]).select(F.lit("pilot").alias("origin"), "question"), table(spark, sf_dir, "eval_items").select(F.lit("eval").alias("origin"), "question")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count("*").alias("questions"), F.count_distinct("question").alias("distinct_questions"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an actor may see of a task, and derived columns instead of what it may not."""
    setup = F.when(F.col("setup_action").isNotNull(), "repair").when(F.col("task_kind") == "finite_metric", "numeric").otherwise("text")
    return _tasks(spark, sf_dir).select("id", "question", F.col("actor_observation.scope").alias("scope"), setup.alias("kind"))


def untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts without the members that may differ between two runs, wherever they stand."""
    rows = table(spark, sf_dir, "review_pool_assessment").dropDuplicates(["assessment_id"])
    out = ep.without_timing(rows.select("assessment_id", "fulltext"), "fulltext", names=("n_chars", "path"))
    return out.select("assessment_id", F.md5(F.to_json("fulltext", {"ignoreNullFields": "false"}).cast("binary")).alias("digest"))


def close_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events against themselves, moved by a part that grows with the id."""
    moved = F.col("value") * (1 + F.pow(F.lit(10.0), (F.col("event_id") % 7).cast("double") - 12.5))
    return table(spark, sf_dir, "events").select("event_id", close(F.col("value"), moved).alias("close"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes made of the documents: each is asked for a passage, for a number or for nothing, and many answer wrongly in one way."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("doc_id").cast("string").alias("e"), "text", F.substring("text", 1, 40).alias("quote"), F.length("text").alias("size"))
    kind = F.element_at(F.array(F.lit("insufficient"), F.lit("exact_passage"), F.lit("finite_metric")), (n % 3).cast("int") + 1)
    answerability = F.when(kind == "insufficient", "insufficient").otherwise("answerable")
    none_c, none_m = F.array().cast("array<struct<evidence_id:string,quote:string>>"), F.array().cast("array<struct<result_id:string,value:double,unit:string>>")
    claim = lambda quote: F.array(F.struct(F.col("e").alias("evidence_id"), quote.alias("quote")))
    value = F.when(n % 5 == 0, F.col("size") * 1.001).otherwise(F.col("size").cast("double"))
    final = F.struct(
        F.when(n % 11 == 0, "unsure").otherwise(answerability).alias("answerability"), F.when(n % 13 == 0, "everything").otherwise("authorized_snapshot_only").alias("scope"), F.when(n % 17 == 0, "It was never measured.").otherwise("As read.").alias("reason"),
        F.when(kind == "exact_passage", claim(F.when(n % 5 == 0, F.lit("no such words here")).otherwise(F.col("quote")))).otherwise(none_c).alias("claims"),
        F.when((kind == "finite_metric") & (n % 19 != 0), F.array(F.struct(F.concat(F.lit("r"), F.col("e")).alias("result_id"), value.alias("value"), F.lit("chars").alias("unit")))).otherwise(none_m).alias("measurements"),
    )
    scorer = F.struct(answerability.alias("answerability"), kind.alias("kind"), F.array("e").alias("allowed_ids"), claim(F.col("quote")).alias("expected_claims"))
    read = F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("e"))
    seen = F.struct(read.alias("read_ids"), F.create_map("e", "text").alias("texts"), F.array(F.concat(F.lit("r"), F.col("e"))).alias("results"), (n % 2 == 0).alias("empty_anchor_checked"), (n % 4 != 1).alias("catalog_complete"), F.array("e").alias("passage_ids"), F.lit(0).alias("measurement_rows"))
    reference = F.struct(F.concat(F.lit("r"), F.col("e")).alias("result_id"), F.col("size").cast("double").alias("value"), F.lit("chars").alias("unit"))
    score = ep.episode_score(final, scorer, seen, reference)
    return docs.select("doc_id", score.alias("s")).select("doc_id", "s.passed", F.array_join("s.failed", ",").alias("failed"))


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, side, trace, initial, success, actions, observations): what the traces of a task did, by the tools named, and saw."""
    rows = steps(spark, sf_dir).select("id", T, S, "task_id", "input_char_count")
    said = table(spark, sf_dir, "planner_sft").groupBy("id").agg(F.min_by("messages", F.size("messages")).alias("messages"))
    tasks = _tasks(spark, sf_dir).select(F.col("id").alias("task_id"), "pair_id", "side").where("pair_id IS NOT NULL")
    text = lambda role: F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit(""))), "|")
    each = rows.join(said, "id").join(tasks, "task_id").select("pair_id", "side", T, S, (F.col("input_char_count") % 3 != 0).alias("ok"), F.coalesce(F.regexp_extract(text("assistant"), r'"tool":"(\w+)"', 1), F.lit("")).alias("a"), F.md5(F.coalesce(text("user"), F.lit("")).cast("binary")).alias("o"))
    return each.groupBy("pair_id", "side", T).agg(F.array_sort(F.collect_list(F.struct(S, "a", "o"))).alias("x"), F.bool_or("ok").alias("success")).select("pair_id", "side", T, F.struct(F.col("pair_id").alias("initial"), "success", F.transform("x", lambda r: r["a"]).alias("actions"), F.transform("x", lambda r: r["o"]).alias("observations")).alias("e"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _taken(spark, sf_dir)
    a = rows.where("side = 'available'").select("pair_id", F.col(T).alias("trace_a"), F.col("e").alias("a"))
    b = rows.where("side = 'view_without_target'").select("pair_id", F.col(T).alias("trace_b"), F.col("e").alias("b"))
    return changed_after_feedback(a.join(b, "pair_id"), "a", "b")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of traces of both sides of a pair, and whether they part ways only after what they saw differs."""
    return _compared(spark, sf_dir).select("pair_id", "trace_a", "trace_b", "changed")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a gate over the planner rows as episodes."""
    steps_ = table(spark, sf_dir, "planner_sft").drop("ingested_at").dropDuplicates(["id"]).select("id", "task_id", "route", "input_char_count", F.coalesce(F.size("messages"), F.lit(0)).alias("calls"))
    tasks = _tasks(spark, sf_dir).select(F.col("id").alias("task_id"), F.col("task_kind").alias("family"), "variant")
    n = F.col("input_char_count")
    rows = steps_.join(tasks, "task_id").select("task_id", "family", F.col("route").alias("path"), (n % 3 != 0).alias("success"), (n % 20 != 0).alias("relevant"), "calls", (F.col("calls") - (n % 50 == 0).cast("int")).alias("schema_valid_calls"), (F.col("variant") == "tool_error_repair").alias("repair_opportunity"), (n % 2 == 0).alias("repair_success"))
    pairs = _compared(spark, sf_dir).groupBy("pair_id").agg(F.bool_or("changed").alias("passed"))
    return ep.decision_checks(rows, pairs, min_success=0.9, min_schema=0.95)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.selection_coverage(_tasks(spark, sf_dir), F.col("split") == "dev")


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.draw_plan(table(spark, sf_dir, "eval_items").select("item_id"), ["item_id"], 4, 7)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.sample_groups(_tasks(spark, sf_dir), "group_id", 5, 11).select("id", "group_id")


def single_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.sample_groups(_tasks(spark, sf_dir).where("split = 'train'"), "id", 2, 11).select("id", "split")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.lit(True)
    rows = table(spark, sf_dir, "planner_sft").dropDuplicates(["id"])
    return ep.thresholds(rows, {"bound": (yes, F.col("task_id").isNotNull(), 0.9, 10), "short": (F.col("route") == "search_read", F.col("input_char_count") < 400, 0.5, 10), "expert": (F.col("expert_trajectory"), yes, 0.9, 10**9)})


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions change under the exact Unicode forms."""
    rows = table(spark, sf_dir, "pilot_5_questions").select("question_id", "question").distinct()
    return rows.agg(F.count("*").alias("questions"), F.count_if(nfkc(F.col("question")) != F.col("question")).alias("nfkc_differs"), F.count_if(casefold(F.col("question")) != F.lower("question")).alias("casefold_differs"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream into windows of six hours, run until all that is there is done."""
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("events"), F.max("value").alias("most"))
    stage = Stage(spark, "windows")
    out = counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("begin"), "event_type", "events", "most")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{stage.root}/batches")

    # windows that the watermark has passed leave the state; what was put out last counts
    query = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{stage.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{stage.root}/batches").groupBy("begin", "event_type").agg(F.max_by(F.struct("events", "most"), "batch").alias("x")).select("begin", "event_type", "x.*")


_T1 = "(SELECT DISTINCT ON (id) * FROM tasks)"
_S1 = f"(SELECT * FROM (SELECT {T}, {S}, id, task_id, row_number() OVER (PARTITION BY {T}, {S} ORDER BY id) AS k FROM (SELECT DISTINCT ON (id) * FROM planner_sft) WHERE {T} IS NOT NULL AND {S} IS NOT NULL) WHERE k = 1)"
_M1 = "(SELECT DISTINCT ON (row_id) * FROM measurements)"

_TAKEN = f"""(SELECT t.pair_id, t.side, s.{T} AS trace, bool_or(s.n % 3 <> 0) AS success, list(s.a ORDER BY s.k) AS acts, list(s.o ORDER BY s.k) AS seen FROM (
SELECT x.{T}, x.{S} AS k, x.task_id, p.n, coalesce(regexp_extract(array_to_string(list_transform(list_filter(p.m, lambda y: y.role = 'assistant'), lambda y: coalesce(y.content, '')), '|'), '"tool":"([0-9A-Za-z_]+)"', 1), '') AS a,
md5(coalesce(array_to_string(list_transform(list_filter(p.m, lambda y: y.role = 'user'), lambda y: coalesce(y.content, '')), '|'), '')) AS o FROM {_S1} x JOIN (SELECT DISTINCT ON (id) id, input_char_count AS n, messages AS m FROM planner_sft) p ON p.id = x.id) s
JOIN (SELECT id AS task_id, pair_id, side FROM {_T1} WHERE pair_id IS NOT NULL) t ON t.task_id = s.task_id GROUP BY 1, 2, 3)"""
_FEEDBACK = f"""(SELECT pair_id, trace_a, trace_b, sa AND sb AND coalesce(fork, 0) > 0 AND (part IS NULL OR part > fork) AND len(aa) > fork AND len(ab) > fork AND aa[fork + 1:] IS DISTINCT FROM ab[fork + 1:] AS changed FROM (
SELECT *, list_min(list_filter(range(1, least(len(oa), len(ob)) + 1), lambda i: oa[i] <> ob[i])) AS fork, list_min(list_filter(range(1, least(len(oa), len(ob)) + 1), lambda i: aa[i] <> ab[i])) AS part FROM (
SELECT a.pair_id, a.trace AS trace_a, b.trace AS trace_b, a.success AS sa, b.success AS sb, a.acts AS aa, b.acts AS ab, a.seen AS oa, b.seen AS ob FROM {_TAKEN} a JOIN {_TAKEN} b ON a.pair_id = b.pair_id AND a.side = 'available' AND b.side = 'view_without_target')))"""

QUERIES = {
    "j1_j4_task_steps": task_steps, "j3_task_measurements": task_measurements, "j6_pair_sides": pair_sides, "j13_unseen_tasks": unseen_tasks, "j14_merged_questions": merged, "proj7_proj11_actor_view": kinds, "proj12_untimed": untimed,
    "j1_task_views": task_views, "j4_task_scorers": task_scorers, "proj7_sides": sides, "f19_close": close_values, "f22_episode_scores": scores, "w9_feedback": feedback, "a29_decisions": decisions, "r11_sampled_tasks": single_tasks, "a31_selection_coverage": selection, "o5_draw_plan": plan, "r11_sampled_groups": groups, "a29_thresholds": gates, "f4_f5_unicode_forms": forms, "stream_event_windows": event_windows,
}
ORACLES = {
    "j1_j4_task_steps": f"SELECT t.id AS task_id, side, task_kind, count(*) AS steps, count(DISTINCT {T}) AS traces FROM {_T1} t JOIN {_S1} s ON s.task_id = t.id GROUP BY 1, 2, 3",
    "j3_task_measurements": f"SELECT t.id, count(*) AS rows, count(DISTINCT islet_id) AS islets FROM (SELECT id, actor_observation.measurement_request AS q FROM {_T1}) t JOIN {_M1} m ON m.experiment_id = q.experiment_id AND m.metric = q.metric AND m.wavelength_nm = q.wavelength_nm GROUP BY 1",
    "j6_pair_sides": f"SELECT a.pair_id, a.id, b.id AS id_b, a.question = b.question AS same_question FROM {_T1} a JOIN {_T1} b ON a.pair_id = b.pair_id AND a.side = 'available' AND b.side = 'view_without_target'",
    "j13_unseen_tasks": "SELECT DISTINCT id FROM verifier_records WHERE metadata.split = 'dev' AND task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM verifier_records WHERE metadata.split = 'train' AND task_id IS NOT NULL)",
    "j14_merged_questions": f"SELECT origin, count(*) AS questions, count(DISTINCT question) AS distinct_questions FROM (SELECT 'tasks' AS origin, question FROM {_T1} UNION ALL SELECT 'pilot', question FROM (SELECT DISTINCT ON (question_id) * FROM pilot_5_questions) UNION ALL SELECT 'eval', question FROM eval_items) GROUP BY 1",
    "proj7_proj11_actor_view": f"SELECT id, question, actor_observation.scope AS scope, CASE WHEN setup_action IS NOT NULL THEN 'repair' WHEN task_kind = 'finite_metric' THEN 'numeric' ELSE 'text' END AS kind FROM {_T1}",
    "proj12_untimed": """SELECT assessment_id, CASE WHEN f IS NOT NULL THEN md5('{"status":' || coalesce(CAST(to_json(f.status) AS VARCHAR), 'null') || ',"sha256":' || coalesce(CAST(to_json(f.sha256) AS VARCHAR), 'null') || ',"error":' || coalesce(CAST(to_json(f.error) AS VARCHAR), 'null') || ',"sections":' || coalesce('[' || array_to_string(list_transform(f.sections, lambda s: CASE WHEN s IS NULL THEN 'null' ELSE
'{"heading":' || coalesce(CAST(to_json(s.heading) AS VARCHAR), 'null') || ',"paragraphs":' || coalesce('[' || array_to_string(list_transform(s.paragraphs, lambda p: CASE WHEN p IS NULL THEN 'null' ELSE '{"paragraph_id":' || coalesce(CAST(to_json(p.paragraph_id) AS VARCHAR), 'null') || '}' END), ',') || ']', 'null') || '}' END), ',') || ']', 'null') || '}') END AS digest
FROM (SELECT DISTINCT ON (assessment_id) assessment_id, fulltext AS f FROM review_pool_assessment)""",
    "j1_task_views": f"SELECT id, CASE d WHEN 0 THEN 'unknown_view' WHEN 1 THEN 'digest_differs' ELSE 'ok' END AS binding FROM (SELECT id, CAST('0x' || substr(sha256(view_id), 1, 2) AS INTEGER) % 11 AS d FROM {_T1})",
    "j4_task_scorers": f"SELECT task_id, CAST(sum(a) AS BIGINT) AS in_a, CAST(sum(b) AS BIGINT) AS in_b FROM (SELECT id AS task_id, 1 AS a, 0 AS b FROM {_T1} UNION ALL SELECT task_id, 0, 1 FROM (SELECT DISTINCT ON (id) * FROM verifier_records)) WHERE task_id IS NOT NULL GROUP BY 1 HAVING sum(a) <> 1 OR sum(b) <> 1",
    "proj7_sides": "SELECT question_id, CASE WHEN answerability = 'answerable' THEN 'available' ELSE 'view_without_target' END AS side, CASE WHEN len(required_context_slots) > 0 THEN 'slots_missing' WHEN len(known_conflicts) > 0 THEN 'conflicting' ELSE 'plain' END AS variant FROM (SELECT DISTINCT ON (question_id) * FROM pilot_5_questions)",
    "f19_close": "SELECT event_id, abs(value - m) <= greatest(1e-9 * greatest(abs(value), abs(m)), 1e-9) AS close FROM (SELECT event_id, value, value * (1 + pow(10.0, event_id % 7 - 12.5)) AS m FROM events)",
    "f22_episode_scores": """
WITH d AS (SELECT doc_id, doc_id AS n, ['insufficient', 'exact_passage', 'finite_metric'][doc_id % 3 + 1] AS kind, length(text) AS size, text, left(text, 40) AS quote FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter([CASE WHEN n % 11 = 0 THEN 'answerability' END, CASE WHEN n % 13 = 0 OR n % 17 = 0 THEN 'scope' END,
CASE WHEN kind = 'exact_passage' AND (n % 7 = 0 OR (n % 5 = 0 AND NOT contains(text, 'no such words here')) OR trim(quote) = '') THEN 'citation_exact_and_read' END,
CASE WHEN kind = 'exact_passage' AND n % 5 = 0 OR kind = 'finite_metric' AND (n % 19 = 0 OR n % 5 = 0 AND abs(size * 0.001) > greatest(1e-9 * size * 1.001, 1e-9)) THEN 'actual_result' END,
CASE WHEN kind = 'insufficient' AND NOT (n % 2 = 0 OR n % 4 <> 1 AND n % 7 <> 0) OR kind = 'exact_passage' AND n % 7 = 0 THEN 'not_premature' END,
CASE WHEN kind = 'finite_metric' AND n % 19 = 0 THEN 'no_extra_claims' END], lambda x: x IS NOT NULL) AS failed FROM d)
SELECT doc_id, len(failed) = 0 AS passed, array_to_string(failed, ',') AS failed FROM f""",
    "w9_feedback": f"SELECT pair_id, trace_a, trace_b, changed FROM {_FEEDBACK}",
    "a29_decisions": f"""
WITH e AS (SELECT p.*, t.family, t.variant FROM (SELECT DISTINCT ON (id) id, task_id, route, input_char_count AS n, coalesce(len(messages), 0) AS calls FROM planner_sft) p JOIN (SELECT id AS task_id, task_kind AS family, variant FROM {_T1}) t USING (task_id)),
a AS (SELECT count(*) AS n, count(DISTINCT family) AS families, count(*) FILTER (n % 20 <> 0) AS relevant, count(*) FILTER (n % 3 <> 0) AS success, sum(calls) AS calls, sum(calls - CAST(n % 50 = 0 AS INTEGER)) AS valid, count(*) FILTER (variant = 'tool_error_repair') AS repairs, count(*) FILTER (variant = 'tool_error_repair' AND n % 2 = 0) AS repaired, count(DISTINCT task_id) FILTER (variant = 'tool_error_repair') AS repair_tasks FROM e),
p AS (SELECT count(*) AS pairs, count(*) FILTER (c) AS passed FROM (SELECT pair_id, bool_or(changed) AS c FROM {_FEEDBACK} GROUP BY 1)),
m AS (SELECT count(*) FILTER (p >= 2) AS multi FROM (SELECT task_id, count(DISTINCT route) AS p FROM e WHERE n % 3 <> 0 GROUP BY 1))
SELECT 'tool_understanding' AS "check", CASE WHEN families >= 2 AND relevant / n >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status, n, relevant AS hits FROM a
UNION ALL SELECT 'schema_arguments', CASE WHEN valid / calls >= 0.95 THEN 'PASS' ELSE 'FAIL' END, CAST(calls AS BIGINT), CAST(valid AS BIGINT) FROM a
UNION ALL SELECT 'feedback_adaptation', CASE WHEN pairs < 2 OR repair_tasks < 2 THEN 'BLOCK' WHEN passed / pairs >= 0.9 AND repaired / repairs >= 0.9 THEN 'PASS' ELSE 'FAIL' END, pairs + repairs, passed + repaired FROM a, p
UNION ALL SELECT 'end_to_end', CASE WHEN families >= 2 AND success / n >= 0.9 THEN 'PASS' ELSE 'FAIL' END, n, success FROM a
UNION ALL SELECT 'multiple_paths', CASE WHEN multi > 0 THEN 'PASS' ELSE 'BLOCK' END, n, multi FROM a, m""",
    "r11_sampled_groups": f"SELECT id, group_id FROM {_T1} WHERE group_id IN (SELECT g FROM (SELECT DISTINCT group_id AS g FROM {_T1}) ORDER BY md5('11:' || g), g LIMIT 5)",
    "r11_sampled_tasks": f"SELECT id, split FROM {_T1} WHERE id IN (SELECT g FROM (SELECT id AS g FROM {_T1} WHERE split = 'train') ORDER BY md5('11:' || g), g LIMIT 2)",
    "a31_selection_coverage": f"SELECT * FROM (SELECT count(*) AS pairs, count(*) FILTER (a) AS complete_pairs, count(*) FILTER (o AND a IS DISTINCT FROM true) AS partial_pairs FROM (SELECT pair_id, bool_and(split = 'dev') AS a, bool_or(split = 'dev') AS o FROM {_T1} WHERE pair_id IS NOT NULL GROUP BY 1)), (SELECT count(*) AS families, count(*) FILTER (o) AS selected_families FROM (SELECT task_kind, bool_or(split = 'dev') AS o FROM {_T1} GROUP BY 1))",
    "o5_draw_plan": "SELECT item_id, CAST(place AS BIGINT) AS place, CAST(repeat AS INTEGER) AS repeat, CAST(7 + place * 10000 + repeat * 100 AS BIGINT) AS seed FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, unnest(range(4)) AS repeat FROM eval_items)",
    "a29_thresholds": "SELECT c AS \"check\", n, hits, threshold, CASE WHEN n < least_ THEN 'BLOCK' WHEN hits / n >= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 'bound' AS c, count(*) AS n, count(task_id) AS hits, 0.9::DOUBLE AS threshold, 10 AS least_ FROM (SELECT DISTINCT ON (id) * FROM planner_sft) UNION ALL SELECT 'short', count(*) FILTER (route = 'search_read'), count(*) FILTER (route = 'search_read' AND input_char_count < 400), 0.5, 10 FROM (SELECT DISTINCT ON (id) * FROM planner_sft) UNION ALL SELECT 'expert', count(*) FILTER (expert_trajectory), count(*) FILTER (expert_trajectory), 0.9, 1000000000 FROM (SELECT DISTINCT ON (id) * FROM planner_sft))",
    "stream_event_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS \"begin\", event_type, count(*) AS events, max(value) AS most FROM events GROUP BY 1, 2",
}
