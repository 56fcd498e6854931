"""Queries of the constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ABSOLUTE_PATH, OVERCLAIM, SECRET
from tessera.operators import validation as v
from tessera.session import table

SIDES = ("available", "view_without_target")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").drop("ingested_at").dropDuplicates(["id"])


def _paper(p):
    return F.lower(F.trim(p))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.duplicate_keys(table(spark, sf_dir, "tasks"), "id")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_records").select("dataset")
    return v.count_mismatch(rows, {"pilot_5_questions": 1, "review_pool_assessment": 1, "claim_reviews": 50})


def group_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.split_leaks(_tasks(spark, sf_dir), F.col("group_id"))


def paper_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).select("split", F.explode("paper_ids").alias("p"))
    return v.split_leaks(rows, F.nullif(_paper(F.col("p")), F.lit("")))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"pair_id": F.array("pair_id"), "group_id": F.array("group_id"), "paper_ids": F.transform("paper_ids", lambda p: F.nullif(_paper(p), F.lit(""))), "question": F.array(F.sha2("question", 256))}
    return v.overlap_report(_tasks(spark, sf_dir), keys)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.incomplete_pairs(_tasks(spark, sf_dir), SIDES)


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.conflicting_rows(table(spark, sf_dir, "tasks"), "group_id", "split", "source_version")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "review_pool_assessment").select(F.concat(F.lit("PMID:"), F.col("bibliography.pmid")).alias("pmid"))
    return v.unresolved(table(spark, sf_dir, "pilot_5_questions").dropDuplicates(["question_id"]), F.col("source_reviews"), known, "pmid", "question_id")


def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pilot_5_questions").dropDuplicates(["question_id"])
    cited = F.array_distinct(F.flatten(F.transform(F.col("required_claims"), lambda c: F.transform(F.coalesce(c["evidence"], F.array().cast("array<struct<source_review:string,span:struct<start_char:int,end_char:int>>>")), lambda e: e["source_review"]))))
    cited = F.array_compact(cited)
    return v.not_subset(rows, cited, F.col("source_reviews"), "question_id").select("question_id", F.size("extra").alias("extra"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items whose whole question stands in a document: the view must not hold it."""
    items = table(spark, sf_dir, "eval_items").select("item_id", F.col("question").alias("anchor")).where("anchor <> ''")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return v.anchors_held(docs, "doc_id", "text", items, "item_id", "anchor")


# What documents say besides, one in 97 each, so that the scans have something to find.
PLANTS = {3: "Authorization: Bearer abcdefgh12345678", 5: "api_key = 0123", 7: "sk-ABCDEFGHIJKLMNOP", 11: "this was never measured", 13: "全部文献都没有报告", 17: "no evidence anywhere", 19: "password reset"}


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the documents, some with a sentence more."""
    more = F.create_map(*(F.lit(x) for pair in PLANTS.items() for x in pair))[(F.col("doc_id") % 97).cast("int")]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", more).alias("text"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.matching(_planted(spark, sf_dir), "doc_id", F.col("text"), SECRET)


def overclaims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.matching(_planted(spark, sf_dir), "doc_id", F.col("text"), OVERCLAIM)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are before an export: every fifth still has its source file's whole path."""
    rows = table(spark, sf_dir, "verifier_records").drop("ingested_at").dropDuplicates(["id"])
    d = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    root = F.when(d % 10 == 0, "/mnt/lab/").when(d % 10 == 5, "D:\\lab\\").otherwise("")
    rows = rows.withColumn("metadata", F.col("metadata").withField("original_record", F.struct(F.concat(root, F.coalesce("metadata.original_record.file", F.lit("x.json"))).alias("file"))))
    return v.matching(rows, "id", F.to_json(F.struct(*rows.columns)), ABSOLUTE_PATH)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule each record fails first, read for its own split."""
    rows = table(spark, sf_dir, "verifier_records").drop("ingested_at").dropDuplicates(["id"])
    return rows.groupBy(F.coalesce(v.first_failure(v.record_contract(F.col("metadata.split"))), F.lit("ok")).alias("failed")).agg(F.count("*").alias("records"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the labels of the records keep the contract of each field, some records' labels having been changed."""
    rows = table(spark, sf_dir, "verifier_records").dropDuplicates(["id"])
    text = F.get("completion", F.lit(0))["content"]
    d = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    text = F.when(d % 5 == 0, F.replace(F.replace(text, F.lit('"minor"'), F.lit('"tiny"')), F.lit('"temporal_order"'), F.lit('"order"'))).otherwise(text)
    held = F.try_variant_get(v.strict_json(text), "$.labels", "variant")
    return rows.select(held.alias("l")).where("l IS NOT NULL").select(F.inline(v.label_states(F.col("l")))).groupBy("field", "state").agg(F.count("*").alias("records"))


def _digest():
    return F.md5(F.coalesce(F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))), "|"), F.lit("")).cast("binary"))


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrations against the reference steps: the row of the greatest id of each trace and step, of a sound split."""
    columns = ("id", "task_id", "split", "pair_id", "group_id", "route", "reference_trace_sha256", "input_char_count", "messages", "reference_trace_id", "trace_step_index")
    rows = table(spark, sf_dir, "planner_sft").dropDuplicates(["id"]).select(*columns).withColumn("digest", _digest())
    same = ("task_id", "split", "pair_id", "group_id", "route", "reference_trace_sha256", "input_char_count")
    steps = rows.where("reference_trace_id IS NOT NULL AND split IS NOT NULL").groupBy("reference_trace_id", "trace_step_index").agg(F.max_by(F.struct(*same, "digest"), "id").alias("x")).select("reference_trace_id", "trace_step_index", "x.*")
    return v.demonstration_faults(rows, steps, same=same).select("id", F.array_join("faults", ",").alias("faults"))


def task_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner rows against their tasks, every eighth of them moved to another split: what differs."""
    d = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int")
    rows = table(spark, sf_dir, "planner_sft").dropDuplicates(["id"]).where("task_id IS NOT NULL").select("id", "task_id", F.when(d % 8 == 0, "other").otherwise(F.col("split")).alias("split"), "pair_id")
    tasks = _tasks(spark, sf_dir).select(F.col("id").alias("task_id"), F.col("split").alias("task_split"), F.col("pair_id").alias("task_pair"))
    wrong = F.when(F.col("known").isNull(), "unknown_task").when(~F.col("split").eqNullSafe(F.col("task_split")), "split").when(~F.col("pair_id").eqNullSafe(F.col("task_pair")), "pair")
    return rows.join(tasks.withColumn("known", F.lit(1)), "task_id", "left").select("id", wrong.alias("wrong")).where("wrong IS NOT NULL")


def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of steps that traces should have by their longest step, and have not."""
    return v.gap_ranges(table(spark, sf_dir, "planner_sft").where("reference_trace_id IS NOT NULL"), "reference_trace_id", "trace_step_index")


def draw_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws (task and step) that a split's rows have not as often as train has, the splits being runs."""
    rows = table(spark, sf_dir, "planner_sft").select("split", "route", F.col("trace_step_index").alias("seed"))
    out = None
    for other in ("dev", "test"):
        part = v.multiset_difference(rows.where("split = 'train'").select("route", "seed"), rows.where(F.col("split") == other).select("route", "seed"), "route", "seed").withColumn("run", F.lit(other))
        out = part if out is None else out.unionByName(part)
    return out


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (provenances) whose budgets and settings are not those of the first."""
    rows = table(spark, sf_dir, "planner_sft").where("target_provenance IS NOT NULL")
    runs = rows.groupBy("target_provenance").agg(F.max("trace_step_index").alias("most_steps"), F.bool_or("expert_trajectory").alias("expert"), F.array_join(F.array_sort(F.collect_set("supervision")), ",").alias("supervision"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))
    return v.unequal_to_first(runs, "target_provenance", "most_steps", "expert", "supervision", "routes").select("target_provenance", F.array_join("differs", ",").alias("differs"))


def shared_demonstrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces, pairs and groups of train rows that dev or test rows have too, and tasks that no trace covers."""
    rows = table(spark, sf_dir, "planner_sft")
    parts = []
    for kind in ("reference_trace_id", "pair_id", "group_id"):
        keys = rows.select("split", F.col(kind).alias("key")).where("key IS NOT NULL")
        parts.append(keys.where("split = 'train'").select("key").intersect(keys.where("split IN ('dev', 'test')").select("key")).select(F.lit(kind).alias("kind"), "key"))
    covered = rows.where("reference_trace_id IS NOT NULL").select("task_id").distinct()
    parts.append(_tasks(spark, sf_dir).where("split IS NOT NULL").join(covered, F.col("id") == F.col("task_id"), "left_anti").select(F.lit("uncovered_task").alias("kind"), F.col("id").alias("key")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "measurements").dropDuplicates(["row_id"])
    bad = F.when(F.col("value").isNull(), "null").when(F.isnan("value"), "nan").when(F.abs("value") == float("inf"), "infinite").when(F.abs("value") > 1, "outside")
    return rows.groupBy(F.coalesce(bad, F.lit("ok")).alias("state")).agg(F.count("*").alias("rows"))


_PROPS = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}, "required": ["k"]}


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", v.strict_json(F.col("props")).alias("value"), v.exact_members(F.col("props"), "k").alias("exact"))
    return rows.groupBy("event_type").agg(F.count_if(v.schema_predicate(F.col("value"), _PROPS)).alias("valid"), F.count_if("exact").alias("exact"), F.count("*").alias("rows"))


_ACTION = {"type": "object", "properties": {"tool": {"enum": ["read_passage", "list_documents"]}, "arguments": {"type": "object", "properties": {"evidence_id": {"type": "string"}}, "required": ["evidence_id"]}}, "required": ["tool", "arguments"]}


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of tasks, some of them changed: whether they are exactly a tool and its arguments, and whether these fit the tool's schema."""
    rows = _tasks(spark, sf_dir).where("setup_action IS NOT NULL")
    d = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int") % 4
    text = F.to_json("setup_action")
    text = F.when(d == 1, F.replace(text, F.lit('{"tool":'), F.lit('{"note":1,"tool":'))).when(d == 2, F.replace(text, F.lit("read_passage"), F.lit("no_tool"))).when(d == 3, F.replace(text, F.lit('"evidence_id":'), F.lit('"id":'))).otherwise(text)
    return rows.select("id", v.exact_members(text, "tool", "arguments").alias("envelope"), v.schema_predicate(v.strict_json(text), _ACTION).alias("fits"))


_T = "(SELECT DISTINCT ON (id) * FROM tasks)"
_PAPERS = f"(SELECT split, lower(trim(p)) AS p FROM (SELECT split, unnest(paper_ids) AS p FROM {_T}))"
_LEAKS = "SELECT {g} AS \"group\", list_sort(list(DISTINCT split)) AS splits FROM {t} WHERE {g} IS NOT NULL AND split IS NOT NULL {more} GROUP BY 1 HAVING count(DISTINCT split) > 1"

_PLANTED = "(SELECT doc_id, concat_ws(' ', text, CASE doc_id % 97 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in PLANTS.items()) + " END) AS text FROM documents)"

QUERIES = {
    "v1_duplicate_keys": duplicate_ids, "v2_count_mismatch": counts, "v3_group_in_two_splits": group_leaks, "v3_paper_in_two_splits": paper_leaks, "v4_overlap_report": overlaps, "v5_incomplete_pairs": pairs,
    "v6_conflicting_rows": conflicts, "j9_unresolved_links": links, "v7_cited_not_listed": subsets, "v8_anchors_in_documents": anchors, "v9_secrets": secrets, "v10_absolute_paths": paths, "f11_overclaims": overclaims,
    "v11_v12_schema": schema_rows, "v12_action_envelopes": envelopes, "v13_v14_record_contract": records, "v14_label_contract": labels, "v15_j11_demonstrations": bindings, "v15_task_bindings": task_bindings, "v16_step_gaps": step_gaps, "v17_draw_sets": draw_sets, "v18_matched_runs": contracts, "v19_ranges": ranges, "v20_shared_demonstrations": shared_demonstrations,
}
ORACLES = {
    "v1_duplicate_keys": "SELECT id, count(*) AS n FROM tasks GROUP BY 1 HAVING count(*) > 1 OR trim(coalesce(id, '')) = ''",
    "v2_count_mismatch": "SELECT dataset, n, expected FROM (SELECT dataset, count(*) AS n FROM raw_records GROUP BY 1) FULL JOIN (SELECT * FROM (VALUES ('pilot_5_questions', CAST(1 AS BIGINT)), ('review_pool_assessment', 1), ('claim_reviews', 50)) x(dataset, expected)) USING (dataset) WHERE n IS DISTINCT FROM expected",
    "v3_group_in_two_splits": _LEAKS.format(g="group_id", t=_T, more=""),
    "v3_paper_in_two_splits": _LEAKS.format(g="p", t=_PAPERS, more="AND p <> ''"),
    "v4_overlap_report": f"SELECT kind, count(*) FILTER (n > 1) AS overlapping FROM (SELECT kind, x, count(DISTINCT split) AS n FROM (SELECT 'pair_id' AS kind, pair_id AS x, split FROM {_T} UNION ALL SELECT 'group_id', group_id, split FROM {_T} UNION ALL SELECT 'paper_ids', nullif(p, ''), split FROM {_PAPERS} UNION ALL SELECT 'question', question, split FROM {_T}) WHERE x IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "v5_incomplete_pairs": f"SELECT pair_id, list_sort(list(DISTINCT side)) AS present, count(DISTINCT id) AS members FROM {_T} WHERE pair_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT side) <> 2 OR count(DISTINCT id) <> 2",
    "v6_conflicting_rows": "SELECT group_id FROM tasks GROUP BY 1 HAVING count(DISTINCT struct_pack(a := split, b := source_version)) > 1",
    "j9_unresolved_links": "SELECT question_id, ref, count(*) AS n FROM (SELECT question_id, unnest(source_reviews) AS ref FROM (SELECT DISTINCT ON (question_id) * FROM pilot_5_questions)) WHERE ref IS NOT NULL AND ref NOT IN (SELECT 'PMID:' || bibliography.pmid FROM review_pool_assessment WHERE bibliography.pmid IS NOT NULL) GROUP BY 1, 2",
    "v7_cited_not_listed": "SELECT question_id, CAST(coalesce(len(x), 0) AS INTEGER) AS extra FROM (SELECT question_id, n, list_filter(c, lambda e: NOT list_contains(coalesce(source_reviews, []), e)) AS x FROM (SELECT question_id, source_reviews, c, len(c) AS n FROM (SELECT DISTINCT ON (question_id) question_id, source_reviews, list_distinct(list_filter(flatten(list_transform(required_claims, lambda r: list_transform(coalesce(r.evidence, []), lambda e: e.source_review))), lambda e: e IS NOT NULL)) AS c FROM pilot_5_questions))) WHERE len(x) > 0 OR coalesce(n, 0) = 0",
    "v13_v14_record_contract": """
WITH r AS (SELECT DISTINCT ON (id) *, completion[1].content AS c FROM verifier_records)
SELECT failed, count(*) AS records FROM (SELECT CASE WHEN coalesce(trim(id), '') = '' THEN 'id' WHEN coalesce(trim(task_id), '') = '' THEN 'task_id' WHEN metadata.split IS NULL THEN 'split' WHEN metadata.dataset_mode = 'raw_source_pending_label_transfer' THEN 'mode' WHEN metadata.dataset_mode = 'expert_evidence_summary_conditioned' AND metadata.labels_from_exact_reviewed_original IS DISTINCT FROM true THEN 'summary_labels'
WHEN list_transform(prompt, lambda m: m.role) IS DISTINCT FROM ['system', 'user'] THEN 'prompt_roles' WHEN NOT coalesce(len(completion) = 1 AND completion[1].role = 'assistant', false) THEN 'completion_role'
WHEN len(list_filter(list_concat(prompt, completion), lambda m: coalesce(trim(m.content), '') = '')) > 0 THEN 'content' WHEN NOT coalesce(json_valid(c), false) THEN 'json'
WHEN NOT coalesce(json_extract_string(c, '$.labels.evidence_support') IN ('supported', 'insufficient', 'contradicted', 'mixed'), false) THEN 'label' ELSE 'ok' END AS failed FROM r) GROUP BY 1""",
    "v8_anchors_in_documents": "SELECT doc_id, item_id FROM documents, eval_items WHERE question <> '' AND contains(lower(text), lower(question))",
    "v9_secrets": rf"SELECT doc_id FROM {_PLANTED} WHERE regexp_matches(text, '(?i)sk-[A-Za-z0-9_-]{{16,}}|Bearer\s+[A-Za-z0-9._-]{{16,}}|(?:api[_ -]?key|access[_ -]?token|password)\s*[:=]\s*\S+')",
    "v10_absolute_paths": r"""SELECT id FROM (SELECT id, CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) % 10 AS d, to_json(struct_pack(a := id, b := task_id, c := prompt, d := completion, e := metadata.split, f := metadata.dataset_mode, g := metadata.annotation_version)) AS j, coalesce(metadata.original_record.file, 'x.json') AS f FROM (SELECT DISTINCT ON (id) * FROM verifier_records))
WHERE d IN (0, 5) OR regexp_matches(j, '/(?:home|storage|mnt)/|(?:^|[^A-Za-z0-9])[A-Za-z]:[/\\]') OR regexp_matches('"' || f, '/(?:home|storage|mnt)/|(?:^|[^A-Za-z0-9])[A-Za-z]:[/\\]')""",
    "f11_overclaims": f"SELECT doc_id FROM {_PLANTED} WHERE regexp_matches(text, '(?i)全(?:部|体)文献.*(?:没有|不存在)|实验(?:从未|未曾|没有|未)测|never measured|no evidence anywhere|all literature')",
    "v12_action_envelopes": f"SELECT id, d <> 1 AS envelope, d = 0 AS fits FROM (SELECT id, CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) % 4 AS d FROM {_T} WHERE setup_action IS NOT NULL)",
    "v14_label_contract": f"""
WITH r AS (SELECT DISTINCT ON (id) id, completion[1].content AS c FROM verifier_records),
t AS (SELECT CASE WHEN CAST('0x' || substr(sha256(id), 1, 2) AS INTEGER) % 5 = 0 THEN replace(replace(c, '"minor"', '"tiny"'), '"temporal_order"', '"order"') ELSE c END AS c FROM r),
l AS (SELECT json_extract(c, '$.labels') AS l FROM t WHERE json_valid(c)),
f AS (SELECT l, unnest([{', '.join(f"{{'f': '{f}', 'e': [{', '.join(repr(x) for x in e)}], 'many': {str(f in v.LISTS).lower()}}}" for f, e in v.LABELS.items())}]) AS x FROM l WHERE l IS NOT NULL)
SELECT x.f AS field, CASE WHEN coalesce(json_type(l, '$.' || x.f), 'NULL') = 'NULL' THEN 'absent' WHEN coalesce(CASE WHEN x.many THEN json_type(l, '$.' || x.f) = 'ARRAY' AND len(list_filter(CAST(json_extract(l, '$.' || x.f) AS VARCHAR[]), lambda y: NOT list_contains(x.e, y))) = 0
ELSE json_type(l, '$.' || x.f) = 'VARCHAR' AND list_contains(x.e, json_extract_string(l, '$.' || x.f)) END, false) THEN 'ok' ELSE 'outside' END AS state, count(*) AS records FROM f GROUP BY 1, 2""",
    "v15_j11_demonstrations": """
WITH r AS (SELECT DISTINCT ON (id) *, md5(coalesce(array_to_string(list_transform(messages, lambda m: coalesce(m.role, '') || ':' || coalesce(m.content, '')), '|'), '')) AS digest FROM planner_sft),
s AS (SELECT DISTINCT ON (reference_trace_id, trace_step_index) * FROM r WHERE reference_trace_id IS NOT NULL AND split IS NOT NULL ORDER BY reference_trace_id, trace_step_index, id DESC),
o AS (SELECT reference_trace_id AS t, trace_step_index AS k, count(DISTINCT id) AS n FROM r WHERE reference_trace_id IS NOT NULL GROUP BY 1, 2)
SELECT id, array_to_string(f, ',') AS faults FROM (SELECT r.id, list_filter([CASE WHEN s.id IS NULL THEN 'no_reference' END, CASE WHEN o.n > 1 THEN 'repeated_step' END,
CASE WHEN s.id IS NOT NULL AND r.task_id IS DISTINCT FROM s.task_id THEN 'task_id' END,
CASE WHEN s.id IS NOT NULL AND r.split IS DISTINCT FROM s.split THEN 'split' END,
CASE WHEN s.id IS NOT NULL AND r.pair_id IS DISTINCT FROM s.pair_id THEN 'pair_id' END,
CASE WHEN s.id IS NOT NULL AND r.group_id IS DISTINCT FROM s.group_id THEN 'group_id' END,
CASE WHEN s.id IS NOT NULL AND r.route IS DISTINCT FROM s.route THEN 'route' END,
CASE WHEN s.id IS NOT NULL AND r.reference_trace_sha256 IS DISTINCT FROM s.reference_trace_sha256 THEN 'reference_trace_sha256' END,
CASE WHEN s.id IS NOT NULL AND r.input_char_count IS DISTINCT FROM s.input_char_count THEN 'input_char_count' END,
CASE WHEN s.id IS NOT NULL AND r.digest IS DISTINCT FROM s.digest THEN 'digest' END,
CASE WHEN NOT coalesce(len(r.messages) >= 2 AND r.messages[1].role IN ('system', 'user') AND r.messages[-1].role = 'assistant' AND len(list_filter(r.messages[2:], lambda m: coalesce(m.role = 'system', false))) = 0, false) THEN 'messages' END], lambda x: x IS NOT NULL) AS f
FROM r LEFT JOIN s ON r.reference_trace_id = s.reference_trace_id AND r.trace_step_index = s.trace_step_index LEFT JOIN o ON o.t = r.reference_trace_id AND o.k = r.trace_step_index) WHERE len(f) > 0""",
    "v15_task_bindings": f"SELECT id, wrong FROM (SELECT p.id, CASE WHEN t.id IS NULL THEN 'unknown_task' WHEN CASE WHEN CAST('0x' || substr(sha256(p.id), 1, 2) AS INTEGER) % 8 = 0 THEN 'other' ELSE p.split END IS DISTINCT FROM t.split THEN 'split' WHEN p.pair_id IS DISTINCT FROM t.pair_id THEN 'pair' END AS wrong FROM (SELECT DISTINCT ON (id) * FROM planner_sft WHERE task_id IS NOT NULL) p LEFT JOIN {_T} t ON t.id = p.task_id) WHERE wrong IS NOT NULL",
    "v16_step_gaps": "SELECT t AS reference_trace_id, CAST(b + 1 AS INTEGER) AS first, CAST(s - 1 AS INTEGER) AS last FROM (SELECT t, s, lag(s, 1, -1) OVER (PARTITION BY t ORDER BY s) AS b FROM (SELECT DISTINCT reference_trace_id AS t, trace_step_index AS s FROM planner_sft WHERE reference_trace_id IS NOT NULL AND trace_step_index >= 0)) WHERE s > b + 1",
    "v17_draw_sets": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT route, trace_step_index AS seed, count(*) FILTER (split = 'train') AS in_a, count(*) FILTER (split = '{o}') AS in_b, '{o}' AS run FROM planner_sft WHERE split IN ('train', '{o}') GROUP BY 1, 2" for o in ("dev", "test")) + ") WHERE in_a <> in_b",
    "v18_matched_runs": """
WITH r AS (SELECT target_provenance AS p, max(trace_step_index) AS a, bool_or(expert_trajectory) AS b, string_agg(DISTINCT supervision, ',' ORDER BY supervision) AS c, string_agg(DISTINCT route, ',' ORDER BY route) AS d FROM planner_sft WHERE target_provenance IS NOT NULL GROUP BY 1),
f AS (SELECT * FROM r ORDER BY p LIMIT 1)
SELECT target_provenance, array_to_string(x, ',') AS differs FROM (SELECT r.p AS target_provenance, list_filter([CASE WHEN r.a IS DISTINCT FROM f.a THEN 'most_steps' END, CASE WHEN r.b IS DISTINCT FROM f.b THEN 'expert' END, CASE WHEN r.c IS DISTINCT FROM f.c THEN 'supervision' END, CASE WHEN r.d IS DISTINCT FROM f.d THEN 'routes' END], lambda x: x IS NOT NULL) AS x FROM r, f) WHERE len(x) > 0""",
    "v19_ranges": "SELECT CASE WHEN value IS NULL THEN 'null' WHEN isnan(value) THEN 'nan' WHEN isinf(value) THEN 'infinite' WHEN abs(value) > 1 THEN 'outside' ELSE 'ok' END AS state, count(*) AS rows FROM (SELECT DISTINCT ON (row_id) * FROM measurements) GROUP BY 1",
    "v20_shared_demonstrations": " UNION ALL ".join(f"SELECT '{k}' AS kind, key FROM (SELECT {k} AS key FROM planner_sft WHERE split = 'train' AND {k} IS NOT NULL INTERSECT SELECT {k} FROM planner_sft WHERE split IN ('dev', 'test'))" for k in ("reference_trace_id", "pair_id", "group_id")) + f" UNION ALL SELECT 'uncovered_task', id FROM {_T} WHERE split IS NOT NULL AND id NOT IN (SELECT task_id FROM planner_sft WHERE reference_trace_id IS NOT NULL AND task_id IS NOT NULL)",
    "v11_v12_schema": "SELECT event_type, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 90) AS valid, count(*) FILTER (json_keys(props) = ['k']) AS exact, count(*) AS rows FROM events GROUP BY 1",
}
