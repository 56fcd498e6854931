"""Queries of the annotation review operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import natural_key, record_text, tag_value, with_aliases
from tessera.functions.unicode import search_form
from tessera.operators import review as rv
from tessera.operators.validation import SUPPORT_LABELS
from tessera.session import table

VERIFIED = "local_xml_verified_in_manifest"
# Signs that a search text repeats in words.
ALIASES = {"β": " beta ", "Ca²⁺": " Ca2+ calcium ", "Δψm": " membrane potential delta psi "}
DECISIONS = ("accept", "accept_with_edits", "reject", "uncertain")
DETECTORS = ("regex", "human", "model")
DEFECTS = ("direction", "scope", "unit", "cause")


def _pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pilot_5_questions").drop("ingested_at").dropDuplicates(["question_id"])


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review_pool_assessment").drop("ingested_at").dropDuplicates(["assessment_id"])


def _some(c: str):
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _pick(values, key: str, n: int = 1):
    """One of the values, by a hash of a key; a null among them stays one."""
    d = F.conv(F.substring(F.sha2(key, 256), n, 2), 16, 10).cast("int")
    return F.element_at(F.array(*(F.lit(x) for x in values)), d % len(values) + 1)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim reviews, made of the required claims of the questions: decisions and defects follow from the id."""
    rows = _pilot(spark, sf_dir).select("question_id", "answerability", "needs_human_verification", F.posexplode("required_claims").alias("i", "c")).where("c IS NOT NULL")
    rows = rows.withColumn("statement_id", F.concat("question_id", F.lit(":"), "i"))
    d = F.conv(F.substring(F.sha2("statement_id", 256), 3, 2), 16, 10).cast("int")
    named = F.transform(F.filter("c.evidence", lambda e: e.isNotNull()), lambda e: e["source_review"])
    return rows.select(
        "statement_id", F.col("c.text").alias("triple"), F.col("question_id").alias("paper_short"), _pick(DECISIONS, "statement_id").alias("ai_decision"), F.col("c.ai_confidence").alias("ai_confidence"), F.col("c.is_core").alias("usable"),
        named.alias("recorded_conditions"), F.slice(F.array(*map(F.lit, DEFECTS)), 1, d % 3).alias("defect_codes"), F.col("answerability").alias("source_type"), "needs_human_verification",
    )


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminology rules, made of the prohibited inferences of the questions; what a rule was observed in are claims of its question."""
    rows = _pilot(spark, sf_dir).select("question_id", "question_type", "scope", "needs_human_verification", F.posexplode("prohibited_inferences").alias("i", "wrong")).where("wrong IS NOT NULL")
    rows = rows.withColumn("rule_id", F.concat("question_id", F.lit("!"), "i"))
    d = F.conv(F.substring(F.sha2("rule_id", 256), 5, 2), 16, 10).cast("int")
    seen = F.when(d % 5 != 0, F.transform(F.sequence(F.lit(0), d % 3), lambda k: F.concat("question_id", F.lit(":"), k)))
    return rows.select("rule_id", "wrong", F.col("question_type").alias("category"), _pick(DETECTORS, "rule_id").alias("detector"), _pick(("high", "medium", "low", None), "rule_id", 3).alias("ai_confidence"), seen.alias("observed_in"), F.array_compact(F.array("scope")).alias("dimensions"), "needs_human_verification")


def _searched(df: DataFrame):
    return search_form(with_aliases(record_text(df), ALIASES)).alias("search_text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, id, title, subtitle, status, confidence, flags, search_text) of the four datasets; the search text is of the whole record."""
    text = lambda c: F.coalesce(c, F.lit(""))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    none = F.lit(None).cast("string")
    unsure = F.coalesce(F.col("ai_confidence").isin("low", "medium"), F.lit(False))

    def of(df: DataFrame, dataset: str, id: str, title, subtitle, status, confidence, rules) -> DataFrame:
        return df.select(F.lit(dataset).alias("dataset"), F.col(id).alias("id"), title.alias("title"), text(subtitle).alias("subtitle"), unknown(status).alias("status"), confidence.alias("confidence"), rv.flags(rules).alias("flags"), _searched(df))

    grades = F.transform("required_claims", lambda c: c["ai_confidence"])
    low, medium = F.coalesce(F.array_contains(grades, "low"), F.lit(False)), F.coalesce(F.array_contains(grades, "medium"), F.lit(False))
    parts = (
        of(_pilot(spark, sf_dir), "pilot_questions", "question_id", F.col("question"), F.col("question_type"), F.col("answerability"), none,
           {"no_evidence_anchor": ~_some("evidence_papers"), "low_confidence": low, "medium_confidence": medium & ~low, "open_checks": _some("needs_human_verification")}),
        of(_claims(spark, sf_dir), "claim_reviews", "statement_id", F.col("triple"), F.col("paper_short"), F.col("ai_decision"), F.col("ai_confidence"),
           {"decision": F.col("ai_decision").isin("uncertain", "reject"), "not_high_confidence": unsure, "usability_unknown": F.col("usable").isNull(), "not_usable": ~F.coalesce("usable", F.lit(True)), "no_conditions": ~_some("recorded_conditions"), "open_checks": _some("needs_human_verification")}),
        of(_terms(spark, sf_dir), "terminology_rules", "rule_id", F.col("wrong"), F.col("category"), F.col("detector"), F.col("ai_confidence"),
           {"not_high_confidence": unsure, "not_observed": F.col("observed_in").isNull(), "by_human": F.col("detector") == "human", "open_checks": _some("needs_human_verification")}),
        of(_pool(spark, sf_dir), "review_pool", "assessment_id", F.coalesce("bibliography.title", "assessment_id"), F.concat(F.coalesce(F.col("bibliography.year").cast("string"), F.lit("?")), F.lit(" · PMID "), F.coalesce("bibliography.pmid", F.lit("—"))), F.col("fulltext.status"), none,
           {"no_full_text": F.coalesce(F.col("fulltext.status") != VERIFIED, F.lit(True)), "no_pmcid": F.coalesce(F.col("bibliography.pmcid") == "", F.lit(True)), "caveats": _some("caveats"), "open_checks": _some("required_human_checks")}),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _presets() -> dict:
    """Ready-made filters: the dataset of each, and what its records must be."""
    has = lambda flag: F.array_contains("flags", flag)
    return {
        "usable_claims": ("claim_reviews", ~has("usability_unknown") & ~has("not_usable")),
        "claims_to_attend": ("claim_reviews", F.col("status").isin("accept_with_edits", "reject", "uncertain")),
        "rules_by_human": ("terminology_rules", F.col("status") == "human"),
        "reviews_with_full_text": ("review_pool", F.col("status") == VERIFIED),
    }


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("dataset", "id", "title", "subtitle", "status", "confidence")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("dataset", "id", "status", F.array_join("flags", "|").alias("flags"))


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.ranked_counter(records(spark, sf_dir), F.col("flags"), "flag")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rv.faceted(records(spark, sf_dir), dataset="review_pool", flagged=True, query=" ISLET ")
    return hits.select("id", "title", F.size("flags").alias("flags")).orderBy(F.desc("flags"), natural_key(F.col("id")))


def filtered_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters at once: dataset, preset, status, flagged and a query."""
    dataset, preset = _presets()["claims_to_attend"]
    hits = rv.faceted(records(spark, sf_dir), dataset=dataset, status="reject", preset=preset, flagged=True, query="Islet")
    return hits.select("id", "title", F.size("flags").alias("flags"))


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each ready-made filter has."""
    rows = records(spark, sf_dir)
    counts = F.array(*(F.struct(F.lit(name).alias("preset"), F.count_if((F.col("dataset") == dataset) & test).alias("records")) for name, (dataset, test) in _presets().items()))
    return rows.agg(counts.alias("x")).select(F.inline("x"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.counter(_pool(spark, sf_dir), "ai_decision")


def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _pilot(spark, sf_dir).select(F.explode("required_claims").alias("c")).select(F.col("c.is_core").alias("is_core"))
    return rv.counter(claims, "is_core")


def decision_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pool(spark, sf_dir).groupBy("pool_role", "ai_decision").agg(F.count("*").alias("n"))
    return rv.shares(counts, ["pool_role"], "ai_decision").withColumn("share", F.round("share", 9))


def coverage_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.ranked_counter(_pool(spark, sf_dir), F.col("coverage"), "topic")


def pilot_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pilot(spark, sf_dir)
    core = F.filter("required_claims", lambda c: c["is_core"])
    return rows.agg(F.count("*").alias("questions"), rv.length_sum("required_claims").alias("required_claims"), F.coalesce(F.sum(F.size(core)), F.lit(0)).cast("long").alias("core_claims"), rv.length_sum("source_reviews").alias("source_links"), rv.filled("source_reviews").alias("with_sources"), rv.filled("evidence_papers").alias("with_papers"), F.count_if(F.exists(F.coalesce("required_claims", F.array().cast(dict(rows.dtypes)["required_claims"])), lambda c: F.coalesce(F.size(c["evidence"]), F.lit(0)) > 0)).alias("with_evidence"), rv.length_sum("prohibited_inferences").alias("prohibited"), rv.length_sum("known_conflicts").alias("conflicts"), F.count_if(F.col("known_conflicts").isNull()).alias("conflicts_not_checked"), rv.length_sum("needs_human_verification").alias("checks"))


def pool_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, refs = F.col("bibliography.year"), F.coalesce("reference_count", F.lit(0))
    return _pool(spark, sf_dir).agg(F.count("*").alias("reviews"), F.count_if(F.col("fulltext.status") == VERIFIED).alias("verified"), F.count_if(F.coalesce(F.col("bibliography.pmcid"), F.lit("")) != "").alias("with_pmcid"), F.sum(refs).alias("refs"), F.min(refs).alias("fewest_refs"), F.max(refs).alias("most_refs"), F.bround(F.avg(refs), 2).alias("mean_refs"), F.count_if(F.coalesce(year, F.lit(0)) >= 2024).alias("since_2024"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def claim_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).agg(F.count("*").alias("claims"), rv.filled("recorded_conditions").alias("with_conditions"), (F.count("*") - rv.filled("recorded_conditions")).alias("without_conditions"), rv.filled("defect_codes").alias("with_defects"), rv.length_sum("defect_codes").alias("defects"), F.count_if("usable").alias("usable"), F.count_if(F.col("usable").isNull()).alias("usability_unknown"))


def claim_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.ranked_counter(_claims(spark, sf_dir), F.col("defect_codes"), "defect")


def term_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = _terms(spark, sf_dir), _claims(spark, sf_dir)
    plain = rows.agg(F.count("*").alias("rules"), F.count("observed_in").alias("checked"), F.count_if(F.col("observed_in").isNull()).alias("unchecked"), rv.filled("needs_human_verification").alias("with_checks"))
    return plain.crossJoin(F.broadcast(rv.link_counts(rows, F.col("observed_in"), known, "statement_id")))


def term_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.ranked_counter(_terms(spark, sf_dir), F.col("dimensions"), "dimension")


def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.counter(_terms(spark, sf_dir), "ai_confidence")


def claim_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and the terminology rules that were observed in them."""
    return rv.linked(_terms(spark, sf_dir), "rule_id", F.col("observed_in"), _claims(spark, sf_dir), "statement_id", "statement_id").select("rule_id", "statement_id")


def dataset_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("records"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_distinct("status").alias("statuses"))


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir).select("assessment_id", F.col("bibliography.pmid").alias("pmid"))
    return rv.linked(_pilot(spark, sf_dir), "question_id", F.transform("source_reviews", lambda s: tag_value(s)), pool, "assessment_id", "pmid")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir).select(F.col("bibliography.pmid").alias("pmid"))
    return rv.link_counts(_pilot(spark, sf_dir), F.transform("source_reviews", lambda s: tag_value(s)), pool, "pmid")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "verifier_records").dropDuplicates(["id"])
    label = F.get_json_object(F.get("completion", F.lit(0))["content"], "$.labels.evidence_support")
    return rows.groupBy(F.col("metadata.split").alias("split")).agg(F.count("*").alias("records"), F.count_distinct("task_id").alias("tasks"), *(F.count_if(label == x).alias(x) for x in SUPPORT_LABELS))


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tasks").dropDuplicates(["id"]).groupBy("split", "task_kind").agg(F.count("*").alias("tasks"), F.count_distinct("pair_id").alias("pairs"))


_P = "(SELECT DISTINCT ON (question_id) * FROM pilot_5_questions)"
_R = "(SELECT DISTINCT ON (assessment_id) * FROM review_pool_assessment)"
_HASH = "CAST('0x' || substr(sha256({}), {}, 2) AS INTEGER)"
_CL = f"""(SELECT question_id || ':' || i AS id, c.text AS title, question_id AS q, ['accept', 'accept_with_edits', 'reject', 'uncertain'][{_HASH.format("question_id || ':' || i", 1)} % 4 + 1] AS decision, c.ai_confidence AS confidence, c.is_core AS usable, coalesce(len(list_filter(c.evidence, lambda e: e IS NOT NULL)), 0) AS conditions,
['direction', 'scope', 'unit', 'cause'][1:{_HASH.format("question_id || ':' || i", 3)} % 3] AS defects, answerability, needs_human_verification AS checks, c FROM (SELECT question_id, answerability, needs_human_verification, unnest(required_claims) AS c, unnest(range(len(required_claims))) AS i FROM {_P}) WHERE c IS NOT NULL)"""
_TE = f"""(SELECT *, CASE WHEN {_HASH.format("id", 5)} % 5 <> 0 THEN list_transform(range({_HASH.format("id", 5)} % 3 + 1), lambda k: question_id || ':' || k) END AS seen, ['regex', 'human', 'model'][{_HASH.format("id", 1)} % 3 + 1] AS detector, ['high', 'medium', 'low', NULL][{_HASH.format("id", 3)} % 4 + 1] AS confidence
FROM (SELECT question_id, question_id || '!' || i AS id, wrong AS title, question_type AS category, scope, needs_human_verification AS checks FROM (SELECT question_id, question_type, scope, needs_human_verification, unnest(prohibited_inferences) AS wrong, unnest(range(len(prohibited_inferences))) AS i FROM {_P}) WHERE wrong IS NOT NULL))"""
_FLAGS = f"""(SELECT dataset, id, title, coalesce(subtitle, '') AS subtitle, coalesce(status, 'unknown') AS status, confidence, list_filter(flags, lambda x: x IS NOT NULL) AS flags, search_text FROM (
SELECT 'pilot_questions' AS dataset, question_id AS id, question AS title, question_type AS subtitle, answerability AS status, NULL AS confidence, [CASE WHEN coalesce(len(evidence_papers), 0) = 0 THEN 'no_evidence_anchor' END,
CASE WHEN coalesce(list_contains(g, 'low'), false) THEN 'low_confidence' END, CASE WHEN coalesce(list_contains(g, 'medium'), false) AND NOT coalesce(list_contains(g, 'low'), false) THEN 'medium_confidence' END, CASE WHEN coalesce(len(needs_human_verification), 0) > 0 THEN 'open_checks' END] AS flags,
'' AS search_text FROM (SELECT *, list_transform(required_claims, lambda c: c.ai_confidence) AS g FROM {_P})
UNION ALL SELECT 'claim_reviews', id, title, q, decision, confidence, [CASE WHEN decision IN ('uncertain', 'reject') THEN 'decision' END, CASE WHEN confidence IN ('low', 'medium') THEN 'not_high_confidence' END, CASE WHEN usable IS NULL THEN 'usability_unknown' END, CASE WHEN NOT usable THEN 'not_usable' END,
CASE WHEN conditions = 0 THEN 'no_conditions' END, CASE WHEN coalesce(len(checks), 0) > 0 THEN 'open_checks' END], lower(to_json([CAST(to_json(title) AS VARCHAR), CAST(to_json(checks) AS VARCHAR)])) FROM {_CL}
UNION ALL SELECT 'terminology_rules', id, title, category, detector, confidence, [CASE WHEN confidence IN ('low', 'medium') THEN 'not_high_confidence' END, CASE WHEN seen IS NULL THEN 'not_observed' END, CASE WHEN detector = 'human' THEN 'by_human' END, CASE WHEN coalesce(len(checks), 0) > 0 THEN 'open_checks' END], '' FROM {_TE}
UNION ALL SELECT 'review_pool', assessment_id, coalesce(bibliography.title, assessment_id), coalesce(CAST(bibliography.year AS VARCHAR), '?') || ' · PMID ' || coalesce(bibliography.pmid, '—'), fulltext.status, NULL, [CASE WHEN coalesce(fulltext.status <> '{VERIFIED}', true) THEN 'no_full_text' END, CASE WHEN coalesce(bibliography.pmcid = '', true) THEN 'no_pmcid' END,
CASE WHEN coalesce(len(caveats), 0) > 0 THEN 'caveats' END, CASE WHEN coalesce(len(required_human_checks), 0) > 0 THEN 'open_checks' END], lower(CAST(to_json(r) AS VARCHAR)) FROM {_R} r))"""
_RANKED = "SELECT {n}, n, CAST(row_number() OVER (ORDER BY n DESC, {n}) AS INTEGER) AS rank FROM (SELECT {n}, count(*) AS n FROM (SELECT unnest({c}) AS {n} FROM {t}) WHERE {n} IS NOT NULL GROUP BY 1)"
_REFS = f"(SELECT question_id, nullif(regexp_extract(s, '^PMID:(.+)$', 1), '') AS ref FROM (SELECT question_id, unnest(source_reviews) AS s FROM {_P}))"

QUERIES = {
    "proj8_display": display, "proj5_preset_filter": filtered_preset, "a23_claim_kpis": claim_kpis, "a22_claim_defects": claim_defects, "a23_term_kpis": term_kpis, "a22_term_dimensions": term_dimensions, "a21_term_confidence": detectors, "j10_claim_terms": claim_terms,
    "proj9_flags": flagged, "a22_flag_counts": flag_counts, "proj5_filtered": filtered, "proj6_presets": presets, "a21_decisions": decisions, "a21_core_claims": cores, "a35_decision_shares": decision_shares, "a22_topics": coverage_topics,
    "a23_pilot_kpis": pilot_kpis, "a23_pool_kpis": pool_kpis, "a24_dataset_kpis": dataset_kpis, "j9_related": related, "j12_link_counts": links, "a32_export_counts": exports, "a27_build_counts": builds,
}
ORACLES = {
    "proj8_display": f"SELECT dataset, id, title, subtitle, status, confidence FROM {_FLAGS}",
    "proj5_preset_filter": f"SELECT id, title, CAST(len(flags) AS INTEGER) AS flags FROM {_FLAGS} WHERE dataset = 'claim_reviews' AND status = 'reject' AND len(flags) > 0 AND contains(search_text, 'islet')",
    "a23_claim_kpis": f"SELECT count(*) AS claims, count(*) FILTER (conditions > 0) AS with_conditions, count(*) FILTER (conditions = 0) AS without_conditions, count(*) FILTER (len(defects) > 0) AS with_defects, CAST(sum(len(defects)) AS BIGINT) AS defects, count(*) FILTER (usable) AS usable, count(*) FILTER (usable IS NULL) AS usability_unknown FROM {_CL}",
    "a22_claim_defects": _RANKED.format(n="defect", c="defects", t=_CL),
    "a23_term_kpis": f"SELECT * FROM (SELECT count(*) AS rules, count(seen) AS checked, count(*) FILTER (seen IS NULL) AS unchecked, count(*) FILTER (len(checks) > 0) AS with_checks FROM {_TE}), (SELECT count(*) AS occurrences, count(DISTINCT ref) AS distinct_refs, count(*) FILTER (ref IN (SELECT id FROM {_CL})) AS resolvable FROM (SELECT unnest(seen) AS ref FROM {_TE}))",
    "a22_term_dimensions": _RANKED.format(n="dimension", c="[scope]", t=_TE),
    "a21_term_confidence": f"SELECT coalesce(confidence, 'unknown') AS ai_confidence, count(*) AS n FROM {_TE} GROUP BY 1",
    "j10_claim_terms": f"SELECT DISTINCT t.id AS rule_id, c.id AS statement_id FROM (SELECT id, unnest(seen) AS ref FROM {_TE}) t JOIN {_CL} c ON c.id = t.ref",
    "proj9_flags": f"SELECT dataset, id, status, array_to_string(flags, '|') AS flags FROM {_FLAGS}",
    "a22_flag_counts": _RANKED.format(n="flag", c="flags", t=_FLAGS),
    "proj5_filtered": f"SELECT id, title, CAST(len(flags) AS INTEGER) AS flags FROM {_FLAGS} WHERE dataset = 'review_pool' AND len(flags) > 0 AND contains(search_text, 'islet')",
    "proj6_presets": f"SELECT p AS preset, n AS records FROM (SELECT unnest([{{'p': 'usable_claims', 'n': count(*) FILTER (dataset = 'claim_reviews' AND NOT list_contains(flags, 'usability_unknown') AND NOT list_contains(flags, 'not_usable'))}}, {{'p': 'claims_to_attend', 'n': count(*) FILTER (dataset = 'claim_reviews' AND status IN ('accept_with_edits', 'reject', 'uncertain'))}}, {{'p': 'rules_by_human', 'n': count(*) FILTER (dataset = 'terminology_rules' AND status = 'human')}}, {{'p': 'reviews_with_full_text', 'n': count(*) FILTER (dataset = 'review_pool' AND status = '{VERIFIED}')}}], recursive := true) FROM {_FLAGS})",
    "a21_decisions": f"SELECT coalesce(ai_decision, 'unknown') AS ai_decision, count(*) AS n FROM {_R} GROUP BY 1",
    "a21_core_claims": f"SELECT CASE WHEN c.is_core THEN 'True' WHEN NOT c.is_core THEN 'False' ELSE 'unknown' END AS is_core, count(*) AS n FROM (SELECT unnest(required_claims) AS c FROM {_P}) GROUP BY 1",
    "a35_decision_shares": f"SELECT pool_role, ai_decision, n, round(n / sum(n) OVER (PARTITION BY pool_role), 9) AS share FROM (SELECT pool_role, ai_decision, count(*) AS n FROM {_R} GROUP BY 1, 2)",
    "a22_topics": _RANKED.format(n="topic", c="coverage", t=_R),
    "a23_pilot_kpis": f"SELECT count(*) AS questions, CAST(coalesce(sum(len(required_claims)), 0) AS BIGINT) AS required_claims, CAST(coalesce(sum(len(list_filter(required_claims, lambda c: c.is_core))), 0) AS BIGINT) AS core_claims, CAST(sum(len(source_reviews)) AS BIGINT) AS source_links, count(*) FILTER (len(source_reviews) > 0) AS with_sources, count(*) FILTER (len(evidence_papers) > 0) AS with_papers, count(*) FILTER (len(list_filter(required_claims, lambda c: len(c.evidence) > 0)) > 0) AS with_evidence, CAST(sum(len(prohibited_inferences)) AS BIGINT) AS prohibited, CAST(sum(len(known_conflicts)) AS BIGINT) AS conflicts, count(*) FILTER (known_conflicts IS NULL) AS conflicts_not_checked, CAST(sum(len(needs_human_verification)) AS BIGINT) AS checks FROM {_P}",
    "a23_pool_kpis": f"SELECT count(*) AS reviews, count(*) FILTER (fulltext.status = '{VERIFIED}') AS verified, count(*) FILTER (coalesce(bibliography.pmcid, '') <> '') AS with_pmcid, CAST(sum(coalesce(reference_count, 0)) AS BIGINT) AS refs, min(coalesce(reference_count, 0)) AS fewest_refs, max(coalesce(reference_count, 0)) AS most_refs, round_even(avg(coalesce(reference_count, 0)), 2) AS mean_refs, count(*) FILTER (bibliography.year >= 2024) AS since_2024, min(bibliography.year) AS first_year, max(bibliography.year) AS last_year FROM {_R}",
    "a24_dataset_kpis": f"SELECT dataset, count(*) AS records, count(*) FILTER (len(flags) > 0) AS flagged, count(DISTINCT status) AS statuses FROM {_FLAGS} GROUP BY 1",
    "j9_related": f"SELECT DISTINCT question_id, assessment_id, ref FROM {_REFS} JOIN {_R} r ON r.bibliography.pmid = ref",
    "j12_link_counts": f"SELECT count(ref) AS occurrences, count(DISTINCT ref) AS distinct_refs, count(*) FILTER (ref IN (SELECT bibliography.pmid FROM {_R})) AS resolvable FROM {_REFS}",
    "a32_export_counts": "SELECT split, count(*) AS records, count(DISTINCT task_id) AS tasks, count(*) FILTER (t = 'supported') AS supported, count(*) FILTER (t = 'insufficient') AS insufficient, count(*) FILTER (t = 'contradicted') AS contradicted, count(*) FILTER (t = 'mixed') AS mixed FROM (SELECT DISTINCT ON (id) id, task_id, metadata.split AS split, CASE WHEN json_valid(completion[1].content) THEN json_extract_string(completion[1].content, '$.labels.evidence_support') END AS t FROM verifier_records) GROUP BY 1",
    "a27_build_counts": "SELECT split, task_kind, count(*) AS tasks, count(DISTINCT pair_id) AS pairs FROM (SELECT DISTINCT ON (id) * FROM tasks) GROUP BY 1, 2",
}
