"""Constraints as tables of violations; an empty table holds the constraint.

Every check aggregates or joins on its own key and returns the violating keys
with what is wrong; ``enforce`` raises if any is there.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A constraint does not hold."""


def enforce(violations: DataFrame, what: str) -> None:
    """Raises if there are violations, naming up to five."""
    some = violations.limit(5).collect()
    if some:
        raise ConstraintError(f"{what}: {some}")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n): keys that more than one row has, and null or blank ones."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | blank)


def count_mismatch(counts: DataFrame, manifest: Mapping[str, int], name: str = "dataset") -> DataFrame:
    """(name, n, expected): datasets whose rows are not as many as the manifest says, missing ones included."""
    want = counts.sparkSession.createDataFrame(list(manifest.items()), f"{name} string, expected long")
    return counts.groupBy(name).agg(F.count("*").alias("n")).join(F.broadcast(want), name, "full").where(~F.col("n").eqNullSafe(F.col("expected")))


def split_leaks(rows: DataFrame, group: Column, split: str = "split") -> DataFrame:
    """(group, splits): groups with rows in more than one split; null groups and splits aside."""
    return rows.select(group.alias("group"), split).where(F.col("group").isNotNull() & F.col(split).isNotNull()).groupBy("group").agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def overlap_report(rows: DataFrame, keys: Mapping[str, Column], split: str = "split") -> DataFrame:
    """(kind, overlapping): how many values of each key stand in two splits or more.  ``keys`` are arrays."""

    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("kind"), v.cast("string").alias("value")))

    pairs = F.flatten(F.array(*(tagged(name, k) for name, k in keys.items())))
    values = rows.where(F.col(split).isNotNull()).select(split, F.explode(pairs).alias("p")).select(split, "p.*").where("value IS NOT NULL")
    per = values.groupBy("kind", "value").agg((F.min(split) != F.max(split)).alias("both"))
    return per.groupBy("kind").agg(F.count_if("both").alias("overlapping"))


def incomplete_pairs(rows: DataFrame, sides: Sequence[str], pair: str = "pair_id", side: str = "side", id: str = "id") -> DataFrame:
    """(pair, present, members): pairs that have not exactly one row of each side."""
    want = F.array(*(F.lit(s) for s in sorted(sides)))
    per = rows.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.array_sort(F.collect_set(side)).alias("present"), F.count_distinct(id).alias("members"))
    return per.where((F.col("present") != want) | (F.col("members") != len(sides)))


def conflicting_rows(rows: DataFrame, id: str, *columns: str) -> DataFrame:
    """(id): ids whose rows differ in the columns."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.groupBy(id).agg(F.min(text).alias("_a"), F.max(text).alias("_z")).where("_a <> _z").select(id)


def unresolved(rows: DataFrame, refs: Column, known: DataFrame, key: str, id: str) -> DataFrame:
    """(id, ref, n): references that no known key resolves, by occurrence."""
    out = rows.select(id, F.explode(refs).alias("ref")).where("ref IS NOT NULL")
    return out.join(known.select(F.col(key).alias("ref")).distinct(), "ref", "left_anti").groupBy(id, "ref").agg(F.count("*").alias("n"))


def not_subset(rows: DataFrame, part: Column, whole: Column, id: str) -> DataFrame:
    """(id, extra): members of ``part`` that ``whole`` has not; an empty or null part is a violation too, with none."""
    extra = F.array_except(F.coalesce(part, F.array().cast("array<string>")), F.coalesce(whole, F.array().cast("array<string>")))
    return rows.select(id, extra.alias("extra"), (F.coalesce(F.size(part), F.lit(0)) <= 0).alias("_none")).where((F.size("extra") > 0) | F.col("_none")).select(id, "extra")


def matching(rows: DataFrame, id: str, text: Column, pattern: str) -> DataFrame:
    """(id): rows whose text a pattern finds something in."""
    return rows.where(F.coalesce(text.rlike(pattern), F.lit(False))).select(id)


#: Characters by which long anchors are joined when they are many.
SEED = 16


def anchors_held(rows: DataFrame, id: str, text: str, anchors: DataFrame, anchor_id: str, anchor: str, block: int = 100_000) -> DataFrame:
    """(id, anchor_id): rows whose text holds an anchor, letter case aside.

    Up to ``block`` anchors are sought all at once by an automaton, in one pass
    over the rows.  More are joined by their first SEED characters with those
    that a text has at any place, and then sought in the text as a whole, in one
    pass too; of these, anchors shorter than SEED go through the automaton, in
    blocks.  Null texts and null or empty anchors hold nothing.
    """
    wanted = anchors.where(F.length(anchor) > 0).select(F.col(anchor_id).alias("_id"), F.lower(anchor).alias("_anchor")).distinct()
    kinds = f"{id} {dict(rows.dtypes)[id]}, {anchor_id} {dict(anchors.dtypes)[anchor_id]}"
    low = rows.where(F.col(text).isNotNull()).select(F.col(id), F.lower(text).alias("_text"))
    many = wanted.count() > block
    short = wanted.where(F.length("_anchor") < SEED) if many else wanted
    blocks = max(1, -(-short.count() // block)) if many else 1
    out: DataFrame | None = None
    for k in range(blocks):
        mine = [tuple(r) for r in short.where(F.pmod(F.xxhash64("_anchor"), F.lit(blocks)) == k).collect()]  # about a block
        hits = low.mapInArrow(_automaton(mine, id, anchor_id), kinds)
        out = hits if out is None else out.union(hits)
    if many:
        long = wanted.where(F.length("_anchor") >= SEED).withColumn("_seed", F.xxhash64(F.substring("_anchor", 1, SEED)))
        places = F.when(F.length("_text") >= SEED, F.transform(F.sequence(F.lit(1), F.length("_text") - SEED + 1), lambda i: F.xxhash64(F.col("_text").substr(i, F.lit(SEED)))))
        seeds = low.select(id, F.explode(F.array_distinct(places)).alias("_seed")).join(long.select("_seed").distinct(), "_seed", "left_semi")
        near = seeds.join(long, "_seed").select(id, "_id", "_anchor")
        out = out.union(near.join(low, id).where(F.contains("_text", F.col("_anchor"))).select(id, F.col("_id").alias(anchor_id)))
    return out.distinct()


def _automaton(anchors: list[tuple], id: str, anchor_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, owners = ahocorasick.Automaton(), {}
        for owner, anchor in anchors:
            owners.setdefault(anchor, []).append(owner)
        for anchor in owners:
            machine.add_word(anchor, anchor)
        if owners:
            machine.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                for anchor in {a for _, a in machine.iter(text)} if owners else ():
                    at += [k] * len(owners[anchor])
                    found += owners[anchor]
            yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(at, pa.int64())), pa.array(found, pa.string() if not found or isinstance(found[0], str) else None)], names=[id, anchor_id])

    return run


def first_failure(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that does not hold; null if all hold.  A null test does not hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(rules.items())):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def record_contract(split: Column) -> dict[str, Column]:
    """What a conversation record must be, rule by rule, over prompt, completion and metadata; ``split`` is the split that it is read for."""
    said = lambda c: F.coalesce(F.forall(c, lambda m: F.coalesce(F.trim(m["content"]) != "", F.lit(False))), F.lit(False))
    return {
        "id": F.trim("id") != "",
        "task_id": F.trim("task_id") != "",
        "split": F.col("metadata.split") == split,
        "mode": F.coalesce(F.col("metadata.dataset_mode") != "raw_source_pending_label_transfer", F.lit(True)),
        "summary_labels": F.coalesce(F.col("metadata.dataset_mode") != "expert_evidence_summary_conditioned", F.lit(True)) | F.coalesce(F.col("metadata.labels_from_exact_reviewed_original"), F.lit(False)),
        "prompt_roles": F.transform("prompt", lambda m: m["role"]) == F.array(F.lit("system"), F.lit("user")),
        "completion_role": (F.size("completion") == 1) & (F.get("completion", F.lit(0))["role"] == "assistant"),
        "content": said(F.col("prompt")) & said(F.col("completion")),
        "json": strict_json(F.get("completion", F.lit(0))["content"]).isNotNull(),
        "label": F.get_json_object(F.get("completion", F.lit(0))["content"], "$.labels.evidence_support").isin(*SUPPORT_LABELS),
    }


# The labels of evidence support, the first of them support and the second none.
SUPPORT_LABELS = ("supported", "insufficient", "contradicted", "mixed")

# The labels of each field of a verdict; those of the last three are lists of them.
LABELS = {
    "evidence_support": ("supported", "contradicted", "insufficient", "mixed"),
    "context_match": ("matched", "partially_matched", "requires_extrapolation", "mismatched", "unknown"),
    "target_causal_status": ("not_established", "candidate_supported", "established", "not_applicable", "unknown"),
    "uncertainty_expression": ("appropriate", "overconfident", "underconfident", "unstated"),
    "severity": ("none", "minor", "major", "critical"),
    "causal_evidence_in_source_study": ("observational_association", "temporal_order", "intervention", "mediation_test", "rescue_experiment", "none"),
    "causal_evidence_in_target_experiment": ("observational_association", "temporal_order", "intervention", "mediation_test", "rescue_experiment", "none"),
    "error_types": ("fabricated_source", "fabricated_result", "citation_mismatch", "direction_error", "context_mismatch", "measurement_mismatch", "causal_overclaim", "ignored_counterevidence", "inappropriate_stop", "unacknowledged_context_extrapolation", "other"),
}
LISTS = ("causal_evidence_in_source_study", "causal_evidence_in_target_experiment", "error_types")


def label_states(labels: Column, contract: Mapping[str, Sequence[str]] = LABELS, lists: Sequence[str] = LISTS) -> Column:
    """array<struct<field, state>> of a VARIANT object of labels: ok, absent (null included) or outside the contract, for each field."""

    def one(field: str) -> Column:
        value = F.try_variant_get(labels, f"$.{field}", "variant")
        kind = F.schema_of_variant(value)
        if field in lists:
            items = F.try_variant_get(value, "$", "array<string>")
            fits = kind.startswith("ARRAY") & F.forall(items, lambda x: F.coalesce(x.isin(*contract[field]), F.lit(False)))
        else:
            fits = (kind == "STRING") & F.try_variant_get(value, "$", "string").isin(*contract[field])
        return F.struct(F.lit(field).alias("field"), F.when(value.isNull() | (kind == "VOID"), "absent").when(F.coalesce(fits, F.lit(False)), "ok").otherwise("outside").alias("state"))

    return F.array(*map(one, contract))


def demonstration_faults(rows: DataFrame, steps: DataFrame, trace: str = "reference_trace_id", step: str = "trace_step_index", same: Sequence[str] = (), digest: str = "digest", messages: str = "messages", id: str = "id") -> DataFrame:
    """(id, faults): demonstrations that are not bound to a reference step, with all that is wrong, by name.

    A demonstration names a trace and step; ``steps`` has one row of each that
    was replayed, with the columns ``same`` and ``digest``.  no_reference: none
    is there.  repeated_step: another id has the same.  A column's name: it
    differs.  digest: other messages.  messages: less than two, or the first is
    not the system's or user's, or the last not the assistant's, or a later one
    is the system's.
    """
    known = steps.select(F.col(trace).alias("_t"), F.col(step).alias("_s"), *(F.col(c).alias(f"_{c}") for c in (*same, digest)), F.lit(True).alias("_known"))
    owners = rows.where(F.col(trace).isNotNull()).groupBy(trace, step).agg(F.count_distinct(id).alias("_owners")).toDF("_t2", "_s2", "_owners")
    joined = rows.join(known, (F.col(trace) == F.col("_t")) & (F.col(step) == F.col("_s")), "left").join(owners, (F.col(trace) == F.col("_t2")) & (F.col(step) == F.col("_s2")), "left")
    at = lambda i: F.try_element_at(messages, F.lit(i))["role"]
    sound = (F.size(messages) >= 2) & at(1).isin("system", "user") & (at(-1) == "assistant") & ~F.exists(F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1))), lambda m: F.coalesce(m["role"] == "system", F.lit(False)))
    there = F.col("_known").isNotNull()
    tests = [("no_reference", ~there), ("repeated_step", F.col("_owners") > 1)] + [(c, there & ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in (*same, digest)] + [("messages", ~F.coalesce(sound, F.lit(False)))]
    return joined.select(id, F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests))).alias("faults")).where(F.size("faults") > 0)


def gap_ranges(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, first, last): the runs of numbers from 0 up to a group's largest that it has not; a large gap is one row."""
    before = F.lag(number, 1, -1).over(Window.partitionBy(group).orderBy(number))
    return rows.select(group, number).where(F.col(number) >= 0).distinct().withColumn("_before", before).where(F.col(number) > F.col("_before") + 1).select(group, (F.col("_before") + 1).alias("first"), (F.col(number) - 1).alias("last"))


def multiset_difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys..., in_a, in_b): keys that two tables have not equally often."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg(F.sum("_a").alias("in_a"), F.sum("_b").alias("in_b")).where("in_a <> in_b")


def coverage_gaps(supplied: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """(keys..., side): keys that only one of the two tables has."""
    a, b = supplied.select(*keys).distinct().withColumn("_s", F.lit(1)), expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    return a.join(b, list(keys), "full").where("_s IS NULL OR _e IS NULL").select(*keys, F.when(F.col("_s").isNull(), "missing").otherwise("unexpected").alias("side"))


def unequal_to_first(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """(order, differs): rows whose columns differ from those of the first row, and in which."""
    first = rows.agg(F.min_by(F.struct(*columns), order).alias("_f"))
    differs = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_f.{c}")), F.lit(c)) for c in columns)))
    return rows.crossJoin(F.broadcast(first)).select(order, differs.alias("differs")).where(F.size("differs") > 0)


# ---- values against a schema ----


def schema_predicate(value: Column, spec: Mapping) -> Column:
    """Whether a VARIANT fits a schema of enum, object, array, string, integer and number.

    Objects have no other and all required members, arrays 20 members at most,
    strings 60,000 characters, numbers are finite and within bounds; an enum is
    tested first.  True is no number, and 1.5 no integer.
    """
    kind_of = F.schema_of_variant
    ok = F.lit(True)
    if "enum" in spec:
        ok = ok & F.variant_get(value, "$", "string").isin(*(str(x) for x in spec["enum"]))
    kind = spec.get("type")
    if kind == "object":
        members, required = spec.get("properties", {}), spec.get("required", [])
        text = F.to_json(value)
        names = F.json_object_keys(text)
        ok = ok & kind_of(value).startswith("OBJECT") & (F.size(F.array_except(names, F.array(*(F.lit(m) for m in members)) if members else F.array().cast("array<string>"))) == 0)
        for m in required:
            ok = ok & F.array_contains(names, m)
        for m, inner in members.items():
            got = F.variant_get(value, f"$.{m}", "variant")
            ok = ok & (~F.array_contains(names, m) | schema_predicate(got, inner))
    elif kind == "array":
        items = F.variant_get(value, "$", "array<variant>")
        ok = ok & kind_of(value).startswith("ARRAY") & (F.size(items) <= 20) & F.forall(items, lambda v: schema_predicate(v, spec["items"]))
    elif kind == "string":
        ok = ok & (kind_of(value) == "STRING") & (F.length(F.variant_get(value, "$", "string")) <= 60000)
    elif kind in ("integer", "number"):
        number = F.variant_get(value, "$", "double")
        ok = ok & (kind_of(value) == "BIGINT" if kind == "integer" else kind_of(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & (F.abs(number) < float("inf"))
        if "minimum" in spec:
            ok = ok & (number >= spec["minimum"])
        if "maximum" in spec:
            ok = ok & (number <= spec["maximum"])
    return F.coalesce(ok, F.lit(False))


def strict_json(text: Column) -> Column:
    """A VARIANT of a JSON text; null for one with repeated members, NaN, numbers out of range or more after its end.

    The parser already refuses repeated members and NaN; what it lets pass is
    found by comparing brackets at both ends and by overlong exponents.
    """
    bare = F.trim(text)
    closed = F.when(bare.startswith("{"), bare.endswith("}")).when(bare.startswith("["), bare.endswith("]")).when(bare.startswith('"'), bare.endswith('"')).otherwise(bare.rlike(r"^(?:true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$"))
    large = F.regexp_replace(bare, r'"(?:[^"\\]|\\.)*"', '""').rlike(r"[eE]\+?(?:3(?:09|[1-9]\d)|[4-9]\d\d|\d{4,})")
    return F.when(closed & ~large, F.try_parse_json(bare))


def exact_members(text: Column, *members: str) -> Column:
    """Whether a JSON text is an object of exactly the members."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*(F.lit(m) for m in sorted(members))), F.lit(False))
