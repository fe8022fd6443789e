"""Whether the identity of a catalogue's entry resolves, whether its own evidence supports its quality claims, and its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identity fields of each kind in their order (fixed values).
IDENTITY_FIELDS = {
    "examination_system": ["system"],
    "course": ["system", "qualification", "native_code", "specification_version"],
    "syllabus": ["system", "course_native_code", "version"],
    "container": ["system", "kind", "native_identity"],
    "question": ["system", "container_native_identity", "native_id", "number_path", "parent_native_id"],
    "answer": ["system", "question_native_id", "source", "native_answer_key"],
    "region": ["system", "document_role", "document_sha256", "page", "bbox", "coordinate_system"],
    "asset": ["system", "media_type", "sha256", "storage_mode"],
    "tag": ["scheme", "version", "code"],
    "material": ["system", "kind", "native_id", "applicability"],
    "timetable_event": ["system", "qualification", "zone", "course_native_code", "component", "date", "session"],
    "timetable_window": ["system", "qualification", "zone", "original_text", "source"],
    "coverage": ["scope_kind", "scope_native_identity", "denominator_kind"],
    "job_status": ["scope", "input_revision"],
}
#: Labels of evidence, those that bear a verified claim, kinds with answer claims, verified values and claims (fixed values).
LABELS = ["static_inspection", "synthetic_fixture", "copied_snapshot", "isolated_real_data", "live_local_service", "live_upstream_sample", "full_source_validation", "deployed_target_validation"]
AUTHORITATIVE = ["copied_snapshot", "isolated_real_data", "full_source_validation", "deployed_target_validation"]
ANSWER_KINDS = ["question", "answer"]
VERIFIED = ["source_verified", "manual_adjudicated"]
CLAIMS = ["content", "answer_presence", "answer_verification"]
#: A field that may be known to be absent, the mark of a known unknown and its stored form (fixed values).
MAY_LACK = "parent_native_id"
UNKNOWN, STORED_UNKNOWN = "\x01", "__unknown__"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _codes(*codes: Column) -> Column:
    return F.array_compact(F.array(*codes))


def identity_problems(kind: Column, fields: Column) -> Column:
    """Why a map of identity fields does not resolve for a kind, in the order of the kind's fields; a kind that is not known needs
    any field, all of them resolved, by name. A value is not resolved if it is null, empty (also `[]`, `{}`), or holds the mark of
    the unknown or its stored form; the parent of a question may lack."""

    def of_value(key: Column, value: Column) -> Column:
        code = (
            F.when(F.contains(value, F.lit(STORED_UNKNOWN)) & ((value == STORED_UNKNOWN) | F.rlike(value, F.lit(rf'^[\[{{].*"{STORED_UNKNOWN}"'))), "identity_unknown_encoding:")
            .when((value == UNKNOWN) | F.rlike(value, F.lit(r'^[\[{].*"(\\u0001|\x01)"')), "identity_unknown_value:").when(value.isNull(), "identity_none_value:").when(value.isin("", "[]", "{}"), "identity_empty_value:")
        )
        return F.when(key != MAY_LACK, F.concat(code, key))

    required = F.element_at(F.create_map(*[x for k, v in IDENTITY_FIELDS.items() for x in (F.lit(k), _strings(v))]), kind)
    of_kind = F.transform(required, lambda k: F.when(~F.array_contains(F.map_keys(fields), k), F.concat(F.lit("identity_missing_key:"), k)).otherwise(of_value(k, F.element_at(fields, k))))
    of_any = F.transform(F.array_sort(F.map_keys(fields)), lambda k: of_value(k, F.element_at(fields, k)))
    known = F.array_compact(F.when(kind.isNotNull() & required.isNotNull(), of_kind).otherwise(of_any))
    return F.when(fields.isNull(), F.array(F.lit("identity_not_mapping"))).when(F.size(fields) == 0, F.array(F.lit("identity_empty"))).otherwise(known)


def claim_problems(kind: Column, summary: Column, evidence: Column, selected: Column) -> Column:
    """The quality claims of an entry that its own evidence does not support, in a fixed order: unknown labels, answer claims of a
    kind without answers, complete content without evidence, a verified answer without its authority or decision, or beside a
    claim that something is missing. `selected` is the value that a manual decision chose; blank is none."""
    value = lambda c: F.element_at(summary, F.lit(c))
    content, presence, verification = (value(c) for c in CLAIMS)
    labels = F.coalesce(evidence, F.array().cast("array<string>"))
    odd = F.transform(F.filter(labels, lambda x: x.isNull() | ~x.isin(LABELS)), lambda x: F.concat(F.lit("unknown_evidence_label:"), F.coalesce(x, F.lit("None"))))
    answers, verified = _yes(kind.isin(ANSWER_KINDS)), _yes(verification.isin(VERIFIED))
    rest = _codes(
        F.when(~answers & (verified | _yes(presence.isin("present", "missing"))), "answer_axis_not_applicable"),
        F.when(_yes(content == "complete") & (F.size(labels) == 0), "content_claim_without_evidence"),
        F.when(answers & _yes(verification == "source_verified") & ~_yes(F.arrays_overlap(F.array_compact(labels), _strings(AUTHORITATIVE))), "verification_without_authoritative_evidence"),
        F.when(answers & _yes(verification == "manual_adjudicated") & ~_yes(F.trim(selected) != ""), "verification_without_manual_decision"),
        F.when(answers & verified & (_yes(presence == "missing") | _yes(content == "missing")), "quality_claim_contradiction"),
    )
    return F.array_distinct(F.concat(odd, rest))


def entry_quality(entries: DataFrame) -> DataFrame:
    """(public_id, identity_problems, claim_problems, state, reasons) of entries (public_id, kind, identity_fields and
    quality_summary map<string,string>, evidence_labels array<string>, selected_value).

    The state is `partial` where a claim has a problem, `unknown` where the summary names none of the three claims (a claim of null
    is named), `verified` where the content is complete and, for a kind with answers, the answer verified; else `partial`. Reasons
    are the problems, or what is missing; a verified entry has none.
    """
    kind, summary = F.col("kind"), F.coalesce("quality_summary", F.create_map().cast("map<string,string>"))
    rows = entries.select("public_id", "kind", summary.alias("_s"), identity_problems(kind, F.col("identity_fields")).alias("identity_problems"), claim_problems(kind, summary, F.col("evidence_labels"), F.col("selected_value")).alias("claim_problems"))
    said = F.arrays_overlap(F.map_keys("_s"), _strings(CLAIMS))
    whole = _yes(F.element_at("_s", F.lit("content")) == "complete")
    answered = ~_yes(kind.isin(ANSWER_KINDS)) | _yes(F.element_at("_s", F.lit("answer_verification")).isin(VERIFIED))
    bad = F.size("claim_problems") > 0
    state = F.when(bad, "partial").when(~said, "unknown").when(whole & answered, "verified").otherwise("partial")
    lacks = _codes(F.when(~whole, "content_not_complete"), F.when(~answered, "answers_not_verified"))
    reasons = F.when(bad, F.col("claim_problems")).when(~said, F.array(F.lit("no_quality_information"))).otherwise(lacks)
    return rows.select("public_id", "identity_problems", "claim_problems", state.alias("state"), reasons.alias("reasons"))


def problem_records(quality: DataFrame) -> DataFrame:
    """(public_id, code, detail): a record for an identity that does not resolve and one for claims that are not supported."""
    pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.col(c).alias("found")) for code, c in (("identity_unresolved", "identity_problems"), ("quality_claim_invalid", "claim_problems"))])
    return quality.select("public_id", F.explode(F.filter(pairs, lambda p: F.size(p["found"]) > 0)).alias("p")).select("public_id", "p.code", F.array_join("p.found", "; ").alias("detail"))
