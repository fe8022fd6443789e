"""Published coverage, completeness and quality claims. Unknown stays apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Problems that make a scope a conflict (fixed values).
CONTRADICTIONS = (
    "expected_below_published", "expected_below_exclusions", "manifest_id_not_published", "manifest_id_wrong_scope",
    "manifest_duplicate_reference", "manifest_exclusion_partial_overlap", "duplicate_public_id", "quality_claim_invalid",
)


def published_coverage(entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """Coverage of each manifest scope (id, system, kind, expected, exclusions array<string>, partial array<string>) over entries
    (public_id, system, kind, content, quality, identity_ok, claim_ok): a row for each scope with its counts, problems and status.

    Copies of an id count once; copies that differ are a problem. The manifest's exclusions and partial ids come first, then an
    unresolved identity is unknown, and the others are verified, partial or unknown by their quality. A scope without an expected number is
    unknown and has no percentage; one with a contradiction is a conflict.
    """
    key = ["system", "kind"]
    counted = entries.groupBy(*key, "public_id").agg(
        F.min(F.struct("content", "quality", "identity_ok", "claim_ok")).alias("e"), F.count("*").alias("copies"), F.count_distinct("content").alias("contents"), F.bool_and("claim_ok").alias("claims"), F.bool_and("identity_ok").alias("known")
    ).select(*key, "public_id", "copies", "contents", "claims", "known", F.col("e.quality").alias("quality"))
    named = scopes.select("id", *key, F.explode_outer(F.array_distinct(F.concat("exclusions", "partial"))).alias("public_id"), "exclusions", "partial")
    listed = named.where("public_id is not null").select("id", *key, "public_id", F.array_contains("exclusions", F.col("public_id")).alias("excluded"), F.array_contains("partial", F.col("public_id")).alias("halved"))
    inside = scopes.select("id", *key).join(counted, key).join(listed.drop(*key), ["id", "public_id"], "left")
    bucket = (
        F.when(F.coalesce("excluded", F.lit(False)), "excluded").when(F.coalesce("halved", F.lit(False)), "partial").when(~F.col("known"), "unknown")
        .when(F.col("quality") == "verified", "verified").when(F.col("quality") == "partial", "partial").otherwise("unknown")
    )
    counts = inside.withColumn("b", bucket).groupBy("id").agg(
        *[F.count_if(F.col("b") == n).alias(n) for n in ("excluded", "unknown", "partial", "verified")],
        F.array_compact(F.array(
            F.when(F.bool_or(~F.col("known")), "identity_unresolved"), F.when(F.bool_or(~F.col("claims")), "quality_claim_invalid"),
            F.when(F.bool_or((F.col("copies") > 1) & (F.col("contents") > 1)), "duplicate_public_id"), F.when(F.bool_or((F.col("copies") > 1) & (F.col("contents") == 1)), "duplicate_public_id_identical"),
        )).alias("of_entries"),
    )
    missing = scope_problems(listed.select(F.col("id").alias("scope"), *key, "public_id"), entries).groupBy(F.col("scope").alias("id")).agg(F.collect_set("code").alias("of_references"))
    none = F.array().cast("array<string>")
    twice = (F.size("exclusions") > F.size(F.array_distinct("exclusions"))) | (F.size("partial") > F.size(F.array_distinct("partial")))
    own = scopes.select("id", "expected", F.array_compact(F.array(F.when(twice, "manifest_duplicate_reference"), F.when(F.arrays_overlap("exclusions", "partial"), "manifest_exclusion_partial_overlap"))).alias("of_manifest"))
    out = own.join(counts, "id", "left").fillna(0, ["excluded", "unknown", "partial", "verified"]).join(missing, "id", "left")
    observed = F.col("excluded") + F.col("unknown") + F.col("partial") + F.col("verified")
    out = out.withColumn("observed", observed).withColumn("overfilled", F.coalesce(F.greatest(F.col("observed") - F.col("expected"), F.lit(0)), F.lit(0)))
    of_counts = F.array_compact(F.array(F.when(F.col("overfilled") > 0, "expected_below_published"), F.when(F.col("expected") < F.col("excluded"), "expected_below_exclusions")))
    problems = F.array_sort(F.array_distinct(F.concat("of_manifest", F.coalesce("of_entries", none), F.coalesce("of_references", none), of_counts)))
    out = out.withColumn("problems", problems).withColumn("accountable", F.greatest(F.col("expected") - F.col("excluded"), F.lit(0)))
    conflict = F.arrays_overlap("problems", F.array(*[F.lit(c) for c in CONTRADICTIONS]))
    status = (
        F.when(F.col("expected").isNull(), "unknown").when(conflict, "conflict")
        .when((F.col("accountable") <= 0) | (F.col("observed") < F.col("expected")) | (F.col("unknown") > 0) | (F.col("partial") > 0) | (F.col("verified") != F.col("accountable")), "partial").otherwise("complete")
    )
    percentage = F.when(F.col("expected").isNotNull() & ~conflict & (F.col("accountable") > 0), F.round(100.0 * F.col("verified") / F.col("accountable"), 2))
    unmet = F.when(F.col("expected").isNotNull(), F.greatest(F.col("expected") - F.col("observed"), F.lit(0)))
    return out.select("id", "expected", "excluded", "unknown", "partial", "verified", "observed", unmet.alias("unmet"), "overfilled", percentage.alias("percentage"), status.alias("status"), "problems")


def scope_problems(references: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest references (scope, system, kind, public_id) that are not published, or only in another scope."""
    here = entries.select("public_id", "system", "kind").distinct().withColumn("_here", F.lit(True))
    anywhere = entries.select("public_id").distinct().withColumn("_any", F.lit(True))
    j = references.join(here, ["public_id", "system", "kind"], "left").join(anywhere, "public_id", "left")
    code = F.when(F.col("_here").isNotNull(), None).when(F.col("_any").isNotNull(), "manifest_id_wrong_scope").otherwise("manifest_id_not_published")
    return j.select("scope", "public_id", code.alias("code")).where("code is not null")


def manifest_problems(scopes: DataFrame) -> DataFrame:
    """Problems of scopes (id, expected, exclusions array<string>, partial array<string>): repeated ids, repeated or
    overlapping references, and fewer expected than excluded."""
    repeated = scopes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_scope").alias("code"))
    own = lambda cond, code: scopes.where(cond).select("id", F.lit(code).alias("code"))
    twice = (F.size("exclusions") > F.size(F.array_distinct("exclusions"))) | (F.size("partial") > F.size(F.array_distinct("partial")))
    return (
        repeated.unionByName(own(twice, "manifest_duplicate_reference"))
        .unionByName(own(F.arrays_overlap("exclusions", "partial"), "manifest_exclusion_partial_overlap"))
        .unionByName(own(F.col("expected") < F.size("exclusions"), "expected_below_exclusions"))
    )


#: What each question type needs (fixed values).
REQUIREMENTS = {
    "single_choice": ("options",), "multiple_choice": ("options",), "table_choice": ("table_columns", "table_rows", "table_answer_structure"),
    "matching": ("matching_lists",), "diagram_labels": ("diagram_asset", "diagram_labels"),
    "fill_blank": ("stem",), "short_answer": ("stem",), "essay": ("stem",), "speaking": ("stem",), "unknown": ("native_shape_known",),
}


def _status(known: Column) -> list[Column]:
    done = F.col("satisfied") == F.col("requirements")
    status = F.when(~known | (F.col("requirements") == 0), "unknown").when(done, "complete").when(F.col("satisfied") == 0, "missing").otherwise("partial")
    return [F.when(known & (F.col("requirements") > 0), F.round(100.0 * F.col("satisfied") / F.col("requirements"), 2)).alias("percentage"), status.alias("status")]


def completeness(questions: DataFrame, levels: int = 6) -> DataFrame:
    """(id, parent_id, requirements, satisfied, percentage, status) of questions (id, parent_id, question_type, has
    array<string>, assets array<struct<required, present>>, expected_children int).

    A question needs what its type needs, each required asset, each of its parts to be complete, and the expected number of
    parts where that is known. Unknown types stay unknown and have no percentage. Parts are followed down `levels` levels.
    """
    need = F.coalesce(F.element_at(F.create_map(*[x for t, r in REQUIREMENTS.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in r]))]), F.col("question_type")), F.array(F.lit("native_shape_known")))
    assets = F.coalesce(F.filter("assets", lambda a: a["required"]), F.filter(F.col("assets"), lambda a: F.lit(False)), F.array().cast(questions.schema["assets"].dataType))
    own = questions.select(
        "id", "parent_id", (~F.array_contains(need, "native_shape_known")).alias("known"), "expected_children",
        (F.size(need) + F.size(assets)).alias("own_n"), (F.size(F.array_intersect(need, "has")) + F.size(F.filter(assets, lambda a: a["present"]))).alias("own_ok"),
    )

    def result(counts: DataFrame) -> DataFrame:
        counted = F.col("expected_children").isNotNull()
        n = F.col("own_n") + F.col("parts") + F.when(counted, 1).otherwise(0)
        ok = F.col("own_ok") + F.col("good") + F.when(counted & (F.col("parts") == F.col("expected_children")), 1).otherwise(0)
        filled = own.join(counts, "id", "left").fillna(0, ["parts", "good"]) if counts is not None else own.withColumn("parts", F.lit(0)).withColumn("good", F.lit(0))
        return filled.withColumn("requirements", n.cast("long")).withColumn("satisfied", ok.cast("long")).select("id", "parent_id", "requirements", "satisfied", *_status(F.col("known")))

    found = result(None)
    for _ in range(levels):
        parts = found.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("parts"), F.count_if(F.col("status") == "complete").alias("good"))
        found = result(parts)
    return found


def container_completeness(results: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, requirements, satisfied, percentage, status) over the results (container, status) of its top questions;
    containers are (container, expected int). Without a positive expected number the coverage is unknown."""
    counts = results.groupBy("container").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "complete").alias("good"))
    all_ = containers.join(counts, "container", "left").fillna(0, ["n", "good"])
    counted = F.col("expected").isNotNull()
    met = counted & (F.col("n") == F.col("expected"))
    out = all_.withColumn("requirements", F.col("n") + F.when(counted, 1).otherwise(0)).withColumn("satisfied", F.col("good") + F.when(met, 1).otherwise(0))
    return out.select("container", "requirements", "satisfied", *_status(F.coalesce(F.col("expected") > 0, F.lit(False))))


def system_coverage(rows: DataFrame) -> DataFrame:
    """Complete, partial, missing and unknown counts by system, never added up over systems."""
    return rows.groupBy("system").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "missing", "unknown")])


def quality_claims(rows: DataFrame, evidence_for: dict[str, tuple[str, ...]]) -> DataFrame:
    """Claims (id, claim, evidence array<string>) without evidence that supports them."""
    known = F.create_map(*[x for c, e in evidence_for.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in e]))])
    support = F.element_at(known, F.col("claim"))
    problem = F.when(support.isNull(), "unknown_claim").when(~F.arrays_overlap("evidence", support), "quality_claim_invalid")
    return rows.select("id", "claim", problem.alias("problem")).where("problem is not null")


#: Labels of evidence that changes of quality may rest on, by group (fixed values).
_SOURCES = ("copied_snapshot", "isolated_real_data", "full_source_validation", "deployed_target_validation")
EVIDENCE = {
    "static": ("static_inspection", "synthetic_fixture", *_SOURCES), "authoritative": _SOURCES, "counted": (*_SOURCES, "synthetic_fixture"),
    "hash": ("copied_snapshot", "isolated_real_data", "full_source_validation"), "render": ("isolated_real_data", "full_source_validation"),
}
#: Permitted changes: dimension, before, after, group of evidence, what the context must hold (fixed values).
TRANSITIONS = (
    ("content", "unknown", "missing", "static", None), ("content", "unknown", "partial", "static", None), ("content", "unknown", "complete", "counted", "denominator_known"),
    ("content", "missing", "partial", "static", None), ("content", "partial", "complete", "counted", "denominator_known"), ("content", "complete", "partial", "static", None), ("content", "partial", "missing", "static", None),
    ("answer_presence", "unknown", "present", "static", "answer_value_present"), ("answer_presence", "unknown", "missing", "static", "missing_slot_marked"),
    ("answer_presence", "present", "missing", "static", "missing_slot_marked"), ("answer_presence", "missing", "present", "authoritative", "answer_value_present"),
    ("answer_verification", "unknown", "unverified", "static", None), ("answer_verification", "unverified", "source_verified", "authoritative", None),
    ("answer_verification", "unverified", "conflicting", "static", "conflict_candidates_present"), ("answer_verification", "conflicting", "manual_adjudicated", "static", "manual_decision_present"),
    ("answer_verification", "source_verified", "conflicting", "authoritative", "conflict_candidates_present"), ("answer_verification", "manual_adjudicated", "source_verified", "authoritative", None),
    ("assets", "unknown", "external_only", "static", None), ("assets", "unknown", "missing", "static", "required_asset_missing"), ("assets", "unknown", "embedded", "hash", "asset_hash_present"),
    ("assets", "external_only", "embedded", "hash", "asset_hash_present"), ("assets", "embedded", "missing", "static", "required_asset_missing"), ("assets", "unknown", "not_applicable", "static", "no_required_assets"),
    ("audio_integrity", "unknown", "unverified", "static", None), ("audio_integrity", "unverified", "hash_verified", "hash", "asset_hash_present"),
    ("audio_integrity", "hash_verified", "hash_mismatch", "hash", "hash_mismatch_observed"), ("audio_integrity", "unknown", "not_applicable", "static", "no_required_assets"),
    ("audio_alignment", "unknown", "unverified", "static", None), ("audio_alignment", "unverified", "verified", "render", "alignment_evidence_present"),
    ("audio_alignment", "verified", "unverified", "static", None), ("audio_alignment", "unknown", "not_applicable", "static", "no_required_assets"),
    ("region_verification", "unknown", "unverified", "static", None), ("region_verification", "unverified", "verified", "render", "region_evidence_present"),
    ("region_verification", "verified", "unverified", "static", None), ("region_verification", "unknown", "not_applicable", "static", "no_regions"),
)
#: Bases that never justify a change (fixed values).
FORBIDDEN_BASIS = ("http_status_only", "two_unofficial_sources_agree", "filename_similarity", "title_similarity", "row_number", "hash_implies_alignment", "fixture_implies_real")


def transition_table(spark: SparkSession) -> DataFrame:
    """(dimension, before, after, evidence array, requires) of the permitted changes."""
    rows = [(d, a, b, list(EVIDENCE[e]), r) for d, a, b, e, r in TRANSITIONS]
    return spark.createDataFrame(rows, "dimension string, before string, after string, evidence array<string>, requires string")


def transitions(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, allowed, reason) of changes (id, dimension, before, after, label, context array<string>, basis): against the table
    of permitted changes, of any size, their evidence, what they require of the context, and bases that never count."""
    j = rows.join(allowed, ["dimension", "before", "after"], "left")
    reason = (
        F.when(F.col("basis").isin(*FORBIDDEN_BASIS), "forbidden_basis").when(F.col("basis").isNotNull(), "unrecognised_basis")
        .when(F.col("before") == F.col("after"), "no_change").when(F.col("evidence").isNull(), "not_in_table")
        .when(~F.array_contains("evidence", F.col("label")), "evidence_not_accepted")
        .when(F.col("requires").isNotNull() & ~F.coalesce(F.array_contains("context", F.col("requires")), F.lit(False)), "requirement_not_satisfied").otherwise("permitted")
    )
    return j.select("id", reason.isin("no_change", "permitted").alias("allowed"), reason.alias("reason"))
