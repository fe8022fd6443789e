"""Reports over a batch of work and a board's pipeline, and the upserts that a crawl and a specification make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages from which a paper has been downloaded, and those behind its verification, in order (fixed values).
DOWNLOADED = ("downloaded", "parsing_qp", "parsing_ms", "verifying_local", "validation_partial", "imported_verified", "cleanup_pending", "cleaned")
VERIFIED = ("imported_verified", "cleanup_pending", "cleaned")
#: Stages of the cleanup log; records of other stages are sweeps (fixed values).
CLEANUP = ("cleaned", "cleanup_pending", "cleanup_failed")
#: Kinds of errors that are failed downloads (fixed values).
DOWNLOAD_ERRORS = ("download_error", "download_failed", "download_exception")


def _long(row: DataFrame, section: str) -> DataFrame:
    """A one-row frame of counts as (section, name, value)."""
    pairs = [F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("value")) for c in row.columns]
    return row.select(F.lit(section).alias("section"), F.explode(F.array(*pairs)).alias("p")).select("section", "p.name", "p.value")


def _by(rows: DataFrame, column: Column, section: str) -> DataFrame:
    return rows.groupBy(column.alias("name")).agg(F.count("*").alias("value")).where("name is not null").select(F.lit(section).alias("section"), "name", "value")


def batch_summary(subjects: DataFrame, cells: DataFrame, papers: DataFrame, verification: DataFrame, cleanup: DataFrame, errors: DataFrame, indexes: DataFrame) -> DataFrame:
    """(section, name, value): the counts of a batch.

    Subjects are (code, status, cells_total, declared), cells (key, status, requested), papers (key, subject, stage, kind),
    verification (key, question, role, issues), cleanup (key, stage, deleted, freed_bytes), errors (kind, stage), indexes (subject).
    Verified questions count once for each paper; cells that were inferred are neither requested nor unqueried.
    """
    inferred = ~F.coalesce("requested", F.lit(False)) & (F.col("status") == "subject_unavailable_inferred")
    cell = cells.agg(F.count_if("requested").alias("requested"), F.count_if(inferred).alias("inferred"))
    expected = subjects.agg(F.coalesce(F.sum("cells_total"), F.lit(0)).alias("expected"), F.count("*").alias("subjects"), F.count_if(~F.coalesce(F.col("status").isin("subject_unavailable", "scanned"), F.lit(False))).alias("not_fully_scanned"))
    both = expected.crossJoin(cell).withColumn("unqueried", F.greatest(F.col("expected") - F.col("requested") - F.col("inferred"), F.lit(0)))  # two rows of counts
    stage = F.col("stage")
    paper = papers.agg(F.count("*").alias("discovered"), F.count_if(stage.isin(*DOWNLOADED)).alias("downloaded"), F.count_if(stage.isin(*VERIFIED)).alias("verified_stage"), F.count_if(F.coalesce(stage != "cleaned", F.lit(True))).alias("not_cleaned"))
    has_key = F.col("key").isNotNull()
    checked = verification.agg(F.count("*").alias("records"), F.count_distinct(F.when(has_key, F.struct("key", "question"))).alias("questions_covered"), F.count_if(F.coalesce(F.col("issues"), F.lit(0)) > 0).alias("records_with_issues"))
    ok, sweep = stage == "cleaned", ~F.col("stage").isin(*CLEANUP)
    cleaned = cleanup.agg(
        F.count_distinct(F.when(ok, F.col("key"))).alias("cleaned_papers"), F.count_if(ok).alias("cleaned_records"), F.count_if(stage == "cleanup_pending").alias("pending_records"), F.count_if(stage == "cleanup_failed").alias("failed_records"),
        F.sum(F.when(ok, F.col("deleted"))).alias("deleted_files"), F.sum(F.when(ok, F.col("freed_bytes"))).alias("freed_bytes"), F.count_if(sweep).alias("sweep_records"), F.sum(F.when(sweep, F.col("deleted"))).alias("sweep_files"),
        F.sum(F.when(sweep, F.col("freed_bytes"))).alias("sweep_bytes"), F.sum(F.when(ok | sweep, F.col("freed_bytes"))).alias("total_freed_bytes"),
    )
    indexed = indexes.select(F.col("subject").alias("code")).distinct().withColumn("_i", F.lit(True))
    covered = subjects.select("code", F.coalesce("declared", F.lit(False)).alias("declared")).join(indexed, "code", "full_outer")
    has, known = F.col("_i").isNotNull(), F.col("declared").isNotNull()
    coverage = covered.agg(F.count_if(has).alias("subjects_with_index"), F.count_if(known & ~has).alias("subjects_without_index"), F.count_if("declared").alias("declared"), F.count_if(has & F.col("declared")).alias("declared_with_index"), F.count_if(~has & F.col("declared")).alias("declared_without_index"))
    kind = F.coalesce(F.col("kind"), F.col("stage"), F.lit("unclassified"))
    failed = errors.agg(F.count("*").alias("records"), F.count_if(kind.isin(*DOWNLOAD_ERRORS)).alias("download_errors"))
    parts = [
        _long(both, "cells"), _by(cells, F.col("status"), "cell_status"), _by(subjects, F.col("status"), "subject_status"), _long(paper, "papers"), _by(papers, stage, "stage"), _by(papers, F.col("kind"), "kind"),
        _long(checked, "verification"), _long(cleaned, "cleanup"), _by(cleanup.where(sweep), stage, "sweep_stage"), _long(coverage, "coverage"), _long(failed, "errors"), _by(errors, kind, "error_kind"),
    ]
    return reduce(DataFrame.unionByName, parts)


def stages_by_subject(papers: DataFrame, stages: list[str]) -> DataFrame:
    """Papers of each subject by stage; a stage off the list raises an error, so none is left out without a word."""
    known = F.when(F.col("stage").isNull() | F.col("stage").isin(*stages), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("unknown stage "), F.col("stage"))))
    return papers.withColumn("stage", known).groupBy("subject").pivot("stage", stages).count().fillna(0)


def subject_report(subjects: DataFrame, documents: DataFrame, papers: DataFrame, questions: DataFrame, tags: DataFrame, schemes: DataFrame, runs: DataFrame, points: DataFrame, resources: DataFrame, version: str, reasons: int = 10) -> DataFrame:
    """One row for each subject (code) with the counters of its pipeline and the first reasons of its failures.

    Documents are (id, subject, doc_type, current_revision_id), papers (id, document_id), questions (id, paper_id, marks,
    ms_regions array), tags (question_id), schemes (document_id, matched_paper_document_id), runs (document_id, parser_version,
    status, error, id), points (attrs JSON with the subject), resources (subject, is_gated). Subjects that nothing refers to have zeros.
    """
    doc = documents.select(F.col("id").alias("document_id"), F.col("subject").alias("code"), "doc_type", F.col("current_revision_id").isNotNull().alias("have"))
    of = lambda df: df.join(doc.select("document_id", "code"), "document_id")
    kind = lambda k: F.col("doc_type") == k
    paper = of(papers.select(F.col("id").alias("paper_id"), "document_id"))
    question = questions.select(F.col("id").alias("question_id"), "paper_id", "marks", (F.size("ms_regions") > 0).alias("regions")).join(paper.select("paper_id", "code"), "paper_id")
    failed = of(runs.where((F.col("parser_version") == version) & (F.col("status") == "failed")))
    parts = [
        doc.groupBy("code").agg(F.count_if(kind("question_paper")).alias("question_papers"), F.count_if(kind("mark_scheme")).alias("mark_schemes"), F.count_if(kind("question_paper") & F.col("have")).alias("question_papers_downloaded"), F.count_if(kind("mark_scheme") & F.col("have")).alias("mark_schemes_downloaded")),
        paper.groupBy("code").agg(F.count("*").alias("papers")),
        question.groupBy("code").agg(F.count("*").alias("questions"), F.count("marks").alias("questions_with_marks"), F.count_if("regions").alias("questions_with_ms_regions")),
        tags.select("question_id").join(question.select("question_id", "code"), "question_id").groupBy("code").agg(F.count_distinct("question_id").alias("questions_tagged"), F.count("*").alias("taxonomy_assignments")),
        of(schemes).groupBy("code").agg(F.count("matched_paper_document_id").alias("mark_schemes_matched")),
        failed.groupBy("code").agg(F.count("*").alias("split_failures"), F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("error") != "", F.struct("id", "error")))), 1, reasons), lambda s: s["error"]).alias("split_failure_reasons")),
        points.groupBy(F.get_json_object("attrs", "$.subject").alias("code")).agg(F.count("*").alias("points")),
        resources.groupBy(F.col("subject").alias("code")).agg(F.count("*").alias("resources"), F.count_if("is_gated").alias("gated")),
    ]
    out = subjects.select("code").distinct()
    for part in parts:
        out = out.join(part.where("code is not null"), "code", "left")
    counters = [c for c in out.columns if c not in ("code", "split_failure_reasons")]
    return out.fillna(0, counters).withColumn("split_failure_reasons", F.coalesce("split_failure_reasons", F.array().cast("array<string>")))


def upsert_specification(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, counts) after an official specification (code, parent_code, name, node_type, depth) over stored nodes (code,
    parent_code, name, node_type, depth, source): nodes that it names are official from then on, others stay; counts by action
    created, updated, same and kept."""
    fields = ["parent_code", "name", "node_type", "depth"]
    n = new.select("code", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(n, "code", "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields]) & F.col("source").eqNullSafe("official")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "created").when(same, "same").otherwise("updated")
    known = F.col("_new").isNotNull()
    nodes = j.select("code", *(F.when(known, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields), F.when(known, F.lit("official")).otherwise(F.col("source")).alias("source"), action.alias("action"))
    return nodes.drop("action"), nodes.groupBy("action").agg(F.count("*").alias("nodes"))


def upsert_candidates(candidates: DataFrame, discovered: DataFrame) -> DataFrame:
    """Candidates (url, label, state, first_seen, last_seen) after a discovery (url, label, seen_at): unknown urls are new, known
    ones are seen and have their label and last_seen refreshed, others stay as they are. A url that is found twice counts
    once, as it was found last."""
    last = discovered.groupBy("url").agg(F.max_by("label", F.struct("seen_at", "label")).alias("_label"), F.max("seen_at").alias("_at"))
    j = candidates.withColumn("_old", F.lit(True)).join(last, "url", "full_outer")
    found, known = F.col("_at").isNotNull(), F.col("_old").isNotNull()
    return j.select(
        "url", F.coalesce("_label", "label").alias("label"), F.when(found & known, "seen").when(found, "new").otherwise(F.col("state")).alias("state"),
        F.coalesce("first_seen", "_at").alias("first_seen"), F.greatest("last_seen", "_at").alias("last_seen"),
    )
