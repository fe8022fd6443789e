"""Provenance, review queues, set differences, and the life of resources and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def provenance_edges(subjects: dict[str, DataFrame], revisions: DataFrame) -> DataFrame:
    """Edges (subject_type, subject_id, revision_id) of all subject frames (id, document_id): each to its document's latest
    revision. Rebuilding gives the same edges."""
    top = revisions.groupBy("document_id").agg(F.max_by("id", "revision_no").alias("revision_id"))
    out = None
    for kind, df in subjects.items():
        part = df.join(top, "document_id").select(F.lit(kind).alias("subject_type"), F.col("id").alias("subject_id"), "revision_id").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def rebuilt_edges(old: DataFrame, new: DataFrame, board: str | None = None) -> DataFrame:
    """Stored edges (subject_type, subject_id, revision_id, board) after a rebuild, whole or of one board: the edges of that scope are
    replaced by the new ones of it, those of other boards stay. Rebuilding again gives the same edges."""
    if board is None:
        return new.distinct()
    return old.where(~F.col("board").eqNullSafe(F.lit(board))).unionByName(new.where(F.col("board") == board).distinct())


def findings_to_tasks(findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """New review tasks: errors and critical findings, one for each subject and rule that has no open task."""
    wanted = findings.where(F.col("severity").isin("error", "critical")).select("subject_type", "subject_id", "rule_code").distinct()
    open_ = tasks.where("status = 'open'").select(F.col("target_type").alias("subject_type"), F.col("target_id").alias("subject_id"), F.col("reason").alias("rule_code")).distinct()
    return wanted.join(open_, ["subject_type", "subject_id", "rule_code"], "left_anti")


def document_status(findings: DataFrame, key: str) -> DataFrame:
    """needs_review for documents with an open error or critical finding in any run, else parsed."""
    bad = (F.col("status") == "open") & F.col("severity").isin("error", "critical")
    return findings.groupBy(key).agg(F.when(F.bool_or(bad), "needs_review").otherwise("parsed").alias("document_status"))


def resolve_reviews(tasks: DataFrame, decisions: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with their decided status (done, dismissed or in_progress; others are ignored), and findings closed by them."""
    legal = decisions.where(F.col("status").isin("done", "dismissed", "in_progress")).select(F.col("task_id").alias("id"), F.col("status").alias("_new"))
    moved = tasks.join(legal, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    closing = moved.where(F.col("status").isin("done", "dismissed")).select(F.col("target_type").alias("subject_type"), F.col("target_id").alias("subject_id"), F.col("reason").alias("rule_code"), F.when(F.col("status") == "done", "resolved").otherwise("ignored").alias("_closed"))
    key = ["subject_type", "subject_id", "rule_code"]
    best = closing.groupBy(*key).agg(F.max("_closed").alias("_closed"))
    closed = findings.join(best, key, "left").withColumn("status", F.when((F.col("status") == "open") & F.col("_closed").isNotNull(), F.col("_closed")).otherwise(F.col("status"))).drop("_closed")
    return moved, closed


def missing_resources(candidates: DataFrame, seen: DataFrame, complete_sources: DataFrame) -> DataFrame:
    """Candidates of fully inspected sources that this run has not seen."""
    return candidates.join(complete_sources.select("source").distinct(), "source", "left_semi").join(seen.select("url").distinct(), "url", "left_anti").withColumn("state", F.lit("missing"))


def table_diff(before: DataFrame, after: DataFrame, key: str, content: str, quality: str) -> DataFrame:
    """(key, change): added, removed, upgraded (its quality rose) or changed entries."""
    b = before.select(key, F.col(content).alias("_cb"), F.col(quality).alias("_qb"))
    a = after.select(key, F.col(content).alias("_ca"), F.col(quality).alias("_qa"))
    change = (
        F.when(F.col("_cb").isNull() & F.col("_qb").isNull(), "added")
        .when(F.col("_ca").isNull() & F.col("_qa").isNull(), "removed")
        .when(F.col("_qa") > F.col("_qb"), "upgraded")
        .when(~F.col("_ca").eqNullSafe(F.col("_cb")) | ~F.col("_qa").eqNullSafe(F.col("_qb")), "changed")
    )
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def unexplained(changes: DataFrame, explanations: DataFrame, key: str) -> DataFrame:
    """Removals and upgrades that no explanation covers."""
    return changes.where(F.col("change").isin("removed", "upgraded")).join(explanations.select(key).distinct(), key, "left_anti")


def generated_view(explanations: DataFrame, tasks: DataFrame) -> DataFrame:
    """Explanations with requires_review: not approved, or an open stale-source task exists."""
    stale = tasks.where("status = 'open' and reason = 'stale_source'").select(F.col("target_id").alias("id")).distinct().withColumn("_stale", F.lit(True))
    return explanations.join(stale, "id", "left").withColumn("requires_review", (F.col("status") != "approved") | F.coalesce("_stale", F.lit(False))).drop("_stale")


def explanation_batch(questions: DataFrame, entries: DataFrame, official: DataFrame) -> DataFrame:
    """One row: questions scanned, those with an official basis, and those skipped."""
    basis = entries.where("question_id is not null").select("question_id").union(official.select("question_id")).distinct().withColumn("_b", F.lit(1))
    joined = questions.select(F.col("id").alias("question_id")).join(basis, "question_id", "left")
    return joined.agg(F.count("*").alias("scanned"), F.count("_b").alias("generated"), (F.count("*") - F.count("_b")).alias("skipped"))


def scaffold(entries: DataFrame) -> DataFrame:
    """Marking points of official entries (question_id, text): lines in order, without blanks, and their number."""
    lines = F.filter(F.transform(F.split("text", r"\n|;"), lambda x: F.trim(x)), lambda x: x != "")
    return entries.where("question_id is not null").select("question_id", lines.alias("points"), F.size(lines).alias("n_points"))


def review_queue(tasks: DataFrame, status: str = "open", limit: int = 50) -> DataFrame:
    return tasks.where(F.col("status") == status).orderBy("priority", "id").limit(limit)


def run_statistics(rows: DataFrame, key: list[str], outcome: str, values: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("total"), *[F.count_if(F.col(outcome) == v).alias(v) for v in values])
