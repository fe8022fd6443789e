"""Incremental crawl merges and latest checkpoints as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

def classify(batch: DataFrame, state: DataFrame, complete_sources: DataFrame | None = None) -> DataFrame:
    """(url, source, sha256, revision_no, seen_at, action): what a run's outcomes (url, source, status, sha256, bytes, seen_at) mean
    against the state (url, source, sha256, revision_no, status).

    The last outcome of a url counts. A url without a fetch is new or seen; a fetched one new, unchanged by its hash, or changed with
    the next revision; what may not be fetched (gated, robots) is skipped and what failed is an error, and both keep
    their revision. Urls of fully inspected sources that the run has not met are missing.
    """
    last = batch.groupBy("url").agg(F.max_by(F.struct("source", "status", "sha256", "bytes", "seen_at"), F.struct("seen_at", "status", "sha256")).alias("r")).select("url", "r.*")
    old = state.select("url", F.col("sha256").alias("_sha"), F.col("revision_no").alias("_no"), F.lit(True).alias("_old"))
    j = last.join(old, "url", "left")
    fetched, known = F.col("status") == "fetched", F.col("_old").isNotNull()
    had = F.coalesce("_no", F.lit(0))
    action = (
        F.when(F.col("status").isin("gated", "robots"), "skipped").when(F.col("status") == "error", "error").when(~fetched, F.when(known, "seen").otherwise("new"))
        .when(had == 0, "new").when(F.col("sha256").eqNullSafe(F.col("_sha")), "unchanged").otherwise("changed")
    )
    counts = fetched & action.isin("new", "changed")
    moved = j.select("url", "source", F.when(counts, F.col("sha256")).otherwise(F.col("_sha")).alias("sha256"), F.when(counts, had + 1).otherwise(had).cast("int").alias("revision_no"), "seen_at", action.alias("action"), F.when(fetched, F.col("bytes")).alias("bytes"))
    if complete_sources is None:
        return moved
    gone = state.where("status <> 'missing'").join(complete_sources.select("source").distinct(), "source", "left_semi").join(last.select("url"), "url", "left_anti")
    return moved.unionByName(gone.select("url", "source", "sha256", "revision_no", "seen_at", F.lit("missing").alias("action"), F.lit(None).cast("long").alias("bytes")))


def run_counters(moved: DataFrame) -> DataFrame:
    """One row: the outcomes of a run by action, new revisions, and the bytes that were fetched."""
    actions = ("new", "seen", "unchanged", "changed", "missing", "skipped", "error")
    revision = F.col("bytes").isNotNull() & F.col("action").isin("new", "changed")
    return moved.agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a) for a in actions], F.count_if(revision).alias("new_revisions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def empty_runs(runs: DataFrame, key: list[str]) -> DataFrame:
    """How many of each key's last runs (run_no, discovered) in a row have found nothing."""
    some = F.max(F.when(F.col("discovered") > 0, F.col("run_no")))
    last = runs.groupBy(*key).agg(some.alias("_last"))
    return runs.join(last, key).groupBy(*key).agg(F.count_if(F.col("_last").isNull() | (F.col("run_no") > F.col("_last"))).alias("empty_runs"))


def latest_checkpoints(observations: DataFrame) -> DataFrame:
    """The newest observation of each scope by native time, then observed time, and whether its native time holds several
    payloads. Runs on a batch or, in complete or update mode, on a stream: state is one row for each scope and instant."""
    by_time = observations.groupBy("scope", "native_at").agg(F.max_by("payload", F.struct("observed_at", "payload")).alias("payload"), F.max("observed_at").alias("observed_at"), F.size(F.collect_set(F.sha2("payload", 256))).alias("payloads"))
    return by_time


def newest(by_time: DataFrame) -> DataFrame:
    """The row of each scope's newest native time; a missing time is oldest."""
    top = F.struct(F.col("native_at").isNotNull().alias("known"), "native_at", "observed_at")
    out = by_time.groupBy("scope").agg(F.max_by(F.struct("native_at", "observed_at", "payload", "payloads"), top).alias("r")).select("scope", "r.*")
    return out.withColumn("state", F.when((F.col("payloads") > 1) & F.col("native_at").isNotNull(), "conflict").otherwise("current"))


def checkpoint_stream(observations: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """A stream of observations that may arrive in any order: each batch keeps, for each scope, the distinct payloads of its newest
    native time. read_checkpoints() answers for all batches so far."""

    def merge(batch: DataFrame, number: int) -> None:
        top = batch.groupBy("scope").agg(F.max("native_at").alias("_top"))
        newest_rows = batch.join(top, "scope").where(F.col("native_at").eqNullSafe(F.col("_top")))
        newest_rows.groupBy("scope", "native_at", "payload").agg(F.max("observed_at").alias("observed_at")).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_checkpoints(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest checkpoint of each scope over all batches of checkpoint_stream()."""
    rows = spark.read.schema("scope long, native_at timestamp, payload string, observed_at timestamp").parquet(table_path)
    return newest(latest_checkpoints(rows))


#: Stages of jobs by the state of their newest checkpoint (fixed values).
STAGES = {"complete": "succeeded", "ok": "succeeded", "partial_failure": "partial", "blocked": "blocked"}


def job_stages(checkpoints: DataFrame) -> DataFrame:
    """(scope, stage, freshness) of checkpoints (scope, payload JSON, state): succeeded, queued or running, partial, stopped, one that waits to
    be resumed, blocked or unknown, by the payload's state, its own stage and whether it asks for a resume."""
    at = lambda path: F.get_json_object("payload", path)
    state = at("$.state")
    plain = F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), state)
    queued = F.coalesce(at("$.stage") == "queued", F.lit(False)) | F.coalesce(at("$.loop_stage") == "queued", F.lit(False))
    waits = F.coalesce(at("$.resume.needs_user_resume") == "true", F.lit(False))
    stage = F.when(state == "in_progress", F.when(queued, "queued").otherwise("running")).when(state == "stopped", F.when(waits, "stopped_requires_resume").otherwise("stopped")).otherwise(F.coalesce(plain, F.lit("unknown")))
    return checkpoints.select("scope", stage.alias("stage"), F.col("state").alias("freshness"))
