"""Language-test listings: question filters, resolution of tests, and explanation reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_questions(rows: DataFrame, equal: dict[str, object], limit: int, offset: int, order: list[str]) -> DataFrame:
    """A page of the questions whose columns equal the given values, with the count of each skill among all of them."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    counts = rows.groupBy("skill").agg(F.count("*").alias("skill_total"))
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(counts), "skill")


def resolve_tests(manifest: DataFrame, questions: DataFrame, answers: DataFrame, audio: DataFrame, key: list[str]) -> DataFrame:
    """Units of a manifest (key, expected) with how many questions, answers and recordings they have, and the numbers that
    are missing or unexpected."""
    q = questions.groupBy(*key).agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    a = answers.groupBy(*key).agg(F.count_distinct("number").alias("answered"))
    s = audio.groupBy(*key).agg(F.count("*").alias("recordings"))
    none = F.array().cast("array<int>")
    out = manifest.join(q, key, "left").join(a, key, "left").join(s, key, "left")
    wanted = F.when(F.col("expected") > 0, F.sequence(F.lit(1), F.col("expected"))).otherwise(none)
    have = F.coalesce("numbers", none)
    return out.select(*key, F.size(have).cast("long").alias("questions"), F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("recordings", F.lit(0)).alias("recordings"), F.array_except(wanted, have).alias("missing"), F.array_except(have, wanted).alias("unexpected"))


def review_explanations(explanations: DataFrame, tasks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(explanations, tasks, audit) after decisions (id, status, reviewer): legal ones change the status, close open
    stale-source tasks and leave an audit row."""
    legal = decisions.where(F.col("status").isin("approved", "rejected", "pending")).select("id", F.col("status").alias("_s"), "reviewer")
    changed = explanations.join(legal.select("id", "_s"), "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    closed = tasks.join(legal.select(F.col("id").alias("target_id"), F.lit(True).alias("_c")), "target_id", "left").withColumn("status", F.when(F.col("_c") & (F.col("reason") == "stale_source") & (F.col("status") == "open"), "done").otherwise(F.col("status"))).drop("_c")
    audit = legal.join(explanations.select("id", F.col("status").alias("before")), "id").select("id", "before", F.col("_s").alias("after"), "reviewer")
    return changed, closed, audit
