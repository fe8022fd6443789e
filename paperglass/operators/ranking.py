"""Window operators: chains, gaps, freshness, intervals, interleaving and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """n, min, max and the nearest-rank quantiles of each group: the row at round-half-even(share * (n - 1)).

    Values are counted first, so a group is as many rows as it has distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*key).orderBy(value)
    ranked = counts.withColumn("last", F.sum("c").over(order) - 1).withColumn("n", F.sum("c").over(Window.partitionBy(*key)))
    picks = [F.min(F.when(F.col("last") >= F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col(value))).alias(name) for name, q in shares.items()]
    return ranked.groupBy(*key).agg(F.max("n").alias("n"), F.min(value).alias("min"), *picks, F.max(value).alias("max"))


def change_chain(rows: DataFrame, key: str, time: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the one before of the key: initial or content_changed, and what they supersede."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*time))
    out = rows.withColumn("supersedes", before)
    return out.where(F.col("supersedes").isNull() | (F.col("supersedes") != F.col(content))).withColumn("change", F.when(F.col("supersedes").isNull(), "initial").otherwise("content_changed"))


def revision_numbers(rows: DataFrame, key: str, order: list[str], known: DataFrame) -> DataFrame:
    """The next revision numbers of each key, after the highest known (key, revision_no)."""
    top = known.groupBy(key).agg(F.max("revision_no").alias("_top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.join(top, key, "left").withColumn("revision_no", F.coalesce("_top", F.lit(0)) + n).drop("_top")


def empty_streaks(runs: DataFrame, key: str, order: list[str], empty: Column) -> DataFrame:
    """For each run, how many runs of the key up to it have been empty in a row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = runs.withColumn("_empty", empty).withColumn("_group", F.sum(F.when(F.col("_empty"), 0).otherwise(1)).over(w))
    within = Window.partitionBy(key, "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return island.withColumn("streak", F.sum(F.when(F.col("_empty"), 1).otherwise(0)).over(within)).drop("_empty", "_group")


def freshness(rows: DataFrame, scope: str, native: str, observed: str, source: str, payload: str) -> DataFrame:
    """current, superseded, or conflict for the rows of the newest native time that hold different payloads.

    A missing native time is oldest; later observations and greater sources win among equals.
    """
    order = Window.partitionBy(scope).orderBy(F.desc_nulls_last(native), F.desc(observed), F.desc(source))
    top = rows.groupBy(scope).agg(F.max(native).alias("_top"))
    joined = rows.join(top, scope).withColumn("_n", F.row_number().over(order))
    kinds = joined.where(F.col(native) == F.col("_top")).groupBy(scope).agg(F.count_distinct(payload).alias("_kinds"))
    out = joined.join(kinds, scope, "left")
    tied = F.coalesce((F.col(native) == F.col("_top")) & (F.col("_kinds") > 1), F.lit(False))
    return out.withColumn("state", F.when(tied, "conflict").when(F.col("_n") == 1, "current").otherwise("superseded")).drop("_top", "_n", "_kinds")


def numbering_problems(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Series that do not start at one, and places where a number is skipped."""
    w = Window.partitionBy(key).orderBy(number)
    prev = F.lag(number).over(w)
    distinct = rows.select(key, number).distinct().withColumn("_prev", prev)
    rule = F.when(F.col("_prev").isNull() & (F.col(number) != 1), "not_start_at_one").when(F.col(number) > F.col("_prev") + 1, "gap")
    return distinct.withColumn("rule", rule).where("rule is not null").select(key, number, "rule")


def tree_findings(questions: DataFrame) -> DataFrame:
    """(paper_id, id, rule, severity, detail) of question trees (id, paper_id, parent_id, number_path, depth, display_order).

    Numbers on top in their displayed order: `top_level_number_not_integer` (a warning), `numbering_gap` where the next one is not
    one more (errors; numbers that are no integers are passed over) and `numbering_not_start_at_one`. Over all levels:
    `duplicate_number_paths` (an error for each path, detail: how often), `depth_skip` where a part lies more than one level below
    its parent (a warning) and `parent_missing` where its paper has no such parent (an error). A null number counts as no integer.
    """
    top = questions.where("parent_id is null").withColumn("_n", F.when(F.rlike("number_path", F.lit(r"^\d{1,9}$")), F.col("number_path").cast("int")))
    w = Window.partitionBy("paper_id").orderBy("display_order", "id")
    ints = top.where("_n is not null").withColumn("_prev", F.lag("_n").over(w))

    def found(rows: DataFrame, rule: str, severity: str, detail=None) -> DataFrame:
        own = F.col("id") if "id" in rows.columns else F.lit(None).cast(questions.schema["id"].dataType)
        return rows.select("paper_id", own.alias("id"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    parts = questions.where("parent_id is not null").alias("c")
    above = questions.select(F.col("id").alias("_up"), F.col("paper_id").alias("_paper"), F.col("depth").alias("_depth"))
    joined = parts.join(above, (F.col("parent_id") == F.col("_up")) & (F.col("paper_id") == F.col("_paper")), "left")
    twice = questions.where("number_path is not null").groupBy("paper_id", "number_path").agg(F.count("*").alias("n")).where("n > 1")
    step = lambda a, b: F.concat(a.cast("string"), F.lit(" -> "), b.cast("string"))
    rows = [
        found(top.where("_n is null"), "top_level_number_not_integer", "warning", F.col("number_path")),
        found(ints.where("_n <> _prev + 1"), "numbering_gap", "error", step(F.col("_prev"), F.col("_n"))),
        found(ints.where("_prev is null and _n <> 1"), "numbering_not_start_at_one", "error", F.col("_n")),
        found(twice, "duplicate_number_paths", "error", F.concat_ws(" x", "number_path", F.col("n").cast("string"))),
        found(joined.where("depth > _depth + 1"), "depth_skip", "warning", step(F.col("_depth"), F.col("depth"))),
        found(joined.where("_up is null"), "parent_missing", "error", F.col("parent_id")),
    ]
    return reduce(DataFrame.unionByName, rows)


def overlapping_intervals(rows: DataFrame, key: str, part: str, start: str, end: str) -> DataFrame:
    """(key, part, start, end, cluster, reaches, size) of the closed intervals of a key that meet another one.

    Intervals in the order of their starts belong to one cluster as long as each begins at or before the greatest end so far, so
    nested, equal and touching ones are found however far apart in that order. `reaches` is that greatest end. Intervals that end
    before they start, or lack a bound, take no part.
    """
    good = rows.where(F.col(end) >= F.col(start)).select(key, part, start, end)
    w = Window.partitionBy(key).orderBy(start, end, part)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = good.withColumn("_new", F.when(far.isNull() | (F.col(start) > far), 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = opened.groupBy(key, "cluster").agg(F.count("*").alias("size"), F.max(end).alias("reaches")).where("size > 1")
    return opened.drop("_new").join(size, [key, "cluster"])


def interval_check(rows: DataFrame, key: str, start: str, end: str, parts: int = 4) -> DataFrame:
    """Whether a key has so many parts, none of which overlap or end before they start."""
    prev = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    marked = rows.withColumn("_clear", (prev.isNull() | (F.col(start) >= prev)) & (F.col(end) > F.col(start)))
    return marked.groupBy(key).agg((F.count("*") == parts).alias("complete"), F.bool_and("_clear").alias("disjoint"))


def first_of(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key; rows without one all stay."""
    marked = rows.withColumn("_key", key)
    w = Window.partitionBy("_key").orderBy(*order)
    known = marked.where("_key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return known.unionByName(marked.where("_key is null")).drop("_key")


def round_robin(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with their turn: one of each key after the other, small keys first."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size"))
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(sizes, key).withColumn("turn", F.struct("round", "_size", key)).drop("_size")


def running_confidence(rows: DataFrame, key: str, score: str, order: list[Column], calibration: float, absolute: float, margin: float, top_k: int) -> DataFrame:
    """Confidence of ranked candidates: the score against the calibration, weighted by the margin to the next, never
    above the one before. One more row than kept takes part, for the last margin."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k + 1)
    after = F.coalesce(F.lead(score).over(w), F.lit(0.0))
    raw = F.least(F.lit(1.0), F.col(score) / calibration) * (absolute + margin * (1 - after / F.col(score)))
    scored = ranked.withColumn("_raw", F.when(F.col(score) > 0, raw).otherwise(0.0))
    down = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scored.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.min("_raw").over(down)), 4)).drop("_raw").where(F.col("rank") <= top_k)


def second_tag(rows: DataFrame, key: str, score: str, min_score: float, ratio: float = 0.85) -> DataFrame:
    """The first candidate of each key, and the second if it comes near a first that is good enough."""
    best = F.first(score).over(Window.partitionBy(key).orderBy("rank"))
    return rows.withColumn("_best", best).where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("_best") >= min_score) & (F.col(score) >= ratio * F.col("_best")))).drop("_best")
