"""Manifests of what must exist: findings of every rule, coverage of units and completeness of books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal values, parts of each skill as a pattern, and the variants of each skill (fixed values).
VARIANTS = ["academic", "general", "shared"]
SKILLS = ["listening", "reading", "writing", "speaking"]
STATUSES = ["verified", "unverified", "not_in_book"]
PARTS = {"listening": "^P[1-4]$", "reading": "^P[1-3]$", "writing": "^WT[12]$", "speaking": "^SP$"}
SKILL_VARIANTS = {"listening": ["shared"], "speaking": ["shared"], "reading": ["academic", "general"], "writing": ["academic", "general"]}


def _by_skill(values: dict, test) -> Column:
    """A test by the row's skill; null for a skill that is not known."""
    return reduce(lambda out, kv: out.when(F.col("skill") == kv[0], test(kv[1])), list(values.items())[1:], F.when(F.col("skill") == next(iter(values)), test(next(iter(values.values())))))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _numbers() -> Column:
    return F.coalesce("expected_numbers", F.array().cast("array<int>"))


def _unit() -> Column:
    return F.coalesce(F.lower("test"), F.lit("null")).alias("test")


def manifest_findings(items: DataFrame) -> DataFrame:
    """(book, item_id, rule, severity, detail) of a manifest's items.

    Items: book, id, variant, skill, test, part, status, evidence array<struct<file_page>>, expected_numbers array<int>, assets
    array<string>, groups array<struct<id, asset_ref, parts array<string>>>. Null arrays are empty; null values are illegal where a
    list of legal ones exists. Rules of one item: illegal_status, illegal_variant, illegal_skill, variant_not_allowed, invalid_part,
    verified_without_evidence, verified_without_page (a warning), numbers_not_gap_free, unknown_asset and invalid_group_part (detail:
    the group, or group and part). Rules over items: duplicate_item_id (a row for each book that has the id, detail: how often in
    all), and for a book's variant, skill and test overlapping_number (detail: unit and number) and not_contiguous_from_1, where
    any item has numbers.
    """
    n = _numbers()
    evidence = F.coalesce("evidence", F.expr("array()").cast(items.schema["evidence"].dataType))
    verified = _yes(F.col("status") == "verified")
    # gap-free: no null, none twice, and as many as from least to greatest; no sort, and none for each step
    width = F.array_max(n).cast("long") - F.array_min(n).cast("long") + 1
    steps = (F.size(n) < 2) | ((F.size(F.array_compact(F.array_distinct(n))) == F.size(n)) & (width == F.size(n)))
    legal_part = lambda part: _by_skill(PARTS, lambda p: _yes(F.rlike(part, F.lit(p))))
    rules = [
        ("illegal_status", "error", ~_yes(F.col("status").isin(STATUSES))), ("illegal_variant", "error", ~_yes(F.col("variant").isin(VARIANTS))), ("illegal_skill", "error", ~_yes(F.col("skill").isin(SKILLS))),
        ("variant_not_allowed", "error", ~_by_skill(SKILL_VARIANTS, lambda v: _yes(F.col("variant").isin(v)))), ("invalid_part", "error", ~legal_part(F.col("part"))),
        ("verified_without_evidence", "error", verified & (F.size(evidence) == 0)), ("verified_without_page", "warning", verified & (F.size(evidence) > 0) & F.forall(evidence, lambda e: e["file_page"].isNull())),
        ("numbers_not_gap_free", "error", (F.size(n) > 0) & ~_yes(steps)),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules]))
    out = items.select("book", F.col("id").alias("item_id"), F.explode(hits).alias("f")).select("book", "item_id", "f.rule", "f.severity", F.lit(None).cast("string").alias("detail"))

    def add(rows: DataFrame, rule: str, detail: Column | None) -> DataFrame:
        item = F.col("item_id") if "item_id" in rows.columns else F.lit(None).cast("string")
        return rows.select("book", item.alias("item_id"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    groups = items.select("book", F.col("id").alias("item_id"), "skill", F.coalesce("assets", F.array().cast("array<string>")).alias("assets"), F.explode("groups").alias("g"))
    dangling = groups.where((F.col("g.asset_ref") != "") & ~_yes(F.array_contains("assets", F.col("g.asset_ref"))))
    part = groups.select("book", "item_id", "skill", F.col("g.id").alias("group_id"), F.explode("g.parts").alias("p")).where(~legal_part(F.col("p")))
    repeated = items.where("id is not null").groupBy(F.col("id").alias("item_id"), "book").agg(F.count("*").alias("n"))
    often = repeated.groupBy("item_id").agg(F.sum("n").alias("all")).where("all > 1")
    units = ["book", "variant", "skill", "test"]
    each = items.select("book", "variant", "skill", _unit(), F.explode("expected_numbers").alias("number")).groupBy(*units, "number").agg(F.count("*").alias("n"))
    name = F.concat_ws(":", F.coalesce("variant", F.lit("null")), F.coalesce("skill", F.lit("null")), "test")
    whole = each.groupBy(*units).agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("number").alias("kinds"), F.sum("n").alias("n")).where("lo <> 1 or hi <> kinds or n <> kinds or lo is null")
    for extra in (
        add(dangling, "unknown_asset", F.col("g.id")),
        add(part, "invalid_group_part", F.concat_ws(":", "group_id", "p")),
        add(repeated.join(often, "item_id"), "duplicate_item_id", F.col("all")),
        add(each.where("n > 1"), "overlapping_number", F.concat_ws(":", name, F.col("number").cast("string"))),
        add(whole, "not_contiguous_from_1", name),
    ):
        out = out.unionByName(extra)
    return out


def manifest_coverage(items: DataFrame, by: list[list[str]]) -> DataFrame:
    """Units and questions that a manifest expects, over several groupings of (book, variant, skill) at once.

    A unit is a book's variant, skill and test (without regard to case). It is verified or not in the book only if all its items
    are; every other unit is unverified. Columns outside a grouping are null and `level` names the grouping's columns.
    """
    is_ = lambda s: F.bool_and(_yes(F.col("status") == s))
    units = items.groupBy("book", "variant", "skill", _unit()).agg(is_("verified").alias("v"), is_("not_in_book").alias("a"), F.sum(F.size(_numbers())).alias("q"))
    columns = list(dict.fromkeys(c for g in by for c in g))
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return units.groupingSets([[F.col(c) for c in g] for g in by], *columns).agg(
        level.alias("level"), F.count("*").alias("expected_units"), F.count_if("v").alias("verified_units"), F.count_if("a").alias("not_in_book_units"),
        F.count_if(~F.col("v") & ~F.col("a")).alias("unverified_units"), F.sum("q").alias("questions_expected"),
    )


def book_completeness(items: DataFrame, books: DataFrame) -> DataFrame:
    """(book, complete, reasons) of books (book, extraction, general, gt: statuses, each may be null).

    Complete: at least one item, all items verified, the extraction `complete`, and the general part (`general`, else `gt`) resolved
    as in_book or not_in_book. Unknown is no yes: each missing fact is a reason (no_items, items_not_verified, extraction_open,
    general_open).
    """
    own = items.groupBy("book").agg(F.bool_and(_yes(F.col("status") == "verified")).alias("v"))
    general = F.coalesce(F.nullif("general", F.lit("")), "gt")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("v").isNull(), "no_items").when(~F.col("v"), "items_not_verified"), F.when(~_yes(F.col("extraction") == "complete"), "extraction_open"),
            F.when(~_yes(general.isin("in_book", "not_in_book")), "general_open"),
        )
    )
    return books.join(own, "book", "left").select("book", reasons.alias("reasons")).withColumn("complete", F.size("reasons") == 0)
