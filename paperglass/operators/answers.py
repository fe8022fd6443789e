"""Answer adjudication over sources, group grading, and the confidence of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperglass.functions.text import answers_equal, choice_family, compare_answers, in_family, normalize_answer, normalize_answer_column, once


def identity_gate(candidates: DataFrame) -> DataFrame:
    """Candidates (book, test, skill, variant, edition, and the same with want_) with the reason for which they are refused, if any,
    and whether their edition is not verified. Book, test and skill must be there; variant and edition only must not differ."""
    given = [F.col(c).isNull() for c in ("book", "test", "skill", "variant", "edition")]
    missing = given[0] & given[1] & given[2] & given[3] & given[4]
    reason = F.when(missing, "identity_missing")
    for c in ("book", "test", "skill"):
        reason = reason.when(F.col(c).isNull(), "identity_incomplete").when(F.col(c) != F.col(f"want_{c}"), f"identity_{c}_mismatch")
    for c in ("variant", "edition"):
        reason = reason.when(F.col(c) != F.col(f"want_{c}"), f"identity_{c}_mismatch")
    open_ = reason.isNull() & F.col("want_edition").isNotNull() & F.col("edition").isNull()
    return candidates.withColumn("rejected", reason).withColumn("edition_unverified", open_)


def guarded_correction(rows: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Values with decisions (action, from, to, book_value, equivalents array<string>): corrected only where the raw value still is
    `from`, else stale; confirmed where they equal the book's value or one of its equivalents."""
    j = rows.join(decisions, key, "left")
    same = lambda x: compare_answers(x, F.col("value"), number_word=True, dates=True)["equal"]
    listed = F.exists(F.coalesce("equivalents", F.array().cast("array<string>")), same)
    agrees = F.coalesce(same(F.col("book_value")), F.lit(False)) | listed
    state = (
        F.when(F.col("action").isNull(), "none").when(F.col("action") == "correct", F.when(F.col("value").eqNullSafe(F.col("from")), "applied").otherwise("stale"))
        .when(agrees, "confirmed").otherwise("unconfirmed")
    )
    return j.select(*key, F.when(state == "applied", F.col("to")).otherwise(F.col("value")).alias("value"), state.alias("decision_state"))


#: Classes of sources that count as the book itself once seen (fixed values).
OFFICIAL = ("official_pdf", "official", "official_visual")


def priority(source_class: Column, verified: Column, visual: Column, ocr: Column) -> Column:
    """1 for decisions and books that were looked at, 2 for verified sources, 3 for others and for what was only read by a machine."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(source_class == "adjudication", 1).when(yes(visual) & source_class.isin(*OFFICIAL), 1).when(yes(ocr) & ~yes(visual), 3).when(yes(verified), 2).otherwise(3)


def adjudicate(questions: DataFrame, candidates: DataFrame, decisions: DataFrame, key: list[str], number_word: bool = False, dates: bool = False) -> DataFrame:
    """(key, status, rule, answer, label, conflicts, decision_state): the answer of every question and how sure it is.

    Questions are (key, instruction, options array<struct<label, text>>, allowed_variants array<string>); candidates (key, position,
    upstream, source_class, verified, visual_verified, ocr, edition_unverified, order_unverified, raw, allowed_variants) passed the gate;
    decisions (key, action, from, to, book_value, equivalents, artifact_values) are one for a question at most.
    Candidates whose values are equal, compared in order with the first of each value, or whose options are, stand together;
    conflicts lists each value with its upstreams where more than one is left. Candidates of a question are few and are read in order.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    folded = lambda c: F.transform(listed(c), normalize_answer)
    texts = lambda c: F.transform(c, lambda t: F.struct(t.alias("text"), normalize_answer(t).alias("folded")))
    rank = priority(F.col("source_class"), F.col("verified"), F.col("visual_verified"), F.col("ocr"))
    # every text is normalised once, before it is compared; what orders the candidates comes first
    fields = ["position", "upstream", rank.alias("priority"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("edition_unverified", F.lit(False)).alias("edition_unverified"), F.coalesce("order_unverified", F.lit(False)).alias("order_unverified"), "raw", listed(F.col("allowed_variants")).alias("allowed"), "folded", folded(F.col("allowed_variants")).alias("accepted")]
    # dealt by key before they are grouped, so that the texts are normalised by compiled code and not within the aggregate
    dealt = candidates.withColumn("folded", normalize_answer_column("raw")).select(*key, F.struct(*fields).alias("c")).repartition(*key)
    lists = dealt.groupBy(*key).agg(F.sort_array(F.collect_list("c")).alias("all"))
    official = texts(F.concat(F.array("book_value"), listed(F.col("equivalents"))))
    d = decisions.withColumn("to_folded", normalize_answer_column("to")).select(*key, F.struct("action", "from", "to", "to_folded", "book_value", official.alias("official"), texts(listed(F.col("artifact_values"))).alias("artifacts")).alias("d"))
    options = F.transform("options", lambda o: F.struct(normalize_answer(o["label"]).alias("label"), o["text"].alias("text"), normalize_answer(o["text"]).alias("folded")))
    asked = questions.select(*key, choice_family(F.col("instruction")).alias("family"), F.coalesce(options, F.array()).alias("options"), folded(F.col("allowed_variants")).alias("accepted"))
    j = asked.join(lists, key, "left").join(d, key, "left").withColumn("all", F.coalesce("all", F.array().cast(lists.schema["all"].dataType)))
    dec, options, family = F.col("d"), F.col("options"), F.col("family")
    j = j.withColumn("more", F.concat("accepted", listed(F.transform(dec["official"], lambda o: o["folded"]))))
    among = lambda c, held, **how: F.coalesce(F.exists(held, lambda x: answers_equal(x["text"], c["raw"], x["folded"], c["folded"], **how)), F.lit(False))

    def ruled(c: Column) -> Column:
        """A candidate as the decision leaves it."""
        applied = F.coalesce((dec["action"] == "correct") & c["raw"].eqNullSafe(dec["from"]), F.lit(False))
        confirmed = F.coalesce(dec["action"] != "correct", F.lit(False)) & among(c, dec["official"], number_word=True, dates=True)
        value, form = F.when(applied, dec["to"]).otherwise(c["raw"]), F.when(applied, dec["to_folded"]).otherwise(c["folded"])
        kept = [c[n].alias(n) for n in ("upstream", "priority", "verified", "edition_unverified", "order_unverified", "accepted")]
        return F.struct(*kept, value.alias("value"), form.alias("folded"), applied.alias("applied"), confirmed.alias("confirmed"), among(c, dec["artifacts"]).alias("artifact"))

    def seen(c: Column) -> Column:
        hits = F.filter(options, lambda o: answers_equal(o["text"], c["value"], o["folded"], c["folded"]))
        chosen = once(hits, lambda h: F.when(F.size(h) == 1, F.get(h, 0)["label"]))
        label = F.when((c["folded"] == "") | (F.size(options) == 0), None).when(F.exists(options, lambda o: o["label"] == c["folded"]), c["folded"]).otherwise(chosen)
        kept = [c[n].alias(n) for n in ("upstream", "priority", "verified", "edition_unverified", "order_unverified", "accepted", "value", "applied", "confirmed", "artifact")]
        return F.struct(*kept, in_family(c["folded"], family).alias("choice"), label.alias("label"), (c["folded"] == "").alias("empty"))

    j = j.withColumn("all", F.transform(F.transform("all", ruled), seen))
    filled = F.filter("all", lambda c: ~c["empty"])
    j = j.withColumn("filled", filled).withColumn("counted", F.when(F.forall("filled", lambda c: c["artifact"]), F.filter("filled", lambda _: F.lit(False))).otherwise(F.col("filled")))

    def same(r: Column, c: Column) -> Column:
        allowed = F.array_contains(r["accepted"], c["choice"]) | F.array_contains(c["accepted"], r["choice"]) | F.array_contains("more", c["choice"]) | F.array_contains("more", r["choice"])
        return (r["label"].isNotNull() & (r["label"] == c["label"])) | answers_equal(r["value"], c["value"], r["choice"], c["choice"], allowed, number_word, dates)

    def stand(acc: Column, c: Column) -> Column:
        """Groups of candidates: each joins the first whose first member has its value."""
        at = F.array_position(F.transform(acc, lambda g: same(F.get(g, 0), c)), True)
        joined = F.transform(acc, lambda g, i: F.when(i + 1 == at, F.concat(g, F.array(c))).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(F.array(c))))

    j = j.withColumn("groups", F.aggregate("counted", F.filter(F.array("counted"), lambda _: F.lit(False)), stand))
    ranked = F.transform("groups", lambda g, i: F.struct(F.array_min(F.transform(g, lambda c: c["priority"])).alias("best"), i.alias("i")))
    group = F.get("groups", F.array_min(ranked)["i"])
    best = once(group, lambda g: F.get(g, F.array_min(F.transform(g, lambda c, i: F.struct(c["priority"].alias("p"), i.alias("i"))))["i"]))
    j = j.withColumn("best", best).withColumn("fixed", F.get(F.filter("all", lambda c: c["applied"]), 0))
    correct, some_confirmed = F.coalesce(dec["action"] == "correct", F.lit(False)), F.exists("all", lambda c: c["confirmed"]) & dec["book_value"].isNotNull()
    b = F.col("best")
    by_best = F.when((b["priority"] == 1) | b["applied"] | b["confirmed"], "official_verified").when(b["edition_unverified"], "unverified").when((b["priority"] == 2) | b["verified"], "source_verified").otherwise("identity_linked")
    empty = F.size("filled") == 0
    status = (
        F.when(F.col("fixed").isNotNull() | some_confirmed, "official_verified")
        .when(empty, F.when(F.exists("all", lambda c: c["order_unverified"]), "order_unverified").when(correct, "decision_stale").otherwise("missing"))
        .when(F.size("groups") == 0, "missing").when(F.size("groups") > 1, "conflict").otherwise(by_best)
    )
    rule = F.when(F.col("fixed").isNotNull(), "decision_correction").when(some_confirmed, "decision_confirmed").when(status == "conflict", "conflict_unresolved").when(status == "missing", "missing_no_candidate").when(status.isin("order_unverified", "decision_stale"), status).otherwise("explicit_number")
    answer = F.when(F.col("fixed").isNotNull(), F.col("fixed.value")).when(some_confirmed, dec["book_value"]).when(~empty, b["value"])
    state = F.when(F.col("fixed").isNotNull(), "applied").when(F.exists("all", lambda c: c["confirmed"]), "confirmed").when(correct & (F.size("all") > 0), "stale").otherwise("none")
    shown = F.transform("groups", lambda g: F.struct(F.coalesce(F.get(g, 0)["label"], F.get(g, 0)["choice"]).alias("value"), F.array_sort(F.array_distinct(F.transform(g, lambda c: c["upstream"]))).alias("upstreams"), F.array_min(F.transform(g, lambda c: c["priority"])).alias("priority")))
    conflicts = F.when(status == "conflict", shown).otherwise(F.filter(shown, lambda _: F.lit(False)))
    return j.select(*key, status.alias("status"), rule.alias("rule"), answer.alias("answer"), F.when(~empty & F.col("fixed").isNull(), b["label"]).alias("label"), conflicts.alias("conflicts"), state.alias("decision_state"))


def adjudication_coverage(found: DataFrame, by: list[str]) -> DataFrame:
    """Questions of each key by status, and how many have an answer."""
    states = ("identity_linked", "source_verified", "official_verified", "conflict", "order_unverified", "unverified", "missing", "decision_stale")
    return found.groupBy(*by).agg(F.count("*").alias("processed"), F.count_if(F.col("status") != "missing").alias("answered"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def grade_group(submitted: Column, accepted: Column, required: Column, ordered: Column, reuse: Column, scoring: Column) -> Column:
    """Struct (pass, reason) of a submission against several accepted lists (array<array<string>>).

    `any_of` passes if one given answer occurs in any list. Else the number of answers must be the required one, and some
    list must agree: place by place if ordered, as multisets if answers may be used again, else as sets without repeats.
    Without a scoring the order decides."""
    fold = lambda a: F.transform(a, normalize_answer)
    none = F.array().cast("array<array<string>>")
    ordered, reuse = F.coalesce(ordered, F.lit(False)), F.coalesce(reuse, F.lit(False))
    any_of = F.coalesce(scoring, F.when(ordered, "per_slot").otherwise("exact_set")) == "any_of"

    def judged(v: Column) -> Column:
        s, sets = v["s"], v["sets"]
        as_set = lambda a: (F.size(F.array_distinct(s)) == F.size(s)) & (F.array_sort(s) == F.array_sort(F.array_distinct(a)))
        fits = F.exists(sets, lambda a: F.when(ordered, s == a).when(reuse, F.array_sort(s) == F.array_sort(a)).otherwise(as_set(a)))
        hit = F.exists(sets, lambda a: F.arrays_overlap(s, a))
        wrong = required.isNotNull() & (F.size(s) != required)
        return F.when(any_of, F.when(hit, "any_of_hit").otherwise("any_of_miss")).when(wrong, "count_mismatch").when(~fits, "set_mismatch").when(ordered, "ordered_match").otherwise("set_match")

    found = once(F.struct(fold(submitted).alias("s"), F.transform(F.coalesce(accepted, none), fold).alias("sets")), judged)
    return once(found, lambda r: F.struct(r.isin("any_of_hit", "ordered_match", "set_match").alias("pass"), r.alias("reason")))


def confidence(identity: Column, clock: Column, anchor: Column, word: Column, margin: Column) -> Column:
    """The product of identity, clock, anchor, word confidence (1 if unknown) and the margin factor (1 if unknown)."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    factor = F.when(margin.isNull(), 1.0).otherwise(clip(0.5 + margin))
    return F.when(identity & clock, clip(anchor) * F.when(word.isNull(), 1.0).otherwise(clip(word)) * factor).otherwise(0.0)


def review_reasons(identity: Column, clock: Column, anchor: Column, margin: Column, least_anchor: float = 0.9, least_margin: float = 0.15) -> Column:
    return F.array_compact(F.array(
        F.when(~identity, "identity_not_verified"), F.when(~clock, "clock_not_valid"),
        F.when(~F.coalesce(anchor >= least_anchor, F.lit(False)), "anchor_similarity_below_threshold"), F.when(margin < least_margin, "ambiguity_margin_below_threshold"),
    ))


def clock_fit(pairs: DataFrame, key: list[str], x: str, y: str, max_residual: float, speed: tuple[float, float]) -> DataFrame:
    """Slope and offset of a linear clock by key, its largest residual, and whether both are acceptable."""
    fit = pairs.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset"), F.count("*").alias("n"))
    worst = pairs.join(fit, key).groupBy(*key).agg(F.max(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("offset"))).alias("residual"))
    ok = (F.col("residual") <= max_residual) & F.col("slope").between(*speed)
    return fit.join(worst, key).withColumn("valid", F.coalesce(ok, F.lit(False)))
