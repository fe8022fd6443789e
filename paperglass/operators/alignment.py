"""Questions located in the transcript of a recording: candidate windows, the cheapest choice of them, and its review.

A part is one recording with its questions, so its rows are few; parts are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperglass.functions.papers import clock_units, transcript_words
from paperglass.sources.tables import written

#: Longest window of a segment, that of the last one, and what an answer's window has on both sides, in seconds (fixed values).
LONGEST, LAST, PAD = 30.0, 12.0, 2.0
#: Scores of candidates by their source, and the least scores of an answer's and a stem's words (fixed values).
MARKER, ANSWER, BOTH, STEM = 0.55, 0.55, 0.85, 0.2
LEAST_ANSWER, LEAST_STEM = 0.9, 0.6
#: Windows of a question that begin and end so near to each other are one (fixed values).
NEAR_START, NEAR_END = 1.5, 3.0
#: Words that say nothing about a question (fixed values).
STOPWORDS = (
    "the a an and or of to in on at by for is are was were be with from that this it as your you their its will would can could choose write complete below above "
    "following questions question answer answers one two three words word number numbers letters letter correct box list options option each which what where when who "
    "why how more than not no yes"
).split()


def phrase_share(phrase: Column, words: Column) -> Column:
    """The share of a phrase's words that occur among the words in its order, each as early as it can."""
    step = lambda i, w: F.when((i < F.size(phrase)) & (w == F.get(phrase, i)), i + 1).otherwise(i)
    return F.when(F.size(phrase) > 0, F.aggregate(words, F.lit(0), step) / F.size(phrase)).otherwise(0.0)


def row_share(phrase: Column, words: Column) -> Column:
    """The share of a phrase's words of the longest row of its first words among the words; a word that breaks a row may begin one."""

    def step(acc: Column, w: Column) -> Column:
        goes = (acc["i"] < F.size(phrase)) & (w == F.get(phrase, acc["i"]))
        i = F.when(goes, acc["i"] + 1).when(w == F.get(phrase, F.lit(0)), 1).otherwise(0)
        return F.struct(i.alias("i"), F.greatest(acc["best"], i).alias("best"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("best"))
    return F.when(F.size(phrase) > 0, F.aggregate(words, zero, step)["best"] / F.size(phrase)).otherwise(0.0)


def stem_words(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(transcript_words(text), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))


def segment_bounds(segments: DataFrame, part: str) -> DataFrame:
    """Segments (part, seq, start_sec, ...) with end_sec: the next start, not more than LONGEST later, LAST after the last one, and
    one second where that is no later."""
    after = F.lead("start_sec").over(Window.partitionBy(part).orderBy("start_sec", "seq"))
    end = F.when(after.isNull(), F.col("start_sec") + LAST).otherwise(F.least(after, F.col("start_sec") + LONGEST))
    return segments.where("start_sec is not null").withColumn("end_sec", end).withColumn("end_sec", F.when(F.col("end_sec") <= F.col("start_sec"), F.col("start_sec") + 1).otherwise(F.col("end_sec")))


def _meet(phrases: DataFrame, segments: DataFrame, part: str, least: float) -> DataFrame:
    """Pairs of phrases (part, number, phrase) and segments (part, seq, words) with as many words in common as the share needs: they
    meet in the rarest words of the phrase, of which the share cannot do without one."""
    found = segments.select(part, "seq", F.explode(F.array_distinct("words")).alias("w"))
    often = found.groupBy(part, "w").agg(F.count("*").alias("df"))
    words = phrases.select(part, "number", "phrase", F.explode(F.array_distinct("phrase")).alias("w")).join(often, [part, "w"], "left")
    rare = Window.partitionBy(part, "number", "phrase").orderBy(F.coalesce("df", F.lit(0)), "w")
    n = F.size(F.array_distinct("phrase"))
    keys = words.withColumn("k", F.row_number().over(rare)).where(F.col("k") <= n - F.ceil(least * n - 1e-9) + 1).select(part, "number", "phrase", "w")
    return keys.join(found, [part, "w"]).select(part, "number", "phrase", "seq").distinct().join(segments, [part, "seq"])


def candidates(segments: DataFrame, questions: DataFrame, part: str) -> DataFrame:
    """(part, number, start_sec, end_sec, source, context_score, answer_score): windows in which a question may be answered.

    Segments are (part, seq, start_sec, text, q array<int> of marked questions), questions (part, number, prompt,
    answer_variants array<string>). A window comes from a segment that marks the question, from one that holds the words of
    an answer, wider on both sides, or, for questions without either, from the first segment with most words of the prompt.
    Windows of a question that nearly coincide are one, that of the higher score. Steps that several branches go on from are
    written to the shared folder, so that each is computed and planned once.
    """
    bounds = written(segment_bounds(segments, part).select(part, "seq", "start_sec", "end_sec", "q", transcript_words(F.col("text")).alias("words")))
    known = questions.select(part, F.col("number").cast("long").alias("number"))
    marks = bounds.select(part, "seq", F.explode(F.col("q").cast("array<bigint>")).alias("number")).distinct().join(known, [part, "number"]).withColumn("marked", F.lit(True))
    none = F.lit(None).cast("double")
    of_marks = marks.join(bounds, [part, "seq"]).select(part, "number", "start_sec", "end_sec", F.lit("transcript_qn_marker").alias("source"), F.lit(MARKER).alias("context_score"), none.alias("answer_score"))
    phrases = questions.select(part, F.col("number").cast("long").alias("number"), F.explode("answer_variants").alias("v")).select(part, "number", transcript_words(F.col("v")).alias("phrase")).where("size(phrase) > 0").distinct()
    score = F.greatest(phrase_share(F.col("phrase"), F.col("words")), row_share(F.col("phrase"), F.col("words")))
    heard = _meet(phrases, bounds.select(part, "seq", "words", "start_sec", "end_sec"), part, LEAST_ANSWER).withColumn("score", score).where(F.col("score") >= LEAST_ANSWER)
    best = heard.groupBy(part, "number", "seq", "start_sec", "end_sec").agg(F.max("score").alias("answer_score")).join(marks, [part, "seq", "number"], "left")
    marked = F.col("marked").isNotNull()
    of_answers = best.select(
        part, "number", F.greatest(F.lit(0.0), F.col("start_sec") - PAD).alias("start_sec"), (F.col("end_sec") + PAD).alias("end_sec"),
        F.when(marked, "answer_in_marker_window").otherwise("answer_occurrence").alias("source"), F.when(marked, BOTH).otherwise(ANSWER).alias("context_score"), "answer_score",
    )
    strong = written(of_marks.unionByName(of_answers))
    rest = questions.select(part, F.col("number").cast("long").alias("number"), F.array_distinct(stem_words(F.col("prompt"))).alias("phrase")).where("size(phrase) > 0").join(strong.select(part, "number").distinct(), [part, "number"], "left_anti")
    share = F.size(F.array_intersect("phrase", "words")) / F.size("phrase")
    heard = _meet(rest, bounds.select(part, "seq", "words", "start_sec", "end_sec"), part, LEAST_STEM).withColumn("score", share).where(F.col("score") >= LEAST_STEM)
    first = heard.groupBy(part, "number").agg(F.max_by(F.struct("start_sec", "end_sec", "score"), F.struct("score", -F.col("start_sec"), -F.col("seq"))).alias("s"))
    weak = first.select(part, "number", "s.start_sec", "s.end_sec", F.lit("stem_keywords").alias("source"), (STEM * F.col("s.score")).alias("context_score"), none.alias("answer_score"))
    return merged_windows(strong.unionByName(weak), [part, "number"])


def merged_windows(rows: DataFrame, key: list[str]) -> DataFrame:
    """The windows of a key without those that nearly coincide with one of a higher score, or of the same score and earlier."""
    fields = ["start_sec", "end_sec", "source", "context_score", "answer_score", *(c for c in rows.columns if c not in (*key, "start_sec", "end_sec", "source", "context_score", "answer_score"))]
    order = F.struct((-F.col("context_score")).alias("_down"), *fields)
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias("all"))
    empty = F.filter("all", lambda _: F.lit(False))
    near = lambda a, b: (F.abs(a["start_sec"] - b["start_sec"]) < NEAR_START) & (F.abs(a["end_sec"] - b["end_sec"]) < NEAR_END)
    kept = F.aggregate("all", empty, lambda acc, c: F.when(F.exists(acc, lambda d: near(d, c)), acc).otherwise(F.concat(acc, F.array(c))))
    return lists.select(*key, F.explode(kept).alias("w")).select(*key, *(F.col(f"w.{c}") for c in fields))


#: Costs of the choice (fixed values).
CONTEXT, ANCHOR, SKIP, REVERSE, REVERSE_OVERLAP, REQUIRED, ANCHOR_SCALE = 0.6, 0.25, 0.5, 0.8, 0.2, 1.5, 30.0


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    nodes = [(n, g) for n, g in rows.groupby("node", sort=True)]
    real = [g[g["start_sec"].notna()].sort_values(["context_score", "start_sec"], ascending=[False, True]) for _, g in nodes]
    starts = [np.concatenate([[np.nan], g["start_sec"].to_numpy(float)]) for g in real]
    ends = [np.concatenate([[np.nan], g["end_sec"].to_numpy(float)]) for g in real]
    skips = [SKIP * (REQUIRED if bool(g["required"].iloc[0]) else 1.0) for _, g in nodes]
    costs = [np.concatenate([[s], CONTEXT * (1 - g["context_score"].to_numpy(float)) + ANCHOR * g["anchor_cost"].to_numpy(float)]) for s, g in zip(skips, real, strict=True)]

    def move(i: int) -> np.ndarray:
        """Costs of going from each option of node i - 1 to each of node i; skipped nodes cost nothing here."""
        s0, e0, s1, e1 = starts[i - 1][:, None], ends[i - 1][:, None], starts[i][None], ends[i][None]
        over = np.clip((np.fmin(e0, e1) - np.fmax(s0, s1)) / 10, 0, 1)
        return np.nan_to_num(np.where(s1 < s0, REVERSE + REVERSE_OVERLAP * over, 0.0) * ~(np.isnan(s0) | np.isnan(s1)))

    ahead, back = [costs[0]], []
    for i in range(1, len(nodes)):
        total = ahead[-1][:, None] + move(i)
        back.append(total.argmin(0))
        ahead.append(total.min(0) + costs[i])
    behind = [costs[-1]]
    for i in reversed(range(len(nodes) - 1)):
        behind.append(costs[i] + (move(i + 1) + behind[-1][None]).min(1))
    behind = behind[::-1]
    pick = [int(ahead[-1].argmin())]
    for b in reversed(back):
        pick.append(int(b[pick[-1]]))
    pick, best, out = pick[::-1], float(ahead[-1].min()), []
    for i, (n, _) in enumerate(nodes):
        through = ahead[i] + behind[i] - costs[i]
        other = [through[j] for j in range(1, len(through)) if j != pick[i]]
        chosen = pick[i] > 0
        out.append((n, starts[i][pick[i]] if chosen else None, ends[i][pick[i]] if chosen else None, max(0.0, float(min(other)) - best) if other else None))
    return pd.DataFrame(out, columns=["node", "start_sec", "end_sec", "margin"])


def select_windows(windows: DataFrame, part: str, anchors: DataFrame | None = None) -> DataFrame:
    """(part, node, start_sec, end_sec, margin): the cheapest choice of one window or none for each node, in the order of nodes.

    Windows are (part, node long, start_sec, end_sec, context_score, required boolean); a node without any has one row with null
    times. A window costs what its score lacks, and its distance to the nearest of the anchors (part, t_sec); going back in time costs,
    and so does skipping, more for required nodes. The margin is what the best other window of the node would cost
    more; null without another.
    """
    if anchors is None:
        near = windows.withColumn("anchor_cost", F.lit(0.0))
    else:
        lists = anchors.where("t_sec is not null").groupBy(part).agg(F.collect_list("t_sec").alias("_t"))
        least = F.array_min(F.transform("_t", lambda t: F.abs(F.col("start_sec") - t)))
        near = windows.join(lists, part, "left").withColumn("anchor_cost", F.coalesce(F.least(F.lit(1.0), least / ANCHOR_SCALE), F.lit(0.0)))
    kind = windows.schema[part].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _choose(rows).assign(part=key[0])[["part", "node", "start_sec", "end_sec", "margin"]]

    narrow = near.select(part, "node", "start_sec", "end_sec", "context_score", F.coalesce("required", F.lit(False)).alias("required"), "anchor_cost")
    return narrow.groupBy(part).applyInPandas(run, f"part {kind}, node long, start_sec double, end_sec double, margin double").withColumnRenamed("part", part)


def in_seconds(segments: DataFrame, recordings: DataFrame, part: str) -> DataFrame:
    """Segments (part, start_sec, ...) with start_sec in seconds and the `unit` it was found in, by clock_units against the recording."""
    lengths = recordings.groupBy(part).agg(F.max("duration_sec").alias("_length"))
    units = clock_units(segments.select(part, "start_sec").join(lengths, part, "left"), [part], "start_sec", "_length").select(part, "unit")
    return segments.join(units, part, "left").withColumn("start_sec", F.when(F.col("unit") == "ms", F.col("start_sec") / 1000).otherwise(F.col("start_sec")))


def valid_clocks(segments: DataFrame, recordings: DataFrame, part: str, slack: float = 0.001, edge: float = 2.0) -> DataFrame:
    """(part, clock_valid, unit): whether the times of a part's segments, in their order and in seconds, do not fall by over `slack` and lie in the
    recording (part, duration_sec), give or take `edge` seconds; a part without times or without a sure unit is not valid."""
    before = F.lag("start_sec").over(Window.partitionBy(part).orderBy("seq"))
    timed = in_seconds(segments, recordings, part).where("start_sec is not null").withColumn("falls", F.coalesce(F.col("start_sec") < before - slack, F.lit(False)))
    seen = timed.groupBy(part).agg(F.bool_or("falls").alias("falls"), F.min("start_sec").alias("lo"), F.max("start_sec").alias("hi"), F.first("unit").alias("unit"))
    open_end = F.col("duration_sec").isNull() | (F.col("duration_sec") <= 0)
    inside = ~F.col("falls") & F.col("unit").isin("sec", "ms") & (open_end | ((F.col("lo") >= -edge) & (F.col("hi") <= F.col("duration_sec") + edge)))
    return recordings.join(seen, part, "left").select(part, F.coalesce(inside, F.lit(False)).alias("clock_valid"), "unit")


#: What an alignment needs to be sure of (fixed values).
SURE_ANCHOR, SURE_MARGIN = 0.9, 0.15


def align(segments: DataFrame, questions: DataFrame, recordings: DataFrame, part: str, verified: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """(part, number, status, start_sec, end_sec, confidence, margin, shared, reasons) of every question.

    Questions are (part, number, group_id, prompt, answer_variants), recordings (part, duration_sec, identity_verified, section_only).
    Parts without a recording whose identity is verified are left unverified; those whose clock is not valid have no
    candidates. Questions of a group share a node: windows of several of its questions that begin and end in the same seconds count
    more, and nearly equal ones are one. A question is verified only if a candidate of its own or the chosen window overlaps an
    independent label (verified: part, number, start_sec, end_sec) by half of the shorter one; else a sure choice is to be
    reviewed, another unverified with reasons.
    """
    clock = valid_clocks(segments, recordings, part).drop("unit")
    segments = in_seconds(segments, recordings, part).drop("unit")
    parts = recordings.select(part, F.coalesce("identity_verified", F.lit(False)).alias("identity"), F.coalesce("section_only", F.lit(False)).alias("section")).join(clock, part)
    q = questions.select(part, F.col("number").cast("long").alias("number"), "group_id", "prompt", "answer_variants").join(parts, part, "left").withColumn("identity", F.coalesce("identity", F.lit(False)))
    group = F.coalesce(F.col("group_id").cast("string"), F.concat(F.lit("q:"), F.col("number").cast("string")))
    q = written(q.withColumn("node", F.min("number").over(Window.partitionBy(part, group))))
    usable = q.where("identity and clock_valid")
    own = written(candidates(segments.join(usable.select(part).distinct(), part, "left_semi"), usable, part))
    of_node = own.join(usable.select(part, "number", "node"), [part, "number"])
    seconds = [F.round("start_sec").alias("a"), F.round("end_sec").alias("b")]
    shared = of_node.groupBy(part, "node", *seconds).agg(F.count_distinct("number").alias("k"), F.max_by(F.struct("start_sec", "end_sec", "source", "context_score", "answer_score"), F.struct("context_score", -F.col("start_sec"))).alias("w")).where("k >= 2")
    of_group = shared.select(part, "node", "w.start_sec", "w.end_sec", F.concat("w.source", F.lit("+group_window")).alias("source"), F.least(F.lit(1.0), F.col("w.context_score") + 0.1 * (F.col("k") - 1)).alias("context_score"), "w.answer_score", F.lit(True).alias("shared"))
    windows = written(merged_windows(of_node.drop("number").withColumn("shared", F.lit(False)).unionByName(of_group), [part, "node"]))
    nodes = usable.select(part, "node").distinct()
    choice = select_windows(nodes.join(windows, [part, "node"], "left").withColumn("required", F.lit(True)), part, anchors)
    detail = windows.select(part, "node", "start_sec", "end_sec", "source", "context_score", "answer_score", "shared").dropDuplicates([part, "node", "start_sec", "end_sec"])
    chosen = choice.join(detail, [part, "node", "start_sec", "end_sec"], "left")
    out = q.select(part, "number", "node", "identity", "section", F.coalesce("clock_valid", F.lit(False)).alias("clock")).join(chosen, [part, "node"], "left")
    half = lambda s, e: F.least(e, F.col("gold_end")) - F.greatest(s, F.col("gold_start")) >= 0.5 * F.least(e - s, F.col("gold_end") - F.col("gold_start"))
    meets = lambda s, e: F.col("gold_start").isNotNull() & s.isNotNull() & (F.least(e, F.col("gold_end")) > F.greatest(s, F.col("gold_start"))) & half(s, e)
    if verified is not None:
        gold = verified.select(part, F.col("number").cast("long").alias("number"), F.col("start_sec").alias("gold_start"), F.col("end_sec").alias("gold_end")).where("gold_start is not null and gold_end is not null")
        gold = gold.groupBy(part, "number").agg(F.min(F.struct("gold_start", "gold_end")).alias("g")).select(part, "number", "g.*")
        agreed = own.join(gold, [part, "number"]).groupBy(part, "number").agg(F.bool_or(meets(F.col("start_sec"), F.col("end_sec"))).alias("own_agrees"))
        out = out.join(gold, [part, "number"], "left").join(agreed, [part, "number"], "left")
    else:
        out = out.withColumn("gold_start", F.lit(None).cast("double")).withColumn("gold_end", F.lit(None).cast("double")).withColumn("own_agrees", F.lit(False))
    picked, anchor = F.col("start_sec").isNotNull(), F.coalesce(F.greatest("answer_score", F.when(F.col("source") == "transcript_qn_marker", MARKER), "context_score"), F.lit(0.0))
    failures = F.array_compact(F.array(
        F.when(~F.col("clock"), "clock_not_valid"), F.when(anchor < SURE_ANCHOR, "anchor_similarity_below_threshold"), F.when(F.col("margin") < SURE_MARGIN, "ambiguity_margin_below_threshold"),
    ))
    agrees = F.coalesce("own_agrees", F.lit(False)) | F.coalesce(meets(F.col("start_sec"), F.col("end_sec")), F.lit(False))
    status = (
        F.when(~F.col("identity"), "unverified").when(agrees, "verified").when(~picked, F.when(F.col("section"), "section_only").otherwise("unverified"))
        .when(F.size(failures) == 0, "needs_review").otherwise("unverified")
    )
    none = F.array().cast("array<string>")
    reasons = F.when(~F.col("identity"), F.array(F.lit("audio_identity_not_verified"))).when(agrees, none).when(~picked, F.array(F.lit("no_candidate_window"))).otherwise(failures)
    more = F.array_compact(F.array(F.when(F.col("shared"), "shared_group_window"), F.when(F.col("gold_start").isNotNull() & ~agrees, "gold_window_mismatch")))
    factor = F.when(F.col("margin").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("margin"))))
    sure = F.when(F.col("identity") & F.col("clock") & picked, F.least(F.lit(1.0), anchor) * factor).otherwise(0.0)
    return out.select(
        part, "number", status.alias("status"), F.when(agrees, F.col("gold_start")).otherwise(F.col("start_sec")).alias("start_sec"), F.when(agrees, F.col("gold_end")).otherwise(F.col("end_sec")).alias("end_sec"),
        F.round(sure, 4).alias("confidence"), "margin", F.coalesce("shared", F.lit(False)).alias("shared"), F.concat(reasons, F.when(F.col("identity"), more).otherwise(none)).alias("reasons"),
    )


def alignment_coverage(aligned: DataFrame, by: list[str]) -> DataFrame:
    """Questions of each key by status, and how many share their window with others."""
    states = ("verified", "needs_review", "section_only", "unverified", "missing")
    return aligned.groupBy(*by).agg(F.count("*").alias("questions_total"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.count_if("shared").alias("shared_windows"))
