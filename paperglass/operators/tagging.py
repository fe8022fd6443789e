"""Topic assignment by BM25 and by keywords, difficulty scores, and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperglass.functions.phrase_match import phrases_in, stands_alone
from paperglass.functions.text import topic_words

K1, B = 1.2, 0.75


def bm25_scores(points: DataFrame, questions: DataFrame, fields: dict[str, float], group: str | None = None, tokens=topic_words) -> DataFrame:
    """(id, key, score) of spec points (key, fields...) for questions (id, text), positive scores only.

    Field weights scale term counts and lengths; document counts and the mean length are those of the group, if one is
    given. A question's terms count once.
    """
    by = [group] if group else []
    weighted = None
    for name, weight in fields.items():
        part = points.select(*by, "key", F.explode_outer(tokens(F.col(name))).alias("term"), F.lit(weight).alias("x"))
        weighted = part if weighted is None else weighted.unionByName(part)
    tf = weighted.where("term is not null").groupBy(*by, "key", "term").agg(F.sum("x").alias("tf"))
    length = weighted.groupBy(*by, "key").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("x")).otherwise(0.0)).alias("len"))
    stats = length.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    posting = tf.join(df, [*by, "term"]).join(length, [*by, "key"])
    posting = posting.join(F.broadcast(stats), by) if by else posting.crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    terms = questions.select(*by, "id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.join(posting.select(*by, "key", "term", part.alias("part")), [*by, "term"]).groupBy("id", "key").agg(F.sum("part").alias("score")).where("score > 0")


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    """The k best keys of each question, ties to the smaller key."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assign_topics(candidates: DataFrame, existing: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, counts) of automatic assignments after a run.

    Candidates are (id, key, confidence), existing rows (question_id, code, source, confidence, reviewed), nodes (code). Questions that a person
    has tagged are left out; reviewed automatic rows are frozen and keep their question as it is; other automatic rows
    are replaced, and candidates whose topic does not exist are refused. Counts are by outcome.
    """
    manual = existing.where("source = 'manual'").select(F.col("question_id").alias("id")).distinct().withColumn("_manual", F.lit(True))
    frozen = existing.where("source = 'auto' and reviewed").select(F.col("question_id").alias("id")).distinct().withColumn("_frozen", F.lit(True))
    known = nodes.select(F.col("code").alias("key")).distinct().withColumn("_known", F.lit(True))
    j = candidates.join(manual, "id", "left").join(frozen, "id", "left").join(known, "key", "left")
    outcome = F.when(F.col("_manual"), "skipped_manual").when(F.col("_frozen"), "frozen_reviewed").when(F.col("_known").isNull(), "unknown_topic").otherwise("assigned")
    judged = j.withColumn("outcome", outcome)
    new = judged.where("outcome = 'assigned'").select(F.col("id").alias("question_id"), F.col("key").alias("code"), F.lit("auto").alias("source"), "confidence", F.lit(False).alias("reviewed"))
    stays = existing.where("source <> 'auto' or reviewed")
    return stays.unionByName(new), judged.groupBy("outcome").agg(F.count_distinct("id").alias("questions"), F.count("*").alias("rows"))


def keyword_weight(keyword: Column) -> Column:
    n = F.length(keyword)
    return F.when(n >= 14, 3.0).when(n >= 9, 2.2).when(n >= 6, 1.5).otherwise(1.0)


def keyword_topics(questions: DataFrame, keywords: DataFrame, min_confidence: float = 0.18) -> DataFrame:
    """(id, code, score, confidence): the two best topics of each question (id, text) by the weights of the keywords
    (code, keyword) that occur between non-alphanumeric signs.

    Keywords of letters and digits meet the text's distinct lower-case words in an equi-join; those with spaces, hyphens or
    other signs are looked for in the text as they stand, all in one pass, and meet their weights by join.
    """
    weighted = keywords.select("code", F.lower("keyword").alias("keyword"), keyword_weight(F.col("keyword")).alias("w")).distinct()
    single = F.col("keyword").rlike("^[a-z0-9]+$")
    words = questions.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))).alias("keyword"))
    by_word = words.join(weighted.where(single), "keyword").select("id", "code", "w")
    phrases = weighted.where(~single)
    lowered = questions.select("id", F.lower("text").alias("text"))
    met = phrases_in(lowered, phrases.select(F.col("keyword").alias("phrase")), stands_alone).withColumnRenamed("phrase", "keyword").distinct()
    by_phrase = met.join(phrases, "keyword").select("id", "code", "w")
    totals = by_word.unionByName(by_phrase).groupBy("id", "code").agg(F.sum("w").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "code")
    ranked = totals.withColumn("rank", F.row_number().over(w)).withColumn("best", F.first("score").over(w)).where("rank <= 2")
    confidence = F.round(0.65 * F.least(F.lit(1.0), F.col("score") / 6) + 0.35 * F.col("score") / F.col("best"), 4)
    return ranked.withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence).select("id", "code", F.round("score", 3).alias("score"), "confidence")


def with_parents(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assignments and those of their topics' parents at 0.9 of the confidence, each topic once with its highest."""
    up = assigned.join(nodes.select("code", "parent_code"), "code").where("parent_code is not null").select("id", F.col("parent_code").alias("code"), F.round(F.col("confidence") * 0.9, 4).alias("confidence"))
    return assigned.select("id", "code", "confidence").unionByName(up).groupBy("id", "code").agg(F.max("confidence").alias("confidence"))


#: Phrases of demanding questions and their weights (fixed values).
PHRASES = {
    "show that": 0.18, "prove": 0.22, "verify": 0.10, "exact value": 0.14, "hence": 0.10, "deduce": 0.12, "justify": 0.12,
    "explain why": 0.10, "in terms of": 0.08, "leaving your answer": 0.06, "correct to": 0.05, "without using": 0.10,
}


def difficulty(marks: Column, stem: Column, children: Column, depth: Column, has_asset: Column, topics: Column, phrases: dict[str, float] | None = None) -> Column:
    """A struct of the value and its features: weighted marks, log length, children, depth, figure, topics and phrases;
    one mark is at most 0.45 and two at most 0.65."""
    phrases = PHRASES if phrases is None else phrases
    m, one = F.coalesce(marks, F.lit(0)), F.lit(1.0)
    text = F.coalesce(stem, F.lit(""))
    length = F.when(F.length(text) == 0, 0.0).otherwise(F.least(one, F.log1p(F.length(text)) / F.log1p(F.lit(600))))
    hits = [(p, F.when(text.rlike(rf"(?i)\b{p}\b"), w).otherwise(0.0)) for p, w in phrases.items()]
    phrase = F.lit(0.0)
    for _, h in hits:
        phrase = phrase + h
    raw = 0.34 * F.least(one, m / 12) + 0.16 * length + 0.14 * F.least(one, children / 6) + 0.08 * F.least(one, depth / 3) + 0.08 * F.when(has_asset, 1.0).otherwise(0.0) + 0.06 * F.least(one, topics / 3) + phrase
    value = F.least(one, F.greatest(F.lit(0.0), raw))
    capped = F.when(m <= 1, F.least(value, F.lit(0.45))).when(m == 2, F.least(value, F.lit(0.65))).otherwise(value)
    found = F.array_sort(F.array_compact(F.array(*[F.when(h > 0, p) for p, h in hits])))
    return F.struct(F.round(capped, 4).alias("value"), F.round(raw, 4).alias("raw"), F.round(length, 4).alias("length_score"), F.length(text).alias("stem_chars"), found.alias("hard_phrases"))


def apply_review(decisions: DataFrame, tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """Decisions (question_id, decision, code) against the tags (question_id, code, source): what becomes of each.

    keep marks the tag as reviewed, change needs a known code, drop removes; others are errors, as are questions without
    an automatic tag.
    """
    auto = tags.where("source = 'auto'").groupBy("question_id").agg(F.min("code").alias("old_code"))
    known = nodes.select("code").distinct().withColumn("_known", F.lit(True))
    joined = decisions.join(auto, "question_id", "left").join(known, "code", "left")
    outcome = (
        F.when(~F.col("decision").isin("keep", "change", "drop"), "error_unknown_decision")
        .when(F.col("old_code").isNull(), "error_no_tag")
        .when((F.col("decision") == "change") & F.col("_known").isNull(), "error_unknown_code")
        .when((F.col("decision") == "change") & (F.col("code") == F.col("old_code")), "kept")
        .when(F.col("decision") == "keep", "kept")
        .when(F.col("decision") == "change", "changed")
        .otherwise("dropped")
    )
    return joined.select("question_id", outcome.alias("outcome"), F.when(outcome == "changed", F.col("code")).when(outcome == "kept", F.col("old_code")).alias("final_code"))
