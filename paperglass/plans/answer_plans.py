"""Adjudication of answers and alignment of questions with transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import alignment as N
from paperglass.operators import answers as A
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


@query("""
SELECT o_orderkey, CASE WHEN k = 0 THEN 'identity_missing' WHEN k = 1 THEN 'identity_incomplete' WHEN k = 2 THEN 'identity_book_mismatch' WHEN k = 3 THEN 'identity_skill_mismatch' WHEN k = 4 THEN 'identity_edition_mismatch' END AS rejected, k = 5 AS edition_unverified
FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)
""", with_roles=False)
def j18_identity_gate(r: Roles):
    k, text = F.col("o_orderkey") % 7, lambda v: F.lit(v).cast("string")
    given = lambda v, *but: F.when(k.isin(0, *but), None).otherwise(F.lit(v))
    rows = r.table("orders").select(
        "o_orderkey", F.when(k == 2, 9).otherwise(given(1)).alias("book"), given(2, 1).alias("test"), F.when(k == 3, "l").otherwise(given("r")).alias("skill"), text(None).alias("variant"),
        F.when(k == 4, "x").otherwise(given("e", 5)).alias("edition"), F.lit(1).alias("want_book"), F.lit(2).alias("want_test"), text("r").alias("want_skill"), text("A").alias("want_variant"), text("e").alias("want_edition"),
    )
    return A.identity_gate(rows).select("o_orderkey", "rejected", "edition_unverified")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 'fixed' ELSE o_orderstatus END AS value,
  CASE o_orderkey % 50 WHEN 7 THEN 'applied' WHEN 8 THEN CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'unconfirmed' END WHEN 9 THEN 'stale' WHEN 10 THEN CASE WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'unconfirmed' END ELSE 'none' END AS decision_state FROM orders
""", with_roles=False)
def j17_guarded_correction(r: Roles):
    o = r.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    m = F.col("o_orderkey") % 50
    d = o.where(m.isin(7, 8, 9, 10)).select(
        "o_orderkey", F.when(m.isin(8, 10), "confirm").otherwise("correct").alias("action"), F.when(m == 7, F.col("value")).otherwise("?").alias("from"), F.lit("fixed").alias("to"),
        F.when(m == 8, "(of) f").alias("book_value"), F.when(m == 10, F.array(F.lit("zero"), F.lit(" o "))).alias("equivalents"),
    )
    return A.guarded_correction(o, d.withColumn("book_value", F.when(m == 8, "f").otherwise(None)), ["o_orderkey"])


#: Scenes of adjudication: candidates (upstream, class, verified, visual, ocr, edition open, order open, raw, allowed), a decision, and status, answer, rule.
_SCENES = [
    ([("u", None, True, False, False, False, False, "Beach", None), ("w", None, False, False, False, False, False, "(the) beach", None)], None, "source_verified", "Beach", "explicit_number"),
    ([("u", None, True, False, False, False, False, "cat", None), ("w", None, False, False, False, False, False, "dog", None), ("w", None, False, False, False, False, False, "DOG", None)], None, "conflict", "cat", "conflict_unresolved"),
    ([("u", None, True, False, False, False, False, " ", None)], None, "missing", None, "missing_no_candidate"),
    ([("u", None, False, False, False, False, False, "old", None)], ("correct", "old", "new", None, None, None), "official_verified", "new", "decision_correction"),
    ([("u", None, False, False, False, False, False, "other", None)], ("correct", "old", "new", None, None, None), "identity_linked", "other", "explicit_number"),
    ([("u", None, False, False, False, False, False, "", None)], ("correct", "old", "new", None, None, None), "decision_stale", None, "decision_stale"),
    ([("u", None, True, False, False, True, False, "x1", None)], None, "unverified", "x1", "explicit_number"),
    ([("u", "official_pdf", False, True, True, False, False, "x1", None), ("w", None, True, False, False, False, False, "x1", None)], None, "official_verified", "x1", "explicit_number"),
    ([("u", None, True, False, False, False, True, None, None)], None, "order_unverified", None, "order_unverified"),
    ([("u", None, False, False, True, False, False, "six", None)], ("confirm", None, None, "6", None, None), "official_verified", "6", "decision_confirmed"),
    ([("u", None, False, False, False, False, False, "colour", ["color"]), ("w", None, True, False, False, False, False, "color", None)], None, "source_verified", "color", "explicit_number"),
    ([("u", None, False, False, False, False, False, "B", None), ("w", None, False, False, False, False, False, "Green tea", None)], None, "identity_linked", "B", "explicit_number"),
    ([("u", None, False, False, False, False, False, "NG", None), ("w", None, False, False, False, False, False, "not given", None)], None, "identity_linked", "NG", "explicit_number"),
    ([("u", None, False, False, False, False, False, "junk", None)], ("confirm", None, None, "6", None, ["JUNK"]), "missing", None, "missing_no_candidate"),
]
_CANDIDATE = "upstream string, source_class string, verified boolean, visual_verified boolean, ocr boolean, edition_unverified boolean, order_unverified boolean, raw string, allowed_variants array<string>"


def _adjudicated(r: Roles):
    n = len(_SCENES)
    q = r.table("orders").select("o_orderkey", (F.col("o_orderkey") % n).alias("k"))
    k = F.col("k")
    instruction = F.when(k == 12, "Write TRUE, FALSE or NOT GIVEN").otherwise("Complete the notes")
    options = F.when(k == 11, F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in (("A", "black tea"), ("B", "green tea"))]))
    questions = q.select("o_orderkey", instruction.alias("instruction"), options.alias("options"), F.lit(None).cast("array<string>").alias("allowed_variants"))
    known = r.spark.createDataFrame([(s, p, *c) for s, scene in enumerate(_SCENES) for p, c in enumerate(scene[0])], f"k long, position long, {_CANDIDATE}")
    ruled = r.spark.createDataFrame([(s, *scene[1]) for s, scene in enumerate(_SCENES) if scene[1]], "k long, action string, from string, to string, book_value string, equivalents array<string>, artifact_values array<string>")
    # the scenes are a fixed table; without the hint Spark, which does not know its size, broadcasts the orders or deals them by fourteen scenes
    return A.adjudicate(questions, q.join(F.broadcast(known), "k").drop("k"), q.join(F.broadcast(ruled), "k").drop("k"), ["o_orderkey"])


def _scene(at: int) -> str:
    return f"{[s[at] for s in _SCENES]}[1 + o_orderkey % {len(_SCENES)}]".replace("None", "NULL")


@query(f"""
SELECT o_orderkey, {_scene(2)} AS status, {_scene(3)} AS answer, {_scene(4)} AS rule, CASE WHEN o_orderkey % {len(_SCENES)} = 11 THEN 'b' END AS label, CASE WHEN o_orderkey % {len(_SCENES)} = 1 THEN ['cat:u', 'dog:w'] ELSE [] END AS conflicts FROM orders
""", with_roles=False)
def a29_adjudicate(r: Roles):
    shown = F.transform("conflicts", lambda c: F.concat(c["value"], F.lit(":"), F.array_join(c["upstreams"], "+")))
    return _adjudicated(r).select("o_orderkey", "status", "answer", "rule", "label", shown.alias("conflicts"))


@query(f"""
WITH s AS (SELECT o_orderkey % 10 AS "group", {_scene(2)} AS status FROM orders)
SELECT "group", count(*) AS processed, count(*) FILTER (status <> 'missing') AS answered, count(*) FILTER (status = 'conflict') AS conflict, count(*) FILTER (status = 'decision_stale') AS decision_stale, count(*) FILTER (status = 'unverified') AS unverified FROM s GROUP BY 1
""", with_roles=False)
def a29_adjudication_coverage(r: Roles):
    found = _adjudicated(r).withColumn("group", F.col("o_orderkey") % 10)
    return A.adjudication_coverage(found, ["group"]).select("group", "processed", "answered", "conflict", "decision_stale", "unverified")


def _segments(r: Roles):
    """A conversation is a recording; every third row marks the question of the row after it."""
    c = r.table("conversations")
    return c.select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 20.0).alias("start_sec"), "text", F.when(F.col("turn") % 3 == 0, F.array(F.col("turn").cast("int") + 1)).otherwise(F.array().cast("array<int>")).alias("q"))


def _questions(r: Roles):
    """A question for each row: its answer is the first sentence of the row; of every fourth none is known, but a prompt is."""
    c, first = r.table("conversations"), F.substring_index("text", ".", 1)
    known = F.col("turn") % 4 != 3
    return c.select("conv_id", F.col("turn").alias("number"), F.when(known, F.lit("")).otherwise(first).alias("prompt"), F.when(known, F.array(first, F.lit("no such answer"))).otherwise(F.array().cast("array<string>")).alias("answer_variants"))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9'']+'), lambda w: w <> '')"


@query(f"""
WITH s AS (SELECT conv_id, turn AS seq, turn * 20.0 AS a, turn * 20.0 + CASE WHEN lead(turn) OVER w IS NULL THEN 12.0 ELSE least((lead(turn) OVER w - turn) * 20.0, 30.0) END AS b, {_WORDS.format("text")} AS words FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn AS number, {_WORDS.format("split_part(text, '.', 1)")} AS phrase FROM conversations),
m AS (SELECT conv_id, seq, seq + 1 AS number FROM s WHERE seq % 3 = 0 AND EXISTS (SELECT 1 FROM q WHERE q.conv_id = s.conv_id AND q.number = s.seq + 1)),
h AS (SELECT q.conv_id, number, seq, a, b FROM q JOIN s USING (conv_id) WHERE number % 4 <> 3 AND len(phrase) BETWEEN 1 AND 9 AND regexp_matches(' ' || array_to_string(words, ' ') || ' ', ' ' || array_to_string(phrase, ' (?:.* )?') || ' ')),
w AS (SELECT m.conv_id, m.number, a AS start_sec, b AS end_sec, 'transcript_qn_marker' AS source, 0.55 AS context_score FROM m JOIN s USING (conv_id, seq) WHERE NOT (a < 1.5 AND EXISTS (SELECT 1 FROM h WHERE h.conv_id = m.conv_id AND h.number = m.number AND h.seq = m.seq))
  UNION ALL SELECT h.conv_id, h.number, greatest(0, a - 2), b + 2, CASE WHEN m.seq IS NULL THEN 'answer_occurrence' ELSE 'answer_in_marker_window' END, CASE WHEN m.seq IS NULL THEN 0.55 ELSE 0.85 END FROM h LEFT JOIN m ON m.conv_id = h.conv_id AND m.number = h.number AND m.seq = h.seq)
SELECT conv_id, number, count(*) AS n_windows, CAST(min(start_sec) AS DOUBLE) AS first_start FROM w WHERE number % 4 <> 3 AND (conv_id, number) IN (SELECT (conv_id, number) FROM q WHERE len(phrase) BETWEEN 1 AND 9) GROUP BY 1, 2
""", with_roles=False)
def j19_transcript_candidates(r: Roles):
    """Windows of the questions with short answers, those of markers and answers; at the start of a recording they coincide."""
    q = _questions(r)
    short = q.where("number % 4 <> 3").where(F.size(F.filter(F.split(F.lower(F.get("answer_variants", 0)), "[^a-z0-9']+"), lambda w: w != "")).between(1, 9)).select("conv_id", "number")
    found = N.candidates(_segments(r), q, "conv_id").join(short, ["conv_id", "number"], "left_semi").where("source <> 'stem_keywords'")
    return found.groupBy("conv_id", "number").agg(F.count("*").alias("n_windows"), F.min("start_sec").alias("first_start"))


@query()
def g5_select_windows(r: Roles):
    c = r.table("conversations").select("conv_id", F.col("turn").cast("long").alias("node"), (F.col("turn") * 15.0 + F.length("text") % 40).alias("start_sec"), (F.col("turn") * 15.0 + F.length("text") % 40 + 10).alias("end_sec"), ((F.length("text") % 10) / 10).alias("context_score"), (F.col("turn") % 2 == 0).alias("required"))
    more = c.withColumn("start_sec", F.col("start_sec") + 7).withColumn("end_sec", F.col("end_sec") + 9).withColumn("context_score", 1 - F.col("context_score"))
    anchors = c.where("node % 3 = 0").select("conv_id", F.col("start_sec").alias("t_sec"))
    return N.select_windows(c.unionByName(more), "conv_id", anchors)


def _aligned(r: Roles):
    q = _questions(r).withColumn("group_id", F.when(F.col("number").isin(1, 2), "g").otherwise(None))
    recordings = q.select("conv_id").distinct().select("conv_id", F.lit(170.0).alias("duration_sec"), (F.col("conv_id") % 7 != 0).alias("identity_verified"), (F.col("conv_id") % 5 == 0).alias("section_only"))
    gold = q.where("number % 2 = 0").select("conv_id", "number", (F.col("number") * 20.0 + 1).alias("start_sec"), (F.col("number") * 20.0 + 11).alias("end_sec"))
    return N.align(_segments(r), q, recordings, "conv_id", gold)


@query()
def g9_align_questions(r: Roles):
    return _aligned(r)


@query("SELECT conv_id, count(*) AS questions_total, count(*) AS unverified FROM conversations WHERE conv_id % 7 = 0 GROUP BY 1", with_roles=False)
def a30_alignment_counts(r: Roles):
    """Recordings whose identity is not verified: all of their questions are unverified."""
    return N.alignment_coverage(_aligned(r), ["conv_id"]).where("conv_id % 7 = 0").select("conv_id", "questions_total", "unverified")
