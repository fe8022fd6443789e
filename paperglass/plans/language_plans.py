"""Labels, cover pages, question types, and language-test listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.functions import papers as P
from paperglass.functions import text as X
from paperglass.operators import answers as A
from paperglass.operators import coverage as C
from paperglass.operators import governance as G
from paperglass.operators import language_tests as N
from paperglass.operators import listings as L
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles



@query("""
SELECT id, year, session, CAST(paper_code AS INTEGER) AS paper, CAST(id % 9 AS INTEGER) AS variant, doc_type AS kind FROM paper
""")
def x14_label_parts(r: Roles):
    name = F.initcap(F.replace("doc_type", F.lit("_"), F.lit(" ")))
    label = F.concat(F.initcap("session"), F.lit(" "), F.col("year").cast("string"), F.lit(" "), name, F.when(F.col("doc_type") == "mark_scheme", " Scheme ").otherwise(" "), "paper_code", (F.col("id") % 9).cast("string"))
    parts = P.label_parts(label)
    return r.papers().select("id", *[c.alias(n) for n, c in parts.items()])


@query("SELECT id, lpad(CAST(1000 + id % 9000 AS VARCHAR), 4, '0') AS subject_code, CAST(id % 7 AS VARCHAR) AS component, CAST(id % 3 AS VARCHAR) AS variant, CAST(60 + 30 * (id % 2) AS INTEGER) AS minutes, CAST(40 + id % 60 AS INTEGER) AS total FROM paper")
def x15_cover_page(r: Roles):
    k = F.col("id")
    page = F.concat((1000 + k % 9000).cast("string"), F.lit("/"), (k % 7).cast("string"), (k % 3).cast("string"), F.when(k % 2 == 0, "\n1 hour").otherwise("\n1 hour 30 minutes"), F.lit("\nThe total mark for this paper is "), (40 + k % 60).cast("string"))
    return r.papers().select("id", *[c.alias(n) for n, c in P.cover_page(page).items()])


@query("SELECT id, CAST(1 + id % 20 AS VARCHAR) || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '(a)' ELSE '(b)(ii)' END AS path, CAST(CASE WHEN id % 4 <> 0 THEN 1 + id % 12 END AS INTEGER) AS marks FROM question")
def x16_number_grammar(r: Roles):
    k = F.col("id")
    line = F.concat((1 + k % 20).cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, " (a)").otherwise(" (b) (ii)"), F.lit(" Find it. "), F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("["), (1 + k % 12).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("("), (1 + k % 12).cast("string"), F.lit(" marks)"))))
    return r.questions().select("id", X.number_label(line).alias("path"), X.marks_of(line).alias("marks"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'U' || p_size ELSE CASE WHEN p_size >= 10 THEN 'WBI' || p_size END END AS unit FROM part", with_roles=False)
def x18_unit_code(r: Roles):
    attrs = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"unit_code": "U'), F.col("p_size").cast("string"), F.lit('"}'))).otherwise("{}")
    return r.table("part").select("p_partkey", P.unit_code(attrs, F.concat(F.lit("WBI"), F.col("p_size").cast("string"), F.lit("/01"))).alias("unit"))


@query("""
WITH e AS (SELECT user_id, (event_id % 50 + 50.0) * CASE user_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 60 END AS t, CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 10.0 WHEN 2 THEN 600.0 ELSE 100.0 END AS d FROM events),
m AS (SELECT user_id, max(t) AS top, max(d) AS d FROM e GROUP BY 1)
SELECT user_id, CASE WHEN d IS NULL THEN CASE WHEN top > 7200 THEN 'ms' WHEN top > 3600 THEN 'ambiguous' ELSE 'sec' END WHEN top <= d * 1.2 + 5 THEN 'sec'
  WHEN top / 1000 <= d * 1.2 + 5 THEN CASE WHEN top / 1000 >= d * 0.25 THEN 'ms' ELSE 'sec' END ELSE 'invalid' END AS unit,
  CAST(CASE WHEN d IS NULL THEN CASE WHEN top > 7200 THEN 0.6 WHEN top > 3600 THEN 0.3 ELSE 0.4 END WHEN top <= d * 1.2 + 5 THEN 0.95
  WHEN top / 1000 <= d * 1.2 + 5 THEN CASE WHEN top / 1000 >= d * 0.25 THEN 0.95 ELSE 0.5 END ELSE 0.9 END AS DOUBLE) AS confidence FROM m
""", with_roles=False)
def x27_clock_units(r: Roles):
    u = F.col("user_id")
    t = (F.col("event_id") % 50 + 50.0) * F.when(u % 4 == 0, 1000).when(u % 4 == 1, 1).when(u % 4 == 2, 2).otherwise(60)
    d = F.when(u % 7 == 1, 10.0).when(u % 7 == 2, 600.0).when(u % 7 != 0, 100.0)
    return P.clock_units(r.table("events").select("user_id", t.alias("t"), d.alias("d")), ["user_id"], "t", "d").select("user_id", "unit", "confidence")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'fill_blank' WHEN 2 THEN 'true_false_not_given' ELSE 'matching' END AS kind, p_size % 4 = 0 AND p_partkey % 2 = 0 OR p_size % 4 = 3 AND p_partkey % 2 = 0 AS conflict FROM part", with_roles=False)
def x33_question_types(r: Roles):
    m = F.col("p_size") % 4
    text = F.when(m == 0, "Choose the correct letter").when(m == 1, "Complete the notes").when(m == 2, "Write TRUE, FALSE or NOT GIVEN").otherwise("Match each name")
    pool = F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    kind, conflict = P.question_type(F.lit(None).cast("string"), text, pool)
    return r.table("part").select("p_partkey", kind.alias("kind"), conflict.alias("conflict"))


@query("SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') AS number FROM part", with_roles=False)
def x35_paper_numbers(r: Roles):
    return r.table("part").select("p_partkey", X.paper_number(F.concat(F.lit("Paper "), F.col("p_size").cast("string"))).alias("number"))


@query("SELECT c_custkey, c_mktsegment AS claim, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown_claim' ELSE 'quality_claim_invalid' END AS problem FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1) OR (c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0)", with_roles=False)
def x36_quality_claims(r: Roles):
    rows = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("claim"), F.array(F.when(F.col("c_custkey") % 2 == 0, "book").otherwise("scan")).alias("evidence"))
    return C.quality_claims(rows, {"BUILDING": ("book",), "MACHINERY": ("scan", "ocr")}).select(F.col("id").alias("c_custkey"), "claim", "problem")


@query("SELECT event_id AS id, user_id FROM events WHERE event_type = 'error' ORDER BY user_id, event_id LIMIT 50", with_roles=False)
def f15_review_queue(r: Roles):
    t = r.table("events").select(F.col("event_id").alias("id"), "user_id", F.col("user_id").alias("priority"), F.when(F.col("event_type") == "error", "open").otherwise("done").alias("status"))
    return G.review_queue(t).select("id", "user_id")


@query("""
SELECT c_custkey, c_mktsegment AS skill, skill_total FROM customer JOIN (SELECT c_mktsegment, count(*) AS skill_total FROM customer WHERE c_nationkey = 3 GROUP BY 1) USING (c_mktsegment)
WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 20 OFFSET 5
""", with_roles=False)
def f26_language_questions(r: Roles):
    rows = r.table("customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("skill"))
    return N.filter_questions(rows, {"c_nationkey": 3, "skill": None}, 20, 5, ["c_custkey"]).select("c_custkey", "skill", "skill_total")


@query("""
SELECT p_brand, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'https://a.example/' || p_size ELSE 'https://site.example/x/' || p_size END AS url FROM (
  SELECT *, count(*) FILTER (p_name LIKE '%red%') OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size % 3 <> 0) WHERE n = 0 OR p_name LIKE '%red%'
""", with_roles=False)
def f32_specification_pick(r: Roles):
    p = r.table("part").select("p_brand", "p_partkey", F.replace("p_name", F.lit("red"), F.lit("specification")).alias("title"), F.when(F.col("p_size") % 3 == 0, "/secure/x").when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://a.example/"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("x/"), F.col("p_size").cast("string"))).alias("url"))
    return L.specification_pick(p, "p_brand", "title", "url", "https://site.example/").select("p_brand", "p_partkey", "url")


@query("SELECT 'm' || c_nationkey AS scope, c_custkey AS public_id, CASE WHEN c_custkey % 4 = 0 THEN 'manifest_id_not_published' ELSE 'manifest_id_wrong_scope' END AS code FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 1", with_roles=False)
def j30_scope_problems(r: Roles):
    c = r.table("customer").select(F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("scope"), F.col("c_mktsegment").alias("system"), F.lit("k").alias("kind"), F.col("c_custkey").alias("public_id"))
    entries = c.where("public_id % 4 <> 0").withColumn("kind", F.when(F.col("public_id") % 6 == 1, "other").otherwise("k"))
    return C.scope_problems(c, entries)


@query("""
SELECT paper_id, count(DISTINCT display_order) AS questions, count(DISTINCT display_order) FILTER (id % 3 = 0) AS answered,
  list_filter(range(1, 13), lambda n: NOT list_contains(list(CAST(display_order AS BIGINT)), n)) AS missing
FROM question WHERE display_order BETWEEN 1 AND 12 AND id % 7 <> 0 GROUP BY 1
""")
def j27_resolve_tests(r: Roles):
    q = r.questions().where("display_order between 1 and 12 and id % 7 <> 0").withColumnRenamed("display_order", "number")
    manifest = q.select("paper_id").distinct().withColumn("expected", F.lit(12))
    out = N.resolve_tests(manifest, q, q.where("id % 3 = 0"), q.where("false"), ["paper_id"])
    return out.select("paper_id", "questions", "answered", F.col("missing").cast("array<bigint>").alias("missing"))


@query("SELECT id, before, CASE WHEN id % 3 = 0 THEN 'approved' ELSE 'rejected' END AS after FROM (SELECT o_orderkey AS id, o_orderstatus AS before FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0)", with_roles=False)
def g11_explanation_review(r: Roles):
    k = F.col("id")
    e = r.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    d = e.where("id % 5 = 0").select("id", F.when(k % 7 == 0, "nonsense").when(k % 3 == 0, "approved").otherwise("rejected").alias("status"), F.lit("me").alias("reviewer"))
    tasks = e.select(k.alias("target_id"), F.lit("open").alias("status"), F.lit("stale_source").alias("reason"))
    return N.review_explanations(e, tasks, d)[2].select("id", "before", "after")


@query("SELECT 'S' || s_nationkey AS id, CASE WHEN count(*) > 1 THEN 'duplicate_scope' END AS code FROM supplier GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT 'S' || s_nationkey, 'expected_below_exclusions' FROM supplier WHERE s_suppkey % 3 = 0", with_roles=False)
def s17_manifest_problems(r: Roles):
    s = r.table("supplier").select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(5).alias("expected"), F.array(F.lit("a"), F.lit("b")).alias("exclusions"), F.array(F.lit("c")).alias("partial"))
    return C.manifest_problems(s)
