"""Search, paging, sampling and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import search as S
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles

FILTER = S.QuestionFilter(
    session="june", keyword="50%_OFF", marks_min=2, has_official_answer=False, taxonomy_code="T3", taxonomy_source="manual", difficulty_min=0.2, difficulty_source="manual", leaves_only=True
)


def _found(r: Roles, f: S.QuestionFilter):
    return S.search_questions(r.questions(), r.papers(), r.links(), r.difficulty(), r.assets(), r.official(), f)


_FOUND = """
FROM question q JOIN paper p ON p.id = q.paper_id
WHERE session = 'june' AND contains(lower(stem_text), '50%_off') AND marks >= 2
  AND NOT EXISTS (SELECT 1 FROM official o WHERE o.question_id = q.id)
  AND EXISTS (SELECT 1 FROM link l WHERE l.question_id = q.id AND l.code = 'T3' AND l.source = 'manual')
  AND EXISTS (SELECT 1 FROM difficulty d WHERE d.question_id = q.id AND d.value >= 0.2 AND d.source = 'manual')
  AND NOT EXISTS (SELECT 1 FROM question c WHERE c.parent_id = q.id)
"""
_TWENTY = "ORDER BY year DESC NULLS LAST, paper_id, display_order, id LIMIT 20"


@query("SELECT id, board, qualification, subject_code, year, session FROM paper WHERE session = 'june' AND doc_type = 'question_paper' AND level = 'core'")
def f1_search_papers(r: Roles):
    return S.search_papers(r.papers(), S.PaperFilter(session="june", doc_type="question_paper", level="core")).select("id", "board", "qualification", "subject_code", "year", "session")


@query("SELECT count(*) AS total FROM paper WHERE board = 'ASIA' AND year = 2018")
def f2_count_papers(r: Roles):
    return S.counted(S.search_papers(r.papers(), S.PaperFilter(board="ASIA", year=2018)))


@query(f"SELECT q.id, paper_id, number_path, marks, year {_FOUND} {_TWENTY}")
def f3_search_questions(r: Roles):
    return S.page(_found(r, FILTER), S.question_order(), 20).select("id", "paper_id", "number_path", "marks", "year")


@query(f"SELECT count(*) AS total {_FOUND}")
def f4_count_questions(r: Roles):
    return S.counted(_found(r, FILTER))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), '%%')", with_roles=False)
def f5_keyword_literal(r: Roles):
    return r.table("documents").where(S.contains_literal("text", "%%")).select("doc_id", "lang")


@query("SELECT id, number_path FROM question q WHERE NOT EXISTS (SELECT 1 FROM question c WHERE c.parent_id = q.id)")
def f6_leaf_questions(r: Roles):
    return S.leaves(r.questions()).select("id", "number_path")


@query("SELECT id, number_path FROM question WHERE parent_id IS NULL")
def f6_root_questions(r: Roles):
    return S.roots(r.questions()).select("id", "number_path")


@query("SELECT id FROM question q WHERE id IN (SELECT question_id FROM asset) AND id NOT IN (SELECT question_id FROM official)")
def f7_asset_without_answer(r: Roles):
    return S.having(S.having(r.questions(), r.assets(), True), r.official(), False).select("id")


@query("SELECT id FROM question WHERE id IN (SELECT question_id FROM link WHERE code = 'T9' AND source = 'manual')")
def f8_topic_filter(r: Roles):
    return S.with_topic(r.questions(), r.links(), "T9", "manual").select("id")


@query("SELECT id FROM question WHERE id IN (SELECT question_id FROM difficulty WHERE value BETWEEN 0.3 AND 0.5 AND source = 'manual')")
def f9_difficulty_range(r: Roles):
    return S.with_difficulty(r.questions(), r.difficulty(), 0.3, 0.5, "manual").select("id")


@query("""
, best AS (SELECT question_id, max(confidence) AS confidence FROM link WHERE code = 'T8' AND confidence >= 0.3 GROUP BY 1),
hit AS (SELECT q.id, year, paper_id, display_order, confidence, stem_text FROM question q JOIN paper p ON p.id = q.paper_id JOIN best ON question_id = q.id WHERE board = 'ASIA')
SELECT id, year, paper_id, confidence, substr(trim(regexp_replace(stem_text, '\\s+', ' ', 'g')), 1, 200) AS excerpt, (SELECT count(*) FROM hit) AS total
FROM hit ORDER BY year DESC NULLS LAST, paper_id, display_order, id LIMIT 20
""")
def f10_tagged_questions(r: Roles):
    return S.tagged_questions(r.questions(), r.papers(), r.links(), "T8", board="ASIA", min_confidence=0.3)


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) AS excerpt FROM documents", with_roles=False)
def f11_excerpts(r: Roles):
    return r.table("documents").select("doc_id", S.excerpt("text").alias("excerpt"))


@query("""
SELECT c_custkey, CASE lower(trim(c_mktsegment)) WHEN 'household' THEN 'H' WHEN 'machinery' THEN 'M'
    ELSE CASE WHEN regexp_full_match(CAST(c_custkey AS VARCHAR), '\\d{4}') THEN 'FOUR' ELSE 'OTHER' END END AS board,
  CASE WHEN lower(trim(c_mktsegment)) IN ('household', 'machinery') THEN 'explicit' ELSE 'inferred' END AS how
FROM customer
""", with_roles=False)
def f12_resolve_board(r: Roles):
    c = r.table("customer").withColumn("subject", F.col("c_custkey").cast("string"))
    board, how = S.resolve_board("c_mktsegment", "subject", {"household": "H", "machinery": "M"}, "FOUR", "OTHER")
    return c.select("c_custkey", board.alias("board"), how.alias("how"))


@query("""
SELECT o_orderkey, coalesce(CASE split_part(o_orderpriority, '-', 2) WHEN 'URGENT' THEN 'summer' WHEN 'LOW' THEN 'winter' END,
  CASE WHEN month(o_orderdate) = 6 THEN 'summer' WHEN month(o_orderdate) = 11 THEN 'winter' END) AS season
FROM orders
""", with_roles=False)
def f13_normalize_season(r: Roles):
    o = r.table("orders").withColumn("month", F.month("o_orderdate"))
    return o.select("o_orderkey", S.normalize_season("o_orderpriority", "month", {"urgent": "summer", "low": "winter"}, {6: "summer", 11: "winter"}).alias("season"))


@query("SELECT id, CASE WHEN level IS NOT NULL THEN '/papers/' || replace(board, ' ', '+') || '/' || subject_code || '/' || year || '/' || level END AS link FROM paper")
def f14_paper_links(r: Roles):
    return r.papers().select("id", S.paper_link("board", "subject_code", "year", "level").alias("link"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'
  AND contains(lower(c_name || ' ' || c_mktsegment), '#00000001')
""", with_roles=False)
def f25_catalog_filter(r: Roles):
    c = r.table("customer").select(
        "c_custkey", "c_name", F.create_map(F.lit("segment"), "c_mktsegment").alias("identity_fields"), F.create_map(F.lit("name"), "c_name").alias("searchable"), F.array().cast("array<string>").alias("aliases")
    )
    return S.catalog_filter(c, {"segment": "BUILDING"}, ("segment",), "#00000001").select("c_custkey", "c_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS title FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget')", with_roles=False)
def f28_subject_search(r: Roles):
    return S.subject_search(r.table("part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("title")), "rw", {"rw": "widget red"})


@query("""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'finished'
  WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'pending' ELSE 'unknown' END AS state FROM customer
""", with_roles=False)
def f24_availability(r: Roles):
    o = r.table("orders").withColumnRenamed("o_custkey", "c_custkey")
    return S.state_of(r.table("customer").select("c_custkey"), {"finished": o.where("o_orderstatus = 'F'"), "pending": o.where("o_orderstatus = 'P'")}, ["c_custkey"])


@query("""
WITH after AS (SELECT c_name, c_custkey, row_number() OVER (ORDER BY c_name) AS n, count(*) OVER () AS everything FROM customer WHERE c_name > 'Customer#000000099')
SELECT c_name, c_custkey, CASE WHEN everything > 50 THEN (SELECT c_name FROM after WHERE n = 50) END AS next_key FROM after WHERE n <= 50
""", with_roles=False)
def t1_keyset_page(r: Roles):
    return S.keyset_page(r.table("customer").select("c_name", "c_custkey"), "c_name", "Customer#000000099", 50)


@query("SELECT id, paper_id, marks FROM question ORDER BY sha1(CAST(id AS VARCHAR) || ':7'), id LIMIT 25")
def t4_seeded_sample(r: Roles):
    return S.sample_questions(r.questions(), "id", 25, seed=7).select("id", "paper_id", "marks")


@query("""
SELECT id, marks FROM (SELECT id, marks, sum(marks) OVER (ORDER BY sha1(CAST(id AS VARCHAR) || ':7'), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM question WHERE marks > 0) WHERE coalesce(before, 0) < 100
""")
def t5_sample_until_marks(r: Roles):
    return S.sample_until_marks(r.questions(), "id", "marks", 100, seed=7).select("id", "marks")


@query("""
, n AS (SELECT board, count(*) AS total FROM paper WHERE year = 2018 GROUP BY 1)
SELECT b.board, coalesce(total, 0) AS total FROM (VALUES ('ASIA'), ('EUROPE'), ('NOWHERE')) AS b(board) LEFT JOIN n USING (board)
""")
def a3_counts_by_board(r: Roles):
    return S.count_by(S.search_papers(r.papers(), S.PaperFilter(year=2018)), "board", ["ASIA", "EUROPE", "NOWHERE"])


@query(f"SELECT q.id, paper_id, year FROM question q JOIN paper p ON p.id = q.paper_id {_TWENTY} OFFSET 40")
def w11_stable_page(r: Roles):
    return S.page(S.star(r.questions(), r.papers()), S.question_order(), 20, 40).select("id", "paper_id", "year")


@query("""
SELECT page_id, CAST((length(lower(html)) - length(replace(lower(html), 'class', ''))) / 5 AS BIGINT) AS hits
FROM pages WHERE contains(lower(html), 'class') ORDER BY hits DESC, page_id LIMIT 20
""", with_roles=False)
def t6_search_hits(r: Roles):
    from paperglass.functions.text import occurrences

    hits = r.table("pages").select("page_id", occurrences(F.col("html"), "class").alias("hits")).where("hits > 0")
    return hits.orderBy(F.desc("hits"), "page_id").limit(20)


@query("""
SELECT p_partkey FROM part WHERE ('promo' = lower(p_type) OR p_brand = 'Brand#3') AND p_size IN (7, 8, 9, 10) AND (contains(lower(p_name), 'red wid') OR contains(p_partkey::VARCHAR || ' ' || lower(p_brand), '2 brand#3'))
""", with_roles=False)
def f25_row_filter(r: Roles):
    p = r.table("part")
    tags = F.array(F.lower("p_type"), F.when(F.col("p_brand") == "Brand#3", "promo"))
    rows = p.select(tags.alias("tags"), F.sequence(F.col("p_size"), F.col("p_size") + 3).alias("sizes"), F.struct(F.array("p_name").alias("names"), F.struct("p_partkey", "p_brand").alias("own")).alias("of.it"))
    wanted = {"tags": "promo", "sizes": 10}
    first = S.row_filter(rows, wanted, " RED  wid").unionByName(S.row_filter(rows, wanted, "2 brand#3")).select(F.col("`of.it`.own.p_partkey").alias("p_partkey"))
    return first.distinct().unionByName(S.row_filter(rows, {"none": 1}).select(F.col("`of.it`.own.p_partkey").alias("p_partkey")))


@query("""
WITH a AS (SELECT o_orderkey AS id, 'fam' || o_custkey % 3 || '|' || strftime(o_orderdate, '%Y-%m') AS base, CASE WHEN o_orderkey % 4 = 0 THEN '|R' ELSE '' END AS r FROM orders),
have AS (SELECT DISTINCT 'fam' || l_suppkey % 3 || '|' || strftime(l_shipdate, '%Y-%m') AS key FROM lineitem WHERE l_orderkey % 40 = 0), off AS (SELECT DISTINCT base FROM a WHERE id % 60 = 0), lost AS (SELECT base || r AS key, min(id % 10) AS n FROM a WHERE id % 13 = 0 GROUP BY 1)
SELECT id, a.base || r AS key, CASE WHEN have.key IS NOT NULL THEN 'available' WHEN off.base IS NOT NULL THEN 'cancelled' WHEN lost.key IS NOT NULL THEN 'unobtainable' ELSE 'not_listed' END AS state,
  CASE WHEN have.key IS NOT NULL THEN NULL WHEN off.base IS NOT NULL THEN 'no exams' WHEN lost.key IS NOT NULL THEN 'lost ' || n END AS reason, CASE WHEN have.key IS NULL AND off.base IS NULL AND lost.key IS NOT NULL THEN 'page' END AS evidence
FROM a LEFT JOIN have ON have.key = a.base || a.r LEFT JOIN off ON off.base = a.base LEFT JOIN lost ON lost.key = a.base || a.r
""", with_roles=False)
def f24_season_reasons(r: Roles):
    season = lambda family, day: F.concat(F.lit("fam"), (F.col(family) % 3).cast("string"), F.lit("|"), F.date_format(day, "yyyy-MM"))
    o = r.table("orders").select(F.col("o_orderkey").alias("id"), season("o_custkey", "o_orderdate").alias("base"))
    asked = o.select("id", F.concat("base", F.when(F.col("id") % 4 == 0, "|R").otherwise("")).alias("key"))
    seasons = r.table("lineitem").where("l_orderkey % 40 = 0").select(season("l_suppkey", "l_shipdate").alias("key"))
    lost = asked.where("id % 13 = 0").select("key", F.concat(F.lit("lost "), (F.col("id") % 10).cast("string")).alias("reason"), F.lit("page").alias("evidence"))
    return S.season_availability(asked, seasons, o.where("id % 60 = 0").select(F.col("base").alias("key"), F.lit("no exams").alias("reason")), lost)
