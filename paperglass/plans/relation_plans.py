"""Joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import alignment as A
from paperglass.operators import governance as G
from paperglass.operators import ranking as W
from paperglass.operators import relations as J
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


@query("SELECT q.id, p.board, p.subject_code FROM question q JOIN paper p ON p.id = q.paper_id")
def j1_star_chain(r: Roles):
    from paperglass.operators.search import star

    return star(r.questions(), r.papers()).select("id", "board", "subject_code")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1
""", with_roles=False)
def j3_latest_revision(r: Roles):
    return J.latest(r.table("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
, one AS (SELECT subject_code, year, level, qualification, min(id) AS match_id FROM paper WHERE doc_type = 'question_paper' GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)
SELECT m.id, match_id FROM paper m LEFT JOIN one o ON m.subject_code = o.subject_code AND m.year = o.year
  AND m.level IS NOT DISTINCT FROM o.level AND m.qualification = o.qualification
WHERE m.doc_type = 'mark_scheme'
""")
def j5_unique_null_safe_match(r: Roles):
    p = r.papers()
    return J.unique_match(p.where("doc_type = 'mark_scheme'"), p.where("doc_type = 'question_paper'"), ["subject_code", "year", "level", "qualification"], "id", "match_id").select("id", "match_id")


@query("""
, step AS (
  SELECT id, paper_id, number_path, 0 AS level FROM entry
  UNION ALL SELECT id, paper_id, regexp_replace(number_path, '\\([^()]*\\)$', ''), 1 FROM entry WHERE contains(number_path, '(')
  UNION ALL SELECT id, paper_id, regexp_replace(number_path, '\\([^()]*\\)\\([^()]*\\)$', ''), 2 FROM entry WHERE number_path LIKE '%(%(%'),
hit AS (SELECT s.id, q.id AS question_id, level, row_number() OVER (PARTITION BY s.id ORDER BY level) AS n FROM step s JOIN question q USING (paper_id, number_path))
SELECT e.id, question_id, level FROM entry e LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON h.id = e.id
""")
def j6_link_entries(r: Roles):
    return J.link_entries(r.entries(), r.questions()).select("id", "question_id", "level")


@query("""
, good AS (SELECT paper_id, number_path, min_by(text, id) AS text FROM entry WHERE trim(text) <> '' GROUP BY 1, 2),
own AS (SELECT q.id, q.paper_id, q.number_path, coalesce(o.content, g.text) AS own FROM question q LEFT JOIN good g USING (paper_id, number_path) LEFT JOIN official o ON o.question_id = q.id),
up AS (SELECT o.id, g.number_path AS path, g.text FROM own o JOIN good g ON g.paper_id = o.paper_id AND g.number_path = regexp_replace(o.number_path, '\\([^()]*\\)$', '')
  WHERE o.own IS NULL AND contains(o.number_path, '(')),
down AS (SELECT o.id, string_agg(substr(g.number_path, length(o.number_path) + 1) || ' ' || g.text, chr(10) || chr(10) ORDER BY g.number_path) AS below
  FROM own o JOIN good g ON g.paper_id = o.paper_id AND starts_with(g.number_path, o.number_path || '(') WHERE o.own IS NULL GROUP BY 1)
SELECT o.id, CASE WHEN own IS NOT NULL THEN 'exact' WHEN up.text IS NOT NULL THEN 'ancestor' WHEN below IS NOT NULL THEN 'descendants' ELSE 'none' END AS mode,
  CASE WHEN own IS NOT NULL THEN o.number_path WHEN up.text IS NOT NULL THEN up.path END AS source_path, coalesce(own, up.text, below) AS answer
FROM own o LEFT JOIN up USING (id) LEFT JOIN down USING (id)
""")
def j10_resolve_answers(r: Roles):
    return J.resolve_answers(r.questions().select("id", "paper_id", "number_path"), r.entries(), r.official())


@query("SELECT o_orderkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND o_custkey NOT IN (SELECT c_custkey + 1 FROM customer WHERE c_custkey % 10 = 0)", with_roles=False)
def j14_dangling_references(r: Roles):
    c = F.col("c_custkey")
    known = r.table("customer").where("c_custkey % 2 = 0").select(c.alias("public_id"), F.when(c % 10 == 0, F.array(c + 1)).otherwise(F.array().cast("array<bigint>")).alias("aliases"))
    return J.dangling(r.table("orders").select(F.col("o_orderkey").alias("ref"), "o_custkey"), "o_custkey", known).select("ref")


@query("SELECT lower(trim(p_name)) AS alias, count(DISTINCT p_partkey) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1", with_roles=False)
def j15_alias_conflicts(r: Roles):
    return J.alias_conflicts(r.table("part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("public_id")))


@query("""
, e AS (SELECT DISTINCT paper_id, display_order AS number FROM question), o AS (SELECT DISTINCT paper_id, CAST(id % 45 AS INTEGER) AS number FROM entry)
SELECT *, 'missing' AS kind FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)
""")
def j16_expected_observed(r: Roles):
    o = r.entries().select("paper_id", F.pmod("id", F.lit(45)).cast("int").alias("number"))
    return J.expected_observed(r.questions().select("paper_id", F.col("display_order").alias("number")), o, ["paper_id", "number"])


@query("""
, n AS (SELECT subject_code, qualification, year, count(*) FILTER (doc_type = 'question_paper') AS n_0, count(*) FILTER (doc_type = 'mark_scheme') AS n_1 FROM paper GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_0 > 1 OR n_1 > 1 THEN 'ambiguous' WHEN n_0 = 1 AND n_1 = 1 THEN 'paired' WHEN n_0 = 1 THEN 'question_paper_only' WHEN n_1 = 1 THEN 'mark_scheme_only' ELSE 'none' END AS status FROM n
""")
def j22_pairing(r: Roles):
    return J.pairing(r.papers(), ["subject_code", "qualification", "year"], "doc_type", "question_paper", "mark_scheme")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'middle' WHEN p_size BETWEEN 31 AND 45 THEN 'large' END AS era FROM part", with_roles=False)
def j29_range_lookup(r: Roles):
    eras = r.spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (31, 45, "large")], "low int, high int, era string")
    return J.range_lookup(r.table("part").select("p_partkey", "p_size"), "p_size", eras, "low", "high", "era").select("p_partkey", "era")


@query("""
, a AS (SELECT id, unnest([id, parent_id]) AS anc FROM node)
SELECT n.id, n.id AS ancestor_id, 0 AS distance FROM node n
UNION ALL SELECT n.id, n.parent_id, 1 FROM node n WHERE n.parent_id IS NOT NULL
UNION ALL SELECT n.id, m.parent_id, 2 FROM node n JOIN node m ON m.id = n.parent_id WHERE m.parent_id IS NOT NULL
""")
def j24_ancestor_nodes(r: Roles):
    return J.ancestor_nodes(r.nodes())


@query("""
, k AS (SELECT paper_id, display_order % 20 AS slot, min(id) AS question_id FROM question GROUP BY 1, 2 HAVING count(*) = 1)
SELECT e.id, question_id, CASE WHEN question_id IS NULL THEN 'orphaned' ELSE 'attached' END AS status
FROM (SELECT id, paper_id, CAST(id % 25 AS INTEGER) AS slot FROM entry) e LEFT JOIN k USING (paper_id, slot)
""")
def j8_reattach(r: Roles):
    q = r.questions().withColumn("slot", F.pmod("display_order", F.lit(20)))
    return J.reattach(r.entries().select("id", "paper_id", F.pmod("id", F.lit(25)).cast("int").alias("slot")), q, ["paper_id", "slot"]).select("id", "question_id", "status")


@query("""
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.v ELSE n.v END AS v,
  CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'kept' WHEN o.v <> n.v THEN 'updated' ELSE 'same' END AS action
FROM (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 3 <> 0) o
FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 4 <> 0) n ON o.k = n.k
""", with_roles=False)
def s12_upsert_nodes(r: Roles):
    s = r.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    new = s.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return J.merge(s.where("k % 3 <> 0"), new, ["k"], ["v"])


@query("""
SELECT user_id, event_id, CASE WHEN prev IS NULL THEN 'initial' ELSE 'content_changed' END AS change, prev AS supersedes
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type
""", with_roles=False)
def w6_change_chain(r: Roles):
    return W.change_chain(r.table("events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "change", "supersedes")


@query("""
SELECT user_id, event_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS revision_no
FROM (SELECT * FROM events WHERE event_type = 'click') LEFT JOIN (SELECT user_id, count(*) AS top FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id)
""", with_roles=False)
def w5_revision_numbers(r: Roles):
    e = r.table("events")
    known = e.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("revision_no"))
    return W.revision_numbers(e.where("event_type = 'click'"), "user_id", ["ts", "event_id"], known).select("user_id", "event_id", F.col("revision_no").cast("long"))


@query("""
SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak
FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
""", with_roles=False)
def w8_empty_streaks(r: Roles):
    return W.empty_streaks(r.table("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "streak")


@query("""
, e AS (SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN date_trunc('hour', ts) END AS native, ts, event_type, props FROM events),
t AS (SELECT user_id, max(native) AS top FROM e GROUP BY 1),
k AS (SELECT e.user_id, count(DISTINCT props) AS kinds FROM e JOIN t USING (user_id) WHERE native = top GROUP BY 1)
SELECT event_id, user_id, CASE WHEN native = top AND kinds > 1 THEN 'conflict'
  WHEN row_number() OVER (PARTITION BY user_id ORDER BY native DESC NULLS LAST, ts DESC, event_id DESC) = 1 THEN 'current' ELSE 'superseded' END AS state
FROM e JOIN t USING (user_id) LEFT JOIN k USING (user_id)
""")
def w7_freshness(r: Roles):
    e = r.table("events").withColumn("native", F.when(F.col("event_id") % 17 != 0, F.date_trunc("hour", "ts")))
    return W.freshness(e, "user_id", "native", "ts", "event_id", "props").select("event_id", "user_id", "state")


@query("""
SELECT paper_id, number, rule FROM (
  SELECT *, CASE WHEN prev IS NULL AND number <> 1 THEN 'not_start_at_one' WHEN number > prev + 1 THEN 'gap' END AS rule
  FROM (SELECT *, lag(number) OVER (PARTITION BY paper_id ORDER BY number) AS prev FROM (SELECT DISTINCT paper_id, display_order + 1 AS number FROM question WHERE id % 9 <> 0)))
WHERE rule IS NOT NULL
""")
def w9_numbering_problems(r: Roles):
    return W.numbering_problems(r.questions().where("id % 9 <> 0").select("paper_id", (F.col("display_order") + 1).alias("number")), "paper_id", "number")


@query("""
SELECT conv_id, turn, CASE WHEN e <= start THEN start + 1 ELSE e END AS end_sec
FROM (SELECT *, CASE WHEN nxt IS NULL THEN start + 12.0 ELSE least(nxt, start + 30.0) END AS e
  FROM (SELECT *, lead(start) OVER (PARTITION BY conv_id ORDER BY start, turn) AS nxt FROM (SELECT conv_id, turn, CAST(floor(turn * turn / 3) * 2.5 AS DOUBLE) AS start FROM conversations)))
""", with_roles=False)
def w10_segment_bounds(r: Roles):
    c = r.table("conversations").select("conv_id", "turn", F.col("turn").alias("seq"), (F.floor(F.col("turn") * F.col("turn") / 3) * 2.5).cast("double").alias("start_sec"))
    return A.segment_bounds(c, "conv_id").select("conv_id", "turn", "end_sec")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN value * 1000 ELSE value END AS t, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 10.0 ELSE 400.0 END AS d FROM events WHERE user_id % 5 <> 1 OR event_id % 2 = 0),
u AS (SELECT user_id, max(t) AS top, max(d) AS d FROM e GROUP BY 1),
n AS (SELECT *, CASE WHEN d IS NULL THEN CASE WHEN top > 7200 THEN 'ms' WHEN top > 3600 THEN 'ambiguous' ELSE 'sec' END WHEN top <= d * 1.2 + 5 THEN 'sec' WHEN top / 1000 <= d * 1.2 + 5 THEN CASE WHEN top / 1000 >= d * 0.25 THEN 'ms' ELSE 'sec' END ELSE 'invalid' END AS unit FROM u),
s AS (SELECT user_id, event_id, CASE WHEN unit = 'ms' THEN t / 1000 ELSE t END AS t, n.d, unit FROM e JOIN n USING (user_id)),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM s)
SELECT user_id, unit, bool_and(prev IS NULL OR t >= prev - 0.001) AND unit IN ('sec', 'ms') AND (max(d) IS NULL OR min(t) >= -2 AND max(t) <= max(d) + 2) AS clock_valid FROM l GROUP BY user_id, unit
""", with_roles=False)
def w12_clock_check(r: Roles):
    u = F.col("user_id")
    e = r.table("events").where("user_id % 5 <> 1 or event_id % 2 = 0").select("user_id", F.col("event_id").alias("seq"), F.when(u % 3 == 0, F.col("value") * 1000).otherwise(F.col("value")).alias("start_sec"))
    lengths = e.select("user_id").distinct().withColumn("duration_sec", F.when(u % 4 == 1, 10.0).when(u % 4 != 0, 400.0))
    return A.valid_clocks(e, lengths, "user_id").select("user_id", "unit", "clock_valid")


@query("""
SELECT conv_id, count(*) = 4 AS complete, bool_and((prev IS NULL OR s >= prev) AND e > s) AS disjoint
FROM (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY s, e) AS prev FROM (SELECT conv_id, turn * 10 AS s, turn * 10 + length(text) % 14 AS e FROM conversations)) GROUP BY 1
""", with_roles=False)
def w13_interval_check(r: Roles):
    c = r.table("conversations").select("conv_id", (F.col("turn") * 10).alias("s"), (F.col("turn") * 10 + F.length("text") % 14).alias("e"))
    return W.interval_check(c, "conv_id", "s", "e")


@query("""
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY props ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1
UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'error'
""", with_roles=False)
def w14_first_of_key(r: Roles):
    return W.first_of(r.table("events"), F.when(F.col("event_type") != "error", F.col("props")), ["ts", "event_id"]).select("event_id", "user_id")


@query("""
SELECT id, subject_code, row_number() OVER (PARTITION BY subject_code ORDER BY year DESC, id) AS round FROM paper
""")
def w15_round_robin(r: Roles):
    return W.round_robin(r.papers(), "subject_code", [F.desc("year"), F.asc("id")]).select("id", "subject_code", F.col("round").cast("long"))


@query("""
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS min,
  list_sort(list(o_totalprice))[CAST(round_even(0.25 * (count(*) - 1), 0) AS INTEGER) + 1] AS p25,
  list_sort(list(o_totalprice))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INTEGER) + 1] AS p50,
  list_sort(list(o_totalprice))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INTEGER) + 1] AS p90, max(o_totalprice) AS max
FROM orders GROUP BY 1
""", with_roles=False)
def a9_nearest_rank(r: Roles):
    return W.nearest_rank(r.table("orders"), ["o_custkey"], "o_totalprice", {"p25": 0.25, "p50": 0.5, "p90": 0.9})


@query("SELECT c_custkey AS url, 'missing' AS state FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')", with_roles=False)
def so1_missing_resources(r: Roles):
    c = r.table("customer").select(F.col("c_custkey").alias("url"), F.col("c_nationkey").alias("source"))
    seen = r.table("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("url"))
    return G.missing_resources(c, seen, r.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("source"))).select("url", "state")


_BEFORE = "SELECT s_suppkey AS k, s_name AS c, s_nationkey AS q FROM supplier WHERE s_suppkey % 3 <> 0"
_AFTER = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN s_name || '!' ELSE s_name END AS c, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS q FROM supplier WHERE s_suppkey % 4 <> 0"
_DIFF = f"""
SELECT * FROM (SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.q > b.q THEN 'upgraded' WHEN a.c <> b.c OR a.q <> b.q THEN 'changed' END AS change
FROM ({_BEFORE}) b FULL JOIN ({_AFTER}) a ON a.k = b.k) WHERE change IS NOT NULL
"""


def _sides(r: Roles):
    s = r.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("c"), F.col("s_nationkey").alias("q"))
    after = s.where("k % 4 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.concat("c", F.lit("!"))).otherwise(F.col("c")).alias("c"), F.when(F.col("k") % 5 == 0, F.col("q") + 1).otherwise(F.col("q")).alias("q"))
    return s.where("k % 3 <> 0"), after


@query(_DIFF, with_roles=False)
def so2_table_diff(r: Roles):
    return G.table_diff(*_sides(r), "k", "c", "q")


@query(f"SELECT * FROM ({_DIFF}) WHERE change IN ('removed', 'upgraded') AND k % 8 <> 0", with_roles=False)
def so3_unexplained(r: Roles):
    return G.unexplained(G.table_diff(*_sides(r), "k", "c", "q"), r.table("supplier").where("s_suppkey % 8 = 0").select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)", with_roles=False)
def so4_declared_and_indexed(r: Roles):
    return r.table("customer").select(F.col("c_nationkey").alias("k")).intersect(r.table("supplier").select(F.col("s_nationkey").alias("k")))


@query("""
SELECT 'document' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark UNION ALL SELECT 'conversation', conv_id * 1000 + turn, text FROM conversations
""", with_roles=False)
def so7_multi_source_union(r: Roles):
    parts = [r.table("documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"), r.table("benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")]
    return parts[0].unionByName(parts[1]).unionByName(r.table("conversations").select(F.lit("conversation").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
