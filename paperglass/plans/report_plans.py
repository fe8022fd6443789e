"""Reports, governance, coverage and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import answers as A
from paperglass.operators import coverage as C
from paperglass.operators import governance as G
from paperglass.operators import reports as R
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


@query("""
SELECT q.id, coalesce(n, 0) AS child_count, coalesce(t, 0) AS topic_count, q.id IN (SELECT question_id FROM asset) AS has_asset
FROM question q LEFT JOIN (SELECT parent_id, count(*) AS n FROM question WHERE parent_id IS NOT NULL GROUP BY 1) c ON c.parent_id = q.id
LEFT JOIN (SELECT question_id, count(*) AS t FROM link GROUP BY 1) l ON l.question_id = q.id
""")
def a1_question_facts(r: Roles):
    return R.question_facts(r.questions(), r.links(), r.assets())


@query("""
, s AS (SELECT 'question' AS subject_type, count(*) AS total FROM question UNION ALL SELECT 'paper', count(*) FROM paper UNION ALL SELECT 'entry', count(*) FROM entry),
e AS (SELECT CASE WHEN event_type = 'click' THEN 'question' WHEN event_type = 'view' THEN 'paper' ELSE 'other' END AS subject_type, user_id FROM events),
g AS (SELECT subject_type, count(DISTINCT user_id) AS linked, count(*) AS edges FROM e GROUP BY 1)
SELECT subject_type, total, coalesce(linked, 0) AS linked, coalesce(edges, 0) AS edges, round(least(1.0, coalesce(linked, 0) / total), 4) AS ratio FROM s LEFT JOIN g USING (subject_type)
""")
def a2_provenance_coverage(r: Roles):
    kinds = {"question": r.questions(), "paper": r.papers(), "entry": r.entries()}
    subjects = None
    for k, df in kinds.items():
        part = df.select(F.lit(k).alias("subject_type"), "id")
        subjects = part if subjects is None else subjects.unionByName(part)
    kind = F.when(F.col("event_type") == "click", "question").when(F.col("event_type") == "view", "paper").otherwise("other")
    return R.provenance_coverage(subjects, r.table("events").select(kind.alias("subject_type"), F.col("user_id").alias("subject_id")))


@query("""
, d AS (SELECT code, count(DISTINCT question_id) AS direct FROM link GROUP BY 1),
up AS (SELECT n.id, n.id AS a FROM node n UNION ALL SELECT n.id, n.parent_id FROM node n WHERE n.parent_id IS NOT NULL
  UNION ALL SELECT n.id, m.parent_id FROM node n JOIN node m ON m.id = n.parent_id WHERE m.parent_id IS NOT NULL),
s AS (SELECT a AS id, count(DISTINCT question_id) AS subtree FROM up JOIN node n ON n.id = up.id JOIN link l ON l.code = n.code GROUP BY 1)
SELECT n.id, n.code, n.parent_id, coalesce(direct, 0) AS direct, coalesce(subtree, 0) AS subtree FROM node n LEFT JOIN d USING (code) LEFT JOIN s ON s.id = n.id
""")
def a5_topic_tree(r: Roles):
    links = r.links().join(r.nodes().select("code", F.col("id").alias("node_id")), "code")
    return R.topic_tree(r.nodes(), links)


@query("SELECT board, count(*) AS total, count(*) FILTER (level IS NULL) AS without_level, count(*) FILTER (doc_type = 'mark_scheme') AS schemes FROM paper GROUP BY 1")
def a6_board_status(r: Roles):
    return R.counts_by_state(r.papers(), ["board"], {"without_level": F.col("level").isNull(), "schemes": F.col("doc_type") == "mark_scheme"})


@query("SELECT p_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM (SELECT 'x' AS p_type, props FROM events) GROUP BY 1, 2", with_roles=False)
def a8_points_from_json(r: Roles):
    return r.table("events").select(F.lit("x").alias("p_type"), F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("p_type", "k").agg(F.count("*").alias("n"))


@query("""
SELECT paper_id, count(*) AS questions, count(*) FILTER (parent_id IS NULL) AS roots, CAST(max(depth) AS BIGINT) AS max_depth,
  CAST(coalesce(sum(marks) FILTER (parent_id IS NULL), 0) AS BIGINT) AS marks_sum, count(number_path) - count(DISTINCT number_path) AS duplicate_paths,
  coalesce((SELECT count(*) FROM entry e WHERE e.paper_id = q.paper_id), 0) AS mark_scheme_entries,
  coalesce((SELECT count(*) FROM entry e WHERE e.paper_id = q.paper_id AND id % 2 = 0), 0) AS entries_linked,
  coalesce((SELECT count(*) FROM asset a JOIN question x ON x.id = a.question_id WHERE x.paper_id = q.paper_id), 0) AS assets
FROM question q GROUP BY paper_id
""")
def a11_snapshot(r: Roles):
    entries = r.entries().withColumn("question_id", F.when(F.col("id") % 2 == 0, F.col("id")))
    return R.snapshot(r.questions(), entries, r.assets())


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)", with_roles=False)
def a24_entity_counts(r: Roles):
    return r.table("events").rollup("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", with_roles=False)
def a25_repeated_numbers(r: Roles):
    return R.duplicates(r.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
, c AS (SELECT parent_id AS id, CAST(sum(marks) AS BIGINT) AS children, count(*) FILTER (marks IS NULL) AS o FROM question WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT q.id, marks AS declared, children, CASE WHEN o > 0 OR children IS NULL THEN 'ambiguous' WHEN marks IS NULL THEN 'undeclared' WHEN marks = children THEN 'equal' ELSE 'different' END AS status
FROM question q JOIN c ON c.id = q.id
""")
def a26_marks_rollup(r: Roles):
    return R.marks_rollup(r.questions())


@query("SELECT sha256(text) AS sha, list_sort(list(DISTINCT doc_id)) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1", with_roles=False)
def a27_shared_content(r: Roles):
    return R.shared_content(r.table("documents").select(F.sha2("text", 256).alias("sha"), "doc_id"), "sha", "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN count(DISTINCT l_partkey) = 1 THEN 'identical' ELSE 'different' END AS verdict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", with_roles=False)
def a38_native_id_conflicts(r: Roles):
    return R.native_id_conflicts(r.table("lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("SELECT p_name, count(DISTINCT p_brand) AS titles FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) GROUP BY 1 HAVING count(DISTINCT p_brand) > 1", with_roles=False)
def a37_inconsistent_titles(r: Roles):
    p = r.table("part")
    return R.inconsistent_titles(p, "p_name", "p_brand", p.where("p_partkey % 50 = 0"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1", with_roles=False)
def a40_run_statistics(r: Roles):
    return G.run_statistics(r.table("events"), ["user_id"], "event_type", ["click", "error"])


@query("SELECT o_custkey, bool_and(o_totalprice > 1000 AND coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority <> '5-LOW' END, true)) AS complete, count(*) AS units FROM orders GROUP BY 1", with_roles=False)
def a17_all_of(r: Roles):
    return R.all_of(r.table("orders"), ["o_custkey"], [F.col("o_totalprice") > 1000, F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "5-LOW")])


_FINDINGS = """
, finding AS (SELECT 'user' AS subject_type, user_id AS subject_id, 'R' || CAST(event_id % 5 AS VARCHAR) AS rule_code,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status FROM events),
task AS (SELECT event_id AS id, 'user' AS target_type, user_id AS target_id, 'R' || CAST(event_id % 4 AS VARCHAR) AS reason, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'done' END AS status FROM events WHERE event_type = 'signup')
"""


def _findings(r: Roles):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "critical").otherwise("warning")
    return r.table("events").select(F.lit("user").alias("subject_type"), F.col("user_id").alias("subject_id"), F.concat(F.lit("R"), (F.col("event_id") % 5).cast("string")).alias("rule_code"), severity.alias("severity"), F.when(F.col("event_id") % 3 == 0, "closed").otherwise("open").alias("status"))


def _tasks(r: Roles):
    e = r.table("events").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("id"), F.lit("user").alias("target_type"), F.col("user_id").alias("target_id"), F.concat(F.lit("R"), (F.col("event_id") % 4).cast("string")).alias("reason"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("done").alias("status"))


@query(f"""{_FINDINGS}
SELECT DISTINCT subject_type, subject_id, rule_code FROM finding f WHERE severity IN ('error', 'critical')
  AND NOT EXISTS (SELECT 1 FROM task t WHERE t.status = 'open' AND t.target_type = f.subject_type AND t.target_id = f.subject_id AND t.reason = f.rule_code)
""")
def a33_findings_to_tasks(r: Roles):
    return G.findings_to_tasks(_findings(r), _tasks(r))


@query(f"{_FINDINGS} SELECT subject_id, CASE WHEN bool_or(status = 'open' AND severity IN ('error', 'critical')) THEN 'needs_review' ELSE 'parsed' END AS document_status FROM finding GROUP BY 1")
def a34_document_status(r: Roles):
    return G.document_status(_findings(r), "subject_id")


@query(f"""{_FINDINGS}, moved AS (SELECT t.id, target_type, target_id, reason, CASE WHEN id % 6 = 0 THEN 'done' WHEN id % 10 = 0 THEN 'dismissed' ELSE status END AS status FROM task t)
SELECT subject_id, rule_code, severity, CASE WHEN f.status = 'open' AND c IS NOT NULL THEN c ELSE f.status END AS status, count(*) AS n
FROM finding f LEFT JOIN (SELECT target_id, reason, max(CASE status WHEN 'done' THEN 'resolved' ELSE 'ignored' END) AS c FROM moved WHERE status IN ('done', 'dismissed') GROUP BY 1, 2) m
  ON m.target_id = f.subject_id AND m.reason = f.rule_code GROUP BY 1, 2, 3, 4
""")
def g10_resolve_reviews(r: Roles):
    t = _tasks(r)
    decided = F.when(F.col("id") % 6 == 0, "done").when(F.col("id") % 10 == 0, "dismissed").when(F.col("id") % 7 == 0, "nonsense")
    _, closed = G.resolve_reviews(t, t.select(F.col("id").alias("task_id"), decided.alias("status")), _findings(r))
    return closed.groupBy("subject_id", "rule_code", "severity", "status").agg(F.count("*").alias("n"))


@query("""
, rev AS (SELECT o_custkey AS document_id, max_by(o_orderkey, o_orderkey) AS revision_id FROM orders GROUP BY 1)
SELECT DISTINCT 'question' AS subject_type, id AS subject_id, revision_id FROM question JOIN rev ON document_id = paper_id
UNION ALL SELECT DISTINCT 'entry', id, revision_id FROM entry JOIN rev ON document_id = paper_id
""")
def j4_provenance_edges(r: Roles):
    revisions = r.table("orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("revision_no"))
    of = lambda df: df.select("id", F.col("paper_id").alias("document_id"))
    return G.provenance_edges({"question": of(r.questions()), "entry": of(r.entries())}, revisions)


@query("""
, n AS (SELECT 'question' AS subject_type, q.id AS subject_id, p.id * 10 AS revision_id, board FROM question q JOIN paper p ON p.id = q.paper_id)
SELECT * FROM n WHERE board = 'ASIA' UNION ALL SELECT subject_type, subject_id, revision_id - 1, board FROM n WHERE board <> 'ASIA' AND subject_id % 2 = 0
""")
def j4_rebuilt_edges(r: Roles):
    """The edges of one board are new, the others as they were stored."""
    p = r.papers().select(F.col("id").alias("paper_id"), "board")
    new = r.questions().join(p, "paper_id").select(F.lit("question").alias("subject_type"), F.col("id").alias("subject_id"), (F.col("paper_id") * 10).alias("revision_id"), "board")
    old = new.where("subject_id % 2 = 0").withColumn("revision_id", F.col("revision_id") - 1)
    return G.rebuilt_edges(old, new, "ASIA")


@query("SELECT count(*) AS scanned, count(*) FILTER (id IN (SELECT id FROM entry) OR id IN (SELECT question_id FROM official)) AS generated, count(*) FILTER (id NOT IN (SELECT id FROM entry) AND id NOT IN (SELECT question_id FROM official)) AS skipped FROM question")
def a39_explanation_batch(r: Roles):
    return G.explanation_batch(r.questions(), r.entries().withColumn("question_id", F.col("id")), r.official())


@query("SELECT id, status, (status <> 'approved') OR id IN (SELECT event_id FROM events WHERE event_type = 'error') AS requires_review FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'pending' END AS status FROM orders)", with_roles=False)
def f19_generated_view(r: Roles):
    e = r.table("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    tasks = r.table("events").where("event_type = 'error'").select(F.col("event_id").alias("target_id"), F.lit("open").alias("status"), F.lit("stale_source").alias("reason"))
    return G.generated_view(e, tasks)


@query("SELECT c_mktsegment AS system, count(*) AS total, count(*) FILTER (c_custkey % 4 = 0) AS complete, count(*) FILTER (c_custkey % 4 = 1) AS partial, count(*) FILTER (c_custkey % 4 = 2) AS missing, count(*) FILTER (c_custkey % 4 = 3) AS unknown FROM customer GROUP BY 1", with_roles=False)
def a23_system_coverage(r: Roles):
    s = F.element_at(F.array(*[F.lit(x) for x in ("complete", "partial", "missing", "unknown")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return C.system_coverage(r.table("customer").select(F.col("c_mktsegment").alias("system"), s.alias("status")))


@query("""
, f AS (SELECT user_id, regr_slope(value, event_id) AS slope, regr_intercept(value, event_id) AS "offset", count(*) AS n FROM events GROUP BY 1)
SELECT user_id, round(slope, 9) AS slope, n, coalesce(max(abs(value - slope * event_id - "offset")) <= 120 AND slope BETWEEN -0.0005 AND 0.0005, false) AS valid
FROM events JOIN f USING (user_id) GROUP BY user_id, slope, n
""")
def x28_clock_fit(r: Roles):
    e = r.table("events").select("user_id", F.col("event_id").cast("double").alias("event_id"), "value")
    return A.clock_fit(e, ["user_id"], "event_id", "value", 120, (-0.0005, 0.0005)).select("user_id", F.round("slope", 9).alias("slope"), "n", "valid")
