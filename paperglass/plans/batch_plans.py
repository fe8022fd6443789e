"""Batch and pipeline reports, upserts, crawl merges, coverage of manifests, topic overviews and paged listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import batches as B
from paperglass.operators import coverage as C
from paperglass.operators import listings as L
from paperglass.operators import relations as J
from paperglass.operators import reports as R
from paperglass.operators import tagging as T
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


def _pick(column: str, values: list):
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(F.col(column) % len(values) == k, F.lit(v)).otherwise(out)
    return out


_STAGES = ["discovered", "downloaded", "validation_partial", "imported_verified", "cleaned", "blocked"]


@query(f"""
WITH s AS (SELECT c_custkey AS code, CASE c_custkey % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'subject_unavailable' ELSE 'open' END AS status, c_custkey % 7 AS cells_total, c_custkey % 4 = 0 AS declared FROM customer),
c AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'no_resources' WHEN 2 THEN 'subject_unavailable_inferred' ELSE 'http_error' END AS status, o_orderkey % 4 <> 2 AS requested FROM orders WHERE o_orderkey % 5 = 0),
p AS (SELECT p_partkey, {_STAGES}[1 + p_partkey % 6] AS stage, CASE WHEN p_size % 2 = 0 THEN 'paired' ELSE 'qp_only' END AS kind FROM part),
v AS (SELECT l_orderkey AS key, l_linenumber AS question, l_quantity > 30 AS issue FROM lineitem),
k AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'cleaned' WHEN event_id % 5 = 1 THEN 'cleanup_pending' WHEN event_id % 5 = 2 THEN 'cleanup_failed' ELSE 'scratch_sweep' END AS stage, user_id AS key, event_id % 3 AS deleted, event_id % 100 AS freed FROM events),
i AS (SELECT DISTINCT s_suppkey * 2 AS code FROM supplier)
SELECT section, name, CAST(value AS BIGINT) AS value FROM (SELECT 'cells' AS section, 'requested' AS name, count(*) FILTER (requested) AS value FROM c UNION ALL SELECT 'cells', 'inferred', count(*) FILTER (NOT requested) FROM c
UNION ALL SELECT 'cells', 'unqueried', greatest((SELECT sum(cells_total) FROM s) - (SELECT count(*) FROM c), 0) UNION ALL SELECT 'cells', 'not_fully_scanned', count(*) FROM s WHERE status = 'open'
UNION ALL SELECT 'cell_status', status, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'stage', stage, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'papers', 'downloaded', count(*) FROM p WHERE stage IN ('downloaded', 'validation_partial', 'imported_verified', 'cleaned') UNION ALL SELECT 'papers', 'not_cleaned', count(*) FROM p WHERE stage <> 'cleaned'
UNION ALL SELECT 'verification', 'questions_covered', (SELECT count(*) FROM (SELECT DISTINCT key, question FROM v)) UNION ALL SELECT 'verification', 'records_with_issues', count(*) FROM v WHERE issue
UNION ALL SELECT 'cleanup', 'cleaned_papers', count(DISTINCT key) FROM k WHERE stage = 'cleaned' UNION ALL SELECT 'cleanup', 'freed_bytes', sum(freed) FROM k WHERE stage = 'cleaned'
UNION ALL SELECT 'cleanup', 'sweep_files', sum(deleted) FROM k WHERE stage = 'scratch_sweep' UNION ALL SELECT 'cleanup', 'total_freed_bytes', sum(freed) FROM k WHERE stage IN ('cleaned', 'scratch_sweep')
UNION ALL SELECT 'coverage', 'declared_with_index', count(*) FROM s WHERE declared AND code IN (SELECT code FROM i) UNION ALL SELECT 'coverage', 'declared_without_index', count(*) FROM s WHERE declared AND code NOT IN (SELECT code FROM i)
UNION ALL SELECT 'coverage', 'subjects_with_index', count(*) FROM i UNION ALL SELECT 'coverage', 'subjects_without_index', count(*) FROM s WHERE code NOT IN (SELECT code FROM i)
UNION ALL SELECT 'errors', 'download_errors', count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 0 UNION ALL SELECT 'error_kind', CASE WHEN event_id % 2 = 0 THEN 'download_failed' ELSE 'unclassified' END, count(*) FROM events WHERE event_type = 'error' GROUP BY 2)
""", with_roles=False)
def a14_batch_summary(r: Roles):
    k, e = F.col("c_custkey"), F.col("event_id")
    subjects = r.table("customer").select(k.alias("code"), _pick("c_custkey", ["scanned", "subject_unavailable", "open"]).alias("status"), (k % 7).alias("cells_total"), (k % 4 == 0).alias("declared"))
    cells = r.table("orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key"), _pick("o_orderkey", ["complete", "no_resources", "subject_unavailable_inferred", "http_error"]).alias("status"), (F.col("o_orderkey") % 4 != 2).alias("requested"))
    papers = _batch_papers(r)
    checks = r.table("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("question"), F.lit("qp").alias("role"), F.when(F.col("l_quantity") > 30, 2).alias("issues"))
    stage = F.when(e % 2 == 0, "cleaned").when(e % 5 == 1, "cleanup_pending").when(e % 5 == 2, "cleanup_failed").otherwise("scratch_sweep")
    cleanup = r.table("events").select(F.col("user_id").alias("key"), stage.alias("stage"), (e % 3).alias("deleted"), (e % 100).alias("freed_bytes"))
    errors = r.table("events").where("event_type = 'error'").select(F.when(e % 2 == 0, "download_failed").alias("kind"), F.lit(None).cast("string").alias("stage"))
    found = B.batch_summary(subjects, cells, papers, checks, cleanup, errors, r.table("supplier").select((F.col("s_suppkey") * 2).alias("subject")))
    shown = ("requested", "inferred", "unqueried", "not_fully_scanned", "downloaded", "not_cleaned", "questions_covered", "records_with_issues", "cleaned_papers", "freed_bytes", "sweep_files", "total_freed_bytes", "declared_with_index", "declared_without_index", "subjects_with_index", "subjects_without_index", "download_errors")
    return found.where(F.col("name").isin(*shown) | F.col("section").isin("cell_status", "kind", "error_kind") | (F.col("section") == "stage")).where("not (section = 'stage' and name in ('requested'))")


def _batch_papers(r: Roles):
    return r.table("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("subject"), _pick("p_partkey", _STAGES).alias("stage"), F.when(F.col("p_size") % 2 == 0, "paired").otherwise("qp_only").alias("kind"))


@query("SELECT p_brand AS subject, " + ", ".join(f"count(*) FILTER (p_partkey % 6 = {k}) AS {s}" for k, s in enumerate(_STAGES)) + " FROM part GROUP BY 1", with_roles=False)
def a14_stages_by_subject(r: Roles):
    return B.stages_by_subject(_batch_papers(r), _STAGES)


@query("""
, d AS (SELECT id, subject_code AS code, doc_type, id % 4 <> 0 AS have FROM paper), pp AS (SELECT paper_id, d.code FROM (SELECT DISTINCT paper_id FROM question) x JOIN d ON d.id = x.paper_id),
q AS (SELECT q.id, pp.code, marks FROM question q JOIN pp USING (paper_id)), f AS (SELECT d.code, count(*) AS n FROM d WHERE id % 5 = 2 GROUP BY 1)
SELECT d.code, count(*) FILTER (doc_type = 'question_paper') AS question_papers, count(*) FILTER (doc_type = 'mark_scheme' AND have) AS mark_schemes_downloaded, coalesce((SELECT count(*) FROM pp WHERE pp.code = d.code), 0) AS papers,
  coalesce((SELECT count(*) FROM q WHERE q.code = d.code), 0) AS questions, coalesce((SELECT count(marks) FROM q WHERE q.code = d.code), 0) AS questions_with_marks, coalesce((SELECT count(*) FROM q WHERE q.code = d.code AND q.id % 3 = 0), 0) AS questions_with_ms_regions,
  coalesce((SELECT count(DISTINCT question_id) FROM link JOIN q ON q.id = link.question_id WHERE q.code = d.code), 0) AS questions_tagged, coalesce((SELECT count(*) FROM link JOIN q ON q.id = link.question_id WHERE q.code = d.code), 0) AS taxonomy_assignments,
  count(*) FILTER (doc_type = 'mark_scheme' AND id % 2 = 0) AS mark_schemes_matched, coalesce((SELECT n FROM f WHERE f.code = d.code), 0) AS split_failures, count(*) FILTER (id % 6 = 0) AS points, count(*) FILTER (id % 8 = 1) AS gated,
  (list('e' || id ORDER BY id) FILTER (id % 5 = 2))[1:10] AS split_failure_reasons
FROM d GROUP BY d.code
""")
def a7_subject_report(r: Roles):
    p, k = r.papers(), F.col("id")
    q = r.questions()
    docs = p.select("id", F.col("subject_code").alias("subject"), "doc_type", F.when(k % 4 != 0, k).alias("current_revision_id"))
    papers = q.select(F.col("paper_id").alias("id")).distinct().withColumn("document_id", k)
    questions = q.select("id", "paper_id", "marks", F.when(k % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("ms_regions"))
    schemes = p.where("doc_type = 'mark_scheme'").select(k.alias("document_id"), F.when(k % 2 == 0, k).alias("matched_paper_document_id"))
    runs = p.select(k.alias("document_id"), F.lit("v2").alias("parser_version"), F.when(k % 5 == 2, "failed").otherwise("completed").alias("status"), F.concat(F.lit("e"), k.cast("string")).alias("error"), "id")
    runs = runs.unionByName(runs.withColumn("parser_version", F.lit("v1")).withColumn("status", F.lit("failed")))
    points = p.where("id % 6 = 0").select(F.to_json(F.struct(F.col("subject_code").alias("subject"))).alias("attrs"))
    resources = p.select(F.col("subject_code").alias("subject"), (k % 8 == 1).alias("is_gated"))
    found = B.subject_report(p.select(F.col("subject_code").alias("code")), docs, papers, questions, r.links(), schemes, runs, points, resources, "v2")
    return found.drop("mark_schemes", "question_papers_downloaded", "resources").select("code", *[c for c in found.columns if c not in ("code", "mark_schemes", "question_papers_downloaded", "resources")])


@query("""
WITH n AS (SELECT p_brand AS code, CAST(NULL AS VARCHAR) AS parent, p_brand AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 UNION ALL SELECT p_brand || '/' || p_partkey, p_brand, p_name FROM part WHERE p_partkey % 2 = 0),
o AS (SELECT p_brand AS code, CAST(NULL AS VARCHAR) AS parent, p_brand AS name, 'official' AS source FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 UNION ALL SELECT p_brand || '/' || p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'old' END, 'seed' FROM part WHERE p_partkey % 3 = 0)
SELECT action, count(*) AS nodes FROM (SELECT CASE WHEN n.code IS NULL THEN 'kept' WHEN o.code IS NULL THEN 'created' WHEN o.name = n.name AND o.source = 'official' THEN 'same' ELSE 'updated' END AS action FROM n FULL JOIN o ON o.code = n.code) GROUP BY 1
""", with_roles=False)
def s13_specification_upsert(r: Roles):
    def tree(rows, name):
        units = rows.select(F.col("p_brand").alias("code"), F.lit(None).cast("string").alias("parent_code"), F.col("p_brand").alias("name"), F.lit("unit").alias("node_type"), F.lit(1).alias("depth")).distinct()
        return units.unionByName(rows.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("code"), F.col("p_brand").alias("parent_code"), name.alias("name"), F.lit("point").alias("node_type"), F.lit(2).alias("depth")))

    p = r.table("part")
    old = tree(p.where("p_partkey % 3 = 0"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise("old")).withColumn("source", F.when(F.col("depth") == 1, "official").otherwise("seed"))
    return B.upsert_specification(old, tree(p.where("p_partkey % 2 = 0"), F.col("p_name")))[1]


@query("""
WITH o AS (SELECT user_id AS url, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_id % 3 = 0 GROUP BY 1), d AS (SELECT user_id AS url, max_by(event_type, (ts, event_type)) AS label, max(ts) AS seen_at FROM events WHERE event_id % 7 = 1 GROUP BY 1)
SELECT coalesce(o.url, d.url) AS url, coalesce(label, 'old') AS label, CASE WHEN d.url IS NOT NULL AND o.url IS NOT NULL THEN 'seen' WHEN d.url IS NOT NULL THEN 'new' ELSE 'missing' END AS state, coalesce(first_seen, seen_at) AS first_seen, greatest(coalesce(last_seen, seen_at), coalesce(seen_at, last_seen)) AS last_seen
FROM o FULL JOIN d ON d.url = o.url
""", with_roles=False)
def s14_merge_candidates(r: Roles):
    e = r.table("events")
    old = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("url")).agg(F.lit("old").alias("label"), F.lit("missing").alias("state"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return B.upsert_candidates(old, e.where("event_id % 7 = 1").select(F.col("user_id").alias("url"), F.col("event_type").alias("label"), F.col("ts").alias("seen_at")))


def _crawl(r: Roles):
    from paperglass.streaming.crawl import classify

    e, k = r.table("events"), F.col("event_id") % 11
    half = "timestamp '2024-01-15'"
    rows = e.select(F.col("user_id").alias("url"), (F.col("user_id") % 6).alias("source"), F.when(k == 0, "error").when(k == 1, "gated").when(k == 2, "listed").otherwise("fetched").alias("status"), F.col("event_type").alias("sha256"), F.col("event_id").alias("bytes"), F.col("ts").alias("seen_at"))
    old = rows.where(f"seen_at < {half} and url % 5 <> 0").groupBy("url", "source").agg(F.max_by("sha256", F.struct("seen_at", "bytes")).alias("sha256"), (F.count("*") % 3).cast("int").alias("revision_no"), F.lit("seen").alias("status"), F.max("seen_at").alias("seen_at"))
    done = rows.where("source <> 1").select("source").distinct()
    return classify(rows.where(f"seen_at >= {half} and url % 4 <> 0").withColumn("status", F.max_by("status", F.struct("seen_at", "bytes")).over(_by_url())), old, done)


def _by_url():
    from pyspark.sql import Window

    return Window.partitionBy("url")


_CRAWL = """
WITH e AS (SELECT user_id AS url, user_id % 6 AS source, event_id, CASE event_id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'gated' WHEN 2 THEN 'listed' ELSE 'fetched' END AS status, event_type AS sha, ts FROM events),
o AS (SELECT url, source, max_by(sha, (ts, event_id)) AS sha, CAST(count(*) % 3 AS INTEGER) AS no FROM e WHERE ts < TIMESTAMP '2024-01-15' AND url % 5 <> 0 GROUP BY 1, 2),
b AS (SELECT url, max_by(status, (ts, event_id)) AS status, max(ts) AS t FROM e WHERE ts >= TIMESTAMP '2024-01-15' AND url % 4 <> 0 GROUP BY 1),
l AS (SELECT b.url, b.status, max_by(e.sha, (e.ts, e.sha)) AS sha FROM b JOIN e ON e.url = b.url AND e.ts = b.t AND e.ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2),
m AS (SELECT l.url, CASE WHEN status = 'gated' THEN 'skipped' WHEN status = 'error' THEN 'error' WHEN status = 'listed' THEN CASE WHEN o.url IS NULL THEN 'new' ELSE 'seen' END WHEN coalesce(no, 0) = 0 THEN 'new' WHEN l.sha = o.sha THEN 'unchanged' ELSE 'changed' END AS action, status, coalesce(no, 0) AS no FROM l LEFT JOIN o USING (url)
  UNION ALL SELECT url, 'missing', 'none', no FROM o WHERE source <> 1 AND url NOT IN (SELECT url FROM l))
"""


@query(_CRAWL + "SELECT url, action, CAST(CASE WHEN status = 'fetched' AND action IN ('new', 'changed') THEN no + 1 ELSE no END AS INTEGER) AS revision_no FROM m", with_roles=False)
def st1_crawl_merge(r: Roles):
    return _crawl(r).select("url", "action", "revision_no")


@query(_CRAWL + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in ("new", "seen", "unchanged", "changed", "missing", "skipped", "error")) + ", count(*) FILTER (status = 'fetched' AND action IN ('new', 'changed')) AS new_revisions FROM m", with_roles=False)
def st1_run_counters(r: Roles):
    from paperglass.streaming.crawl import run_counters

    return run_counters(_crawl(r)).drop("bytes")


@query("""
WITH o AS (SELECT user_id AS scope, date_trunc('day', ts) AS d, event_type AS t, ts FROM events), n AS (SELECT scope, max(d) AS d FROM o GROUP BY 1),
p AS (SELECT scope, count(DISTINCT CASE t WHEN 'view' THEN 'complete' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'stopped' ELSE 'other' END) AS kinds, max_by(t, (ts, CASE t WHEN 'view' THEN 'complete' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'stopped' ELSE 'other' END)) AS t FROM o JOIN n USING (scope, d) GROUP BY 1)
SELECT scope, CASE t WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'stopped_requires_resume' ELSE 'unknown' END AS stage, CASE WHEN kinds > 1 THEN 'conflict' ELSE 'current' END AS freshness FROM p
""", with_roles=False)
def a32_job_stages(r: Roles):
    from paperglass.streaming.crawl import job_stages, latest_checkpoints, newest

    t = F.col("event_type")
    payload = F.when(t == "view", '{"state":"complete"}').when(t == "click", '{"state":"in_progress","loop_stage":"queued"}').when(t == "error", '{"state":"stopped","resume":{"needs_user_resume":true}}').otherwise('{"state":"other"}')
    o = r.table("events").select(F.col("user_id").alias("scope"), F.date_trunc("day", "ts").alias("native_at"), F.col("ts").alias("observed_at"), payload.alias("payload"))
    return job_stages(newest(latest_checkpoints(o)))


_ENTRY = "SELECT c_custkey % 400 AS public_id, 'S' || CAST(c_custkey % 400 % 5 AS VARCHAR) AS system, CASE WHEN c_custkey % 400 % 2 = 0 THEN 'paper' ELSE 'audio' END AS kind, CASE WHEN c_custkey % 400 % 50 = 3 THEN c_custkey ELSE 1 END AS content, ['verified', 'verified', 'partial', 'verified', 'none', 'verified'][1 + c_custkey % 400 % 6] AS quality, c_custkey % 400 % 37 <> 5 AS known, c_custkey % 400 % 91 <> 7 AS claim FROM customer"


@query(f"""
WITH e AS ({_ENTRY}), u AS (SELECT public_id, system, kind, any_value(quality) AS quality, bool_and(known) AS known, bool_and(claim) AS claim, count(*) AS copies, count(DISTINCT content) AS contents FROM e GROUP BY 1, 2, 3),
s AS (SELECT system || ':' || kind AS id, system, kind, n, CASE n % 3 WHEN 0 THEN NULL WHEN 1 THEN n ELSE n + 2 END AS expected FROM (SELECT system, kind, count(*) AS n FROM u GROUP BY 1, 2)),
b AS (SELECT s.id, s.expected, u.*, CASE WHEN public_id % 23 = 4 THEN 'excluded' WHEN public_id % 29 = 6 THEN 'partial' WHEN NOT known THEN 'unknown' WHEN quality = 'verified' THEN 'verified' WHEN quality = 'partial' THEN 'partial' ELSE 'unknown' END AS bucket FROM s JOIN u USING (system, kind)),
c AS (SELECT id, any_value(expected) AS expected, count(*) FILTER (bucket = 'excluded') AS excluded, count(*) FILTER (bucket = 'unknown') AS unknown, count(*) FILTER (bucket = 'partial') AS partial, count(*) FILTER (bucket = 'verified') AS verified, count(*) AS observed,
  bool_or(NOT known) AS p_id, bool_or(NOT claim) AS p_claim, bool_or(copies > 1 AND contents > 1) AS p_dup, bool_or(copies > 1 AND contents = 1) AS p_same FROM b GROUP BY id),
p AS (SELECT *, id = 'S0:paper' AS p_lost, id = 'S1:audio' AS p_wrong FROM c),
k AS (SELECT *, list_sort(list_filter([CASE WHEN p_id THEN 'identity_unresolved' END, CASE WHEN p_claim THEN 'quality_claim_invalid' END, CASE WHEN p_dup THEN 'duplicate_public_id' END, CASE WHEN p_same THEN 'duplicate_public_id_identical' END, CASE WHEN p_lost THEN 'manifest_id_not_published' END, CASE WHEN p_wrong THEN 'manifest_id_wrong_scope' END], lambda x: x IS NOT NULL)) AS problems,
  p_claim OR p_dup OR p_lost OR p_wrong AS conflict FROM p)
SELECT id, expected, excluded, unknown, partial, verified, observed, CASE WHEN expected IS NOT NULL THEN greatest(expected - observed, 0) END AS unmet, problems,
  CASE WHEN expected IS NULL THEN 'unknown' WHEN conflict THEN 'conflict' WHEN expected <= excluded OR observed < expected OR unknown > 0 OR partial > 0 OR verified <> expected - excluded THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN expected IS NOT NULL AND NOT conflict AND expected > excluded THEN round(100.0 * verified / (expected - excluded), 2) END AS percentage FROM k
""", with_roles=False)
def a21_published_coverage(r: Roles):
    """Ids with copies that differ or not, unresolved identities, invalid claims, and references that lead nowhere or elsewhere."""
    k = F.col("c_custkey") % 400
    ids = r.table("customer").withColumn("k", k)
    quality = _pick("k", ["verified", "verified", "partial", "verified", "none", "verified"])
    entries = ids.select(
        F.col("k").cast("string").alias("public_id"), F.concat(F.lit("S"), (F.col("k") % 5).cast("string")).alias("system"), F.when(F.col("k") % 2 == 0, "paper").otherwise("audio").alias("kind"), F.when(F.col("k") % 50 == 3, F.col("c_custkey")).otherwise(1).alias("content"),
        quality.alias("quality"), (F.col("k") % 37 != 5).alias("identity_ok"), (F.col("k") % 91 != 7).alias("claim_ok"),
    )
    n, one = F.col("n"), entries.select("public_id", "system", "kind").distinct()
    listed = lambda d, m: F.coalesce(F.collect_list(F.when(F.col("public_id").cast("int") % d == m, F.col("public_id"))), F.array().cast("array<string>"))
    scopes = one.groupBy("system", "kind").agg(F.count("*").alias("n"), listed(23, 4).alias("exclusions"), F.array_sort(listed(29, 6)).alias("halved"))
    scopes = scopes.withColumn("id", F.concat_ws(":", "system", "kind"))
    halved = F.filter("halved", lambda x: ~F.array_contains("exclusions", x))
    lost = F.when(F.col("id") == "S0:paper", F.array(F.lit("nowhere"))).when(F.col("id") == "S1:audio", F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))
    scopes = scopes.select("id", "system", "kind", F.when(n % 3 == 1, n).when(n % 3 == 2, n + 2).alias("expected"), "exclusions", F.concat(halved, lost).alias("partial"))
    return C.published_coverage(entries, scopes).drop("overfilled")


@query("""
, b AS (SELECT id, code, parent_id, CASE WHEN id IN (3, 9, 12) THEN 'y' ELSE 'x' END AS board, CASE id WHEN 0 THEN 's0' WHEN 1 THEN 's1' END AS subject FROM node), o AS (SELECT * FROM b WHERE board = 'x'),
up AS (SELECT id, id AS a, 0 AS d FROM o UNION ALL SELECT n.id, m.id, 1 FROM o n JOIN o m ON m.id = n.parent_id UNION ALL SELECT n.id, k.id, 2 FROM o n JOIN o m ON m.id = n.parent_id JOIN o k ON k.id = m.parent_id),
s AS (SELECT up.id, min_by(subject, d) AS subject FROM up JOIN o ON o.id = up.a WHERE subject IS NOT NULL GROUP BY 1),
l AS (SELECT question_id, id FROM link JOIN o USING (code) WHERE question_id % 3 = 0 AND id <> 4),
t AS (SELECT a AS id, count(DISTINCT question_id) AS subtree FROM up JOIN l ON l.id = up.id GROUP BY 1)
SELECT o.id, o.code, coalesce((SELECT count(DISTINCT question_id) FROM l WHERE l.id = o.id), 0) AS direct, subtree FROM o JOIN s USING (id) JOIN t USING (id) WHERE s.subject = 's1'
""")
def a5_tag_overview(r: Roles):
    k = F.col("id")
    nodes = r.nodes().withColumn("board", F.when(k.isin(3, 9, 12), "y").otherwise("x")).withColumn("subject", F.when(k == 0, "s0").when(k == 1, "s1"))
    links = r.links().where("question_id % 3 = 0").join(r.nodes().select("code", F.col("id").alias("node_id")), "code").where("node_id <> 4")
    return R.tag_overview(nodes, links, "x", "s1", include_zero=False).select("id", "code", "direct", "subtree")


@query("""
, d AS (SELECT code, count(DISTINCT question_id) AS direct FROM link GROUP BY 1)
SELECT n.code AS first, m.code AS second, k.code AS third, d.direct FROM node n JOIN node m ON m.parent_id = n.id JOIN node k ON k.parent_id = m.id JOIN d ON d.code = k.code WHERE n.parent_id IS NULL
""")
def a4_nested_topics(r: Roles):
    links = r.links().join(r.nodes().select("code", F.col("id").alias("node_id")), "code")
    tree = R.nested_topics(R.topic_tree(r.nodes(), links), 3)
    second = tree.select(F.col("tree.code").alias("first"), F.explode("tree.children").alias("b"))
    return second.select("first", F.col("b.code").alias("second"), F.explode("b.children").alias("c")).select("first", "second", F.col("c.code").alias("third"), F.col("c.direct").alias("direct"))


@query("""
, m AS (SELECT DISTINCT question_id FROM link WHERE source = 'manual' AND question_id % 4 = 1), f AS (SELECT DISTINCT question_id FROM link WHERE source = 'auto' AND question_id % 6 = 0),
c AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'T99' ELSE 'T1' END AS key FROM question WHERE id % 2 = 0 OR id % 4 = 1),
o AS (SELECT id, CASE WHEN id IN (SELECT question_id FROM m) THEN 'skipped_manual' WHEN id IN (SELECT question_id FROM f) THEN 'frozen_reviewed' WHEN key = 'T99' THEN 'unknown_topic' ELSE 'assigned' END AS outcome FROM c)
SELECT outcome, count(DISTINCT id) AS questions, count(*) AS rows FROM o GROUP BY 1
""")
def g2_assignment_rules(r: Roles):
    k = F.col("question_id")
    existing = r.links().where("(source = 'manual' and question_id % 4 = 1) or source = 'auto'").select("question_id", "code", "source", "confidence", ((F.col("source") == "auto") & (k % 6 == 0)).alias("reviewed"))
    candidates = r.questions().where("id % 2 = 0 or id % 4 = 1").select("id", F.when(F.col("id") % 10 == 0, "T99").otherwise("T1").alias("key"), F.lit(0.5).alias("confidence"))
    return T.assign_topics(candidates, existing, r.nodes().select("code"))[1]


@query("""
SELECT id, code, max(confidence) AS confidence FROM (SELECT question_id AS id, code, confidence FROM link WHERE source = 'auto' UNION ALL SELECT question_id, m.code, round(confidence * 0.9, 4) FROM link l JOIN node n USING (code) JOIN node m ON m.id = n.parent_id WHERE source = 'auto') GROUP BY 1, 2
""")
def g3_parent_topics(r: Roles):
    nodes = r.nodes()
    parents = nodes.join(nodes.select(F.col("id").alias("parent_id"), F.col("code").alias("parent_code")), "parent_id", "left").select("code", "parent_code")
    return T.with_parents(r.links().where("source = 'auto'").select(F.col("question_id").alias("id"), "code", "confidence"), parents)


@query("""
, x AS (SELECT parent_id AS id, sum(marks) AS s, bool_or(marks IS NULL) AS d FROM question WHERE parent_id IS NOT NULL GROUP BY 1),
r AS (SELECT paper_id, coalesce(marks, s) AS v, CASE WHEN x.id IS NULL THEN marks IS NULL ELSE d OR (marks IS NOT NULL AND marks <> s) END AS doubt FROM question q LEFT JOIN x ON x.id = q.id WHERE parent_id IS NULL AND q.id % 44 < 12),
t AS (SELECT paper_id, CAST(sum(v) AS BIGINT) AS total, bool_or(doubt) AS doubt FROM r GROUP BY 1)
SELECT paper_id, CASE WHEN NOT doubt THEN total END AS total, CASE WHEN doubt THEN 'ambiguous' WHEN paper_id % 3 = 0 THEN 'undeclared' WHEN paper_id % 20 = total THEN 'equal' ELSE 'different' END AS status FROM t
""")
def a26_paper_totals(r: Roles):
    q = r.questions().where("(id - coalesce(id - parent_id, 0)) % 44 < 12")
    declared = q.select("paper_id").distinct().where("paper_id % 3 <> 0").withColumn("declared", F.col("paper_id") % 20)
    return R.paper_totals(q, declared).select("paper_id", "total", "status")


@query("SELECT o_orderkey AS event, total FROM (SELECT *, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE starts_with(c_mktsegment, 'MACH') AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') ORDER BY o_orderdate, c_mktsegment, o_orderkey LIMIT 25 OFFSET 10", with_roles=False)
def f21_timetable_events(r: Roles):
    e = r.table("orders").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").alias("date"), F.col("c_mktsegment").alias("subject_code"), F.col("o_orderstatus").alias("session"), F.col("o_orderpriority").alias("level"))
    return L.timetable_page(e, 25, 10, subject="MACH", session="F", level="1-URGENT").select("event", "total")


@query("SELECT o_orderkey AS component, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR o_orderkey % 4 <> 1)", with_roles=False)
def f22_date_windows(r: Roles):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    w = r.table("orders").select(F.col("o_orderpriority").alias("board"), F.col("o_orderstatus").alias("season"), k.alias("component"), F.when(k % 3 != 0, day).alias("start"), F.date_add(day, F.when(k % 4 == 1, -1).otherwise(3)).alias("end"))
    return L.date_windows(w, "2-HIGH", "O").select("component", F.date_format("start", "yyyy-MM-dd").alias("start"))


@query("SELECT o_orderkey AS id, total FROM (SELECT *, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P') ORDER BY o_orderkey LIMIT 20 OFFSET 3", with_roles=False)
def f18_explanation_queue(r: Roles):
    e = r.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("review_status"))
    return L.explanation_queue(e, "P", 20, 3).select("id", "total")


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'PROMO' AND p_size % 2 = 0 AND p_size <= 25 ORDER BY p_partkey LIMIT 15 OFFSET 3", with_roles=False)
def f27_practice_list(r: Roles):
    p = r.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("section"), F.col("p_size").alias("batch"), (F.col("p_size") % 2 == 0).alias("free"), (F.col("p_size") > 25).alias("locked"))
    return L.practice_list(p, 15, 3, section="PROMO", free=True, locked=False).select("id")


@query("SELECT event_id AS id, event_type AS source_kind FROM events WHERE user_id = 9 AND event_type <> 'click' ORDER BY event_id", with_roles=False)
def f31_trace_sources(r: Roles):
    edges = r.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "paper").otherwise("question").alias("subject_type"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("source_kind"))
    return L.trace_sources(edges, "question", 9).select("id", "source_kind")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT c_nationkey AS \"set\", '{n}' AS source, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in _SEGMENTS) + f", count(*) AS total FROM customer WHERE c_custkey % 3 = {k} GROUP BY 1" for k, n in enumerate(("local", "search", "practice"))) + ")", with_roles=False)
def a31_items_by_set(r: Roles):
    c = r.table("customer").select(F.col("c_nationkey").alias("set"), F.col("c_mktsegment").alias("section"), "c_custkey")
    return L.set_counts({n: c.where(f"c_custkey % 3 = {k}") for k, n in enumerate(("local", "search", "practice"))}, _SEGMENTS)


_YEARS = list(range(2015, 2025))


@query("SELECT region, " + ", ".join(f"count(*) FILTER (year = {y}) AS \"{y}\"" for y in _YEARS) + ", count(*) AS total FROM (SELECT year, unnest(list_distinct([board, qualification])) AS region FROM paper) GROUP BY 1")
def a15_region_by_year(r: Roles):
    """Papers of a country count for it and for the part of the world that it lies in."""
    return L.regions_by_year(r.papers().withColumn("regions", F.array("board", "qualification", "board")), "regions", _YEARS)


_RESOLVED = """
, good AS (SELECT paper_id, number_path, min_by(text, id) AS text FROM entry WHERE trim(text) <> '' GROUP BY 1, 2),
own AS (SELECT q.id, q.paper_id, q.number_path, coalesce(o.content, g.text) AS own FROM question q LEFT JOIN good g USING (paper_id, number_path) LEFT JOIN official o ON o.question_id = q.id),
up AS (SELECT o.id, g.number_path AS path, g.text FROM own o JOIN good g ON g.paper_id = o.paper_id AND g.number_path = regexp_replace(o.number_path, '\\([^()]*\\)$', '')
  WHERE o.own IS NULL AND contains(o.number_path, '(')),
down AS (SELECT o.id, string_agg(substr(g.number_path, length(o.number_path) + 1) || ' ' || g.text, chr(10) || chr(10) ORDER BY g.number_path) AS below
  FROM own o JOIN good g ON g.paper_id = o.paper_id AND starts_with(g.number_path, o.number_path || '(') WHERE o.own IS NULL GROUP BY 1)
"""


@query(_RESOLVED + """, m AS (SELECT o.id, CASE WHEN own IS NOT NULL THEN 'exact' WHEN up.text IS NOT NULL THEN 'ancestor' WHEN below IS NOT NULL THEN 'descendants' ELSE 'none' END AS mode FROM own o LEFT JOIN up USING (id) LEFT JOIN down USING (id))
SELECT mode, board, subject_code, count(*) AS n FROM m JOIN question q USING (id) JOIN paper p ON p.id = q.paper_id GROUP BY GROUPING SETS ((mode), (board, mode), (subject_code, mode))
""")
def a20_answer_sources(r: Roles):
    """Modes of all answers, by board and by subject."""
    q = r.questions()
    modes = J.resolve_answers(q.select("id", "paper_id", "number_path"), r.entries(), r.official()).select("id", "mode")
    papers = r.papers().select(F.col("id").alias("paper_id"), "board", "subject_code")
    rows = modes.join(q.select("id", "paper_id"), "id").join(papers, "paper_id").select("mode", "board", "subject_code")
    return R.distribution(rows, "mode", [[], ["board"], ["subject_code"]])


@query("""
, d AS (SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'specimen_mark_scheme' ELSE 'mark_scheme' END WHEN id % 4 = 0 THEN 'specimen_paper' ELSE 'question_paper' END AS t, subject_code AS s, year AS y, level AS l, id % 7 <> 3 AS parsed FROM paper),
p AS (SELECT t, s, y, l, count(*) AS n, min(id) AS m FROM d WHERE parsed AND t IN ('question_paper', 'specimen_paper') GROUP BY 1, 2, 3, 4)
SELECT d.id, CASE WHEN n = 1 THEN m END AS paper_document_id FROM d LEFT JOIN p ON p.t = CASE WHEN d.t = 'mark_scheme' THEN 'question_paper' ELSE 'specimen_paper' END AND p.s = d.s AND p.y = d.y AND p.l IS NOT DISTINCT FROM d.l WHERE d.t LIKE '%mark_scheme'
""")
def j5_matching_papers(r: Roles):
    """Schemes with one paper, several or none; papers whose current revision was never completed do not count."""
    k = F.col("id")
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, "specimen_mark_scheme").otherwise("mark_scheme")).otherwise(F.when(k % 4 == 0, "specimen_paper").otherwise("question_paper"))
    none = F.lit(None).cast("string")
    docs = r.papers().select("id", kind.alias("doc_type"), (k * 10).alias("current_revision_id"), F.lit("b").alias("board"), none.alias("qualification"), "subject_code", none.alias("series"), "year", none.alias("component"), none.alias("variant"), "level", none.alias("paper_code"))
    papers = docs.select(k.alias("document_id"), k.alias("parse_run_id"))
    runs = docs.select("id", F.when(k % 14 == 3, k * 10 - 1).otherwise(k * 10).alias("document_revision_id"), F.when(k % 14 == 10, "failed").otherwise("completed").alias("status"))
    return J.matching_papers(docs, papers, runs)


@query("""
, q AS (SELECT id, parent_id, display_order AS position, CASE WHEN id % 3 = 0 THEN 'a' || id END AS answer, [NULL, 'exact', 'ancestor', 'descendants', 'none', 'odd'][1 + id % 6] AS given FROM question),
m AS (SELECT *, CASE WHEN given IS NULL THEN 'ancestor' WHEN given = 'odd' THEN 'none' ELSE given END AS mode FROM q),
k AS (SELECT parent_id AS id, list(answer ORDER BY position) AS parts FROM q WHERE answer IS NOT NULL AND parent_id IS NOT NULL GROUP BY 1),
x AS (SELECT m.*, u.answer AS up, parts FROM m LEFT JOIN q u ON u.id = m.parent_id LEFT JOIN k ON k.id = m.id),
y AS (SELECT *, CASE WHEN answer IS NOT NULL THEN 'exact' WHEN mode = 'ancestor' AND up IS NOT NULL THEN 'ancestor' WHEN mode = 'descendants' AND parts IS NOT NULL THEN 'descendants' ELSE 'none' END AS method FROM x)
SELECT id, mode, method, CASE method WHEN 'exact' THEN id WHEN 'ancestor' THEN parent_id END AS source_id, CASE method WHEN 'exact' THEN [answer] WHEN 'ancestor' THEN [up] WHEN 'descendants' THEN parts END AS answer,
  CASE WHEN given = 'odd' THEN 'unresolved_answer_mode' WHEN method = 'none' AND mode <> 'none' THEN 'missing_answer' END AS problem FROM y
""")
def j11_tree_answers(r: Roles):
    mode = _pick("id", [None, "exact", "ancestor", "descendants", "none", "odd"]).cast("string")
    q = r.questions().select("id", "parent_id", F.col("display_order").alias("position"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), F.col("id").cast("string"))).alias("answer"), mode.alias("answer_mode"))
    return J.tree_answers(q, "ancestor")


@query("SELECT s_suppkey AS target_id, s_suppkey % 3 <> 0 AS active, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN s_name END END AS restored FROM supplier", with_roles=False)
def s15_revert_overrides(r: Roles):
    """Reverted overrides stay, inactive; what they give back may be null."""
    s = r.table("supplier").select(F.lit("question").alias("target_type"), F.col("s_suppkey").alias("target_id"), F.lit("marks").alias("field"), F.lit("9").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("source_value"), F.lit("me").alias("author"), F.lit(True).alias("active"))
    table, back = L.revert_overrides(s, s.where("target_id % 3 = 0"))
    return table.select("target_id", "active").join(back.select("target_id", F.col("value").alias("restored")), "target_id", "left")


_RUNS = """
WITH e AS (SELECT user_id AS url, user_id % 6 AS source, CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS BIGINT) AS run_no, event_id, ts,
  CASE event_id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'gated' WHEN 2 THEN 'listed' ELSE 'fetched' END AS status, event_type AS sha FROM events),
ended AS (SELECT DISTINCT source, run_no FROM e WHERE event_id % 20 = 0),
o AS (SELECT source, run_no, url, max_by((status, sha), (ts, status, sha)) AS r FROM e JOIN ended USING (source, run_no) GROUP BY 1, 2, 3),
p AS (SELECT source, run_no, url, r[1] AS status, CASE WHEN r[1] = 'fetched' THEN r[2] END AS sha FROM o),
f AS (SELECT *, row_number() OVER w > 1 AS known, lead(run_no) OVER w AS next_run, last_value(sha IGNORE NULLS) OVER (PARTITION BY url ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM p WINDOW w AS (PARTITION BY url ORDER BY run_no)),
g AS (SELECT *, CASE WHEN status = 'gated' THEN 'skipped' WHEN status = 'error' THEN 'error' WHEN status = 'listed' THEN CASE WHEN known THEN 'seen' ELSE 'new' END WHEN had IS NULL THEN 'new' WHEN sha = had THEN 'unchanged' ELSE 'changed' END AS action FROM f),
h AS (SELECT *, CAST(count(*) FILTER (status = 'fetched' AND action IN ('new', 'changed')) OVER (PARTITION BY url ORDER BY run_no) AS INTEGER) AS revision_no FROM g),
gone AS (SELECT h.source, min(x.run_no) AS run_no, url, h.revision_no FROM h JOIN ended x ON x.source = h.source AND x.run_no > h.run_no AND x.run_no % 3 <> 0 GROUP BY h.source, url, h.run_no, h.next_run, h.revision_no HAVING min(x.run_no) < coalesce(h.next_run, 1000000)),
a AS (SELECT source, run_no, url, action, revision_no FROM h UNION ALL SELECT source, run_no, url, 'missing', revision_no FROM gone)
"""


def _run_actions(r: Roles):
    """The stream over all events, ended: its rows are what the stream has written."""
    from paperglass.sources.tables import work_folder
    from paperglass.streaming import crawl_runs

    r.spark.conf.set("spark.sql.streaming.stateStore.providerClass", crawl_runs.PROVIDER)
    place, run = work_folder(r.spark), F.datediff(F.to_date("ts"), F.lit("2023-12-31")).cast("long")
    stored = r.table("events")
    rows = r.spark.readStream.schema(stored.schema).parquet(f"{r.dir}/event[s].parquet")  # a pattern: a plain path must be a folder
    k = F.col("event_id") % 11
    source, none = (F.col("user_id") % 6).cast("string").alias("source"), F.lit(None)
    met = F.struct(F.lit("url").alias("kind"), F.col("user_id").cast("string").alias("url"), F.when(k == 0, "error").when(k == 1, "gated").when(k == 2, "listed").otherwise("fetched").alias("status"), F.col("event_type").alias("sha256"), F.lit(10).cast("long").alias("bytes"), F.col("ts").cast("timestamp").alias("at"), none.cast("boolean").alias("complete"))
    over = F.struct(F.lit("end").alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("status"), none.cast("string").alias("sha256"), none.cast("long").alias("bytes"), F.date_add(F.to_date("ts"), 1).cast("timestamp").alias("at"), (run % 3 != 0).alias("complete"))
    events = rows.select(source, run.alias("run_no"), F.explode(F.when(F.col("event_id") % 20 == 0, F.array(met, over)).otherwise(F.array(met))).alias("x")).select("source", "run_no", "x.*")
    started = crawl_runs.run_actions(events, "0 seconds", buckets=4).writeStream.format("parquet").option("path", f"{place}/actions").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return r.spark.read.schema(crawl_runs.ACTIONS).parquet(f"{place}/actions")


@query(_RUNS + "SELECT CAST(source AS VARCHAR) AS source, run_no, CAST(url AS VARCHAR) AS url, action, revision_no FROM a", with_roles=False)
def st1_crawl_runs(r: Roles):
    return _run_actions(r).select("source", "run_no", "url", "action", "revision_no")


@query(_RUNS + "SELECT CAST(source AS VARCHAR) AS source, run_no, count(*) AS total, " + ", ".join(f"count(*) FILTER (action = '{x}') AS \"{x}\"" for x in ("new", "seen", "unchanged", "changed", "missing", "skipped", "error")) + " FROM a GROUP BY 1, 2", with_roles=False)
def st1_totals_by_run(r: Roles):
    from paperglass.streaming.crawl_runs import run_totals

    return run_totals(_run_actions(r)).drop("new_revisions", "bytes")
