"""Listings, groupings and validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.operators import listings as L
from paperglass.operators import relations as J
from paperglass.operators import reports as R
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


@query("SELECT p_type AS id, count(*) AS n_versions, count(DISTINCT p_brand) AS n_subjects FROM part GROUP BY 1 HAVING list_contains(list(DISTINCT p_brand), 'Brand#2')", with_roles=False)
def f20_materials(r: Roles):
    items = r.table("part").groupBy(F.col("p_type").alias("id")).agg(F.collect_set("p_brand").alias("subjects"), F.collect_list(F.struct("p_partkey", "p_name")).alias("versions"))
    return L.materials(items, subject="Brand#2").select("id", F.col("n_versions").cast("long"), F.col("n_subjects").cast("long"))


@query("SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'P' THEN 'cancelled' ELSE 'unobtainable' END AS state, count(*) AS n FROM orders GROUP BY 1, 2", with_roles=False)
def f23_seasons(r: Roles):
    o = r.table("orders")
    return L.seasons({"available": o.where("o_orderstatus = 'F'"), "cancelled": o.where("o_orderstatus = 'P'"), "unobtainable": o.where("o_orderstatus not in ('F', 'P')")}, "o_orderpriority")


@query("SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_type = 'error' AND value > 10", with_roles=False)
def f16_list_overrides(r: Roles):
    o = r.table("events").select("event_id", "user_id", F.lit("user").alias("target_type"), F.col("user_id").alias("target_id"), (F.col("event_type") == "error").alias("conflict_detected"), (F.col("value") > 10).alias("active"))
    return L.list_overrides(o, "user", 7, only_conflicts=True, only_active=True).select("event_id", "user_id")


_CLASSES = "SELECT event_id AS id, user_id AS document_id, CASE WHEN event_type = 'error' THEN 'conflict' ELSE event_type END AS method FROM events"


def _classes(r: Roles):
    t = F.col("event_type")
    return r.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.when(t == "error", "conflict").otherwise(t).alias("method"))


@query(f"WITH p AS ({_CLASSES} ORDER BY id DESC LIMIT 100) SELECT *, (SELECT count(*) FROM p WHERE method = 'conflict') AS conflicts FROM p", with_roles=False)
def f17_classifications(r: Roles):
    return L.classifications(_classes(r), limit=100)


@query(f"WITH p AS (SELECT * FROM ({_CLASSES}) WHERE document_id = 7 AND method = 'conflict' ORDER BY id DESC LIMIT 50) SELECT *, (SELECT count(*) FROM p WHERE method = 'conflict') AS conflicts FROM p", with_roles=False)
def f17_conflicts_of_document(r: Roles):
    return L.classifications(_classes(r), document_id=7, method="conflict")


@query("""
SELECT coalesce(CASE WHEN level IS NOT NULL THEN subject_code || '|' || year || '|' || level END, CAST(id AS VARCHAR)) AS paper_key, count(DISTINCT id) AS files FROM paper GROUP BY 1
""")
def j23_grouped_files(r: Roles):
    return L.grouped_files(r.papers().withColumn("url", F.col("id").cast("string")), ["subject_code", "year", "level"], "url", "doc_type").select("paper_key", F.size("files").cast("long").alias("files"))


@query("""
SELECT id, year, CASE WHEN id % 4 = 0 THEN 'parsed' ELSE 'new' END AS stage FROM paper
WHERE doc_type = 'question_paper' AND year BETWEEN 2016 AND 2020 AND subject_code <> 'BUILDING' AND id % 5 <> 0
""")
def f30_work_queue(r: Roles):
    p = r.papers().withColumnRenamed("doc_type", "kind").withColumnRenamed("subject_code", "subject")
    return L.work_queue(p, p.where("id % 4 = 0").select("id", F.lit("parsed").alias("stage")), p.where("id % 5 = 0"), "id", ["question_paper"], (2016, 2020), ["BUILDING"]).select("id", "year", "stage")


@query("SELECT facet, list_sort(list(DISTINCT v)) AS values FROM (SELECT 'brand' AS facet, p_brand AS v FROM part UNION ALL SELECT 'type', p_type FROM part) GROUP BY 1", with_roles=False)
def a13_facet_values(r: Roles):
    return L.facet_values(r.table("part").select(F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type")).alias("tags")), "tags")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#3'", with_roles=False)
def f29_exact_categories(r: Roles):
    return L.with_facet(r.table("part").withColumn("tags", F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"))), "tags", ["type:PROMO", "brand:Brand#3"]).select("p_partkey")


@query("SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey) FILTER (c_custkey % 3 = 0)) AS shared, list_sort(list(DISTINCT c_nationkey) FILTER (c_custkey % 3 <> 0)) AS own FROM customer GROUP BY 1", with_roles=False)
def a16_shared_kinds(r: Roles):
    return L.shared_kinds(r.table("customer"), "c_mktsegment", "c_nationkey", F.col("c_custkey") % 3 == 0)


@query("SELECT board, subject_code, count(*) AS units, count(*) FILTER (level IS NOT NULL AND (doc_type <> 'mark_scheme' OR year > 2017)) AS complete FROM paper GROUP BY ROLLUP (board, subject_code)")
def a18_completion_rollup(r: Roles):
    return L.completion_rollup(r.papers(), ["board", "subject_code"], [F.col("level").isNotNull(), F.when(F.col("doc_type") == "mark_scheme", F.col("year") > 2017)])


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS verified, count(DISTINCT event_id % 4) FILTER (event_type = 'view') = 4 AS complete FROM events GROUP BY 1", with_roles=False)
def a19_audio_summary(r: Roles):
    e = r.table("events").select("user_id", F.when(F.col("event_type") == "view", "verified").otherwise("other").alias("status"), (F.col("event_id") % 4).alias("part"))
    return L.audio_summary(e, ["user_id"])


@query("SELECT s_suppkey, unnest(list_filter([CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_nationkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS rule FROM supplier", with_roles=False)
def g7_manifest_findings(r: Roles):
    return L.findings(r.table("supplier"), "s_suppkey", {"negative": F.col("s_acctbal") < 0, "even": F.col("s_nationkey") % 2 == 0})


@query("""
, rows AS (SELECT paper_id AS paper, number_path, CASE WHEN id % 17 = 0 THEN 'x' WHEN parent_id IS NULL THEN NULL ELSE regexp_replace(number_path, '\\([^()]*\\)$', '') END AS parent_path,
  CASE WHEN id % 2 = 0 THEN 'qp' ELSE 'ms' END AS role, CAST(id % 3 AS VARCHAR) AS file FROM question),
q AS (SELECT * FROM rows WHERE role = 'qp'),
n AS (SELECT paper, count(DISTINCT file) FILTER (role = 'qp') AS qp, count(DISTINCT file) FILTER (role = 'ms') AS ms FROM rows GROUP BY 1)
SELECT paper, 'not_one_question_paper' AS rule FROM n WHERE qp <> 1 UNION SELECT paper, 'several_mark_schemes' FROM n WHERE ms > 1
UNION SELECT paper, 'repeated_number' FROM q GROUP BY paper, number_path HAVING count(*) > 1
UNION SELECT paper, 'wrong_parent' FROM q WHERE parent_path IS DISTINCT FROM CASE WHEN contains(number_path, '(') THEN regexp_replace(number_path, '\\([^()]*\\)$', '') END
UNION SELECT paper, 'missing_parent' FROM q WHERE parent_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q p WHERE p.paper = q.paper AND p.number_path = q.parent_path)
""")
def g8_index_findings(r: Roles):
    k = F.col("id")
    rows = r.questions().select(F.col("paper_id").alias("paper"), "number_path", F.when(k % 17 == 0, "x").when(F.col("parent_id").isNotNull(), J.parent_path("number_path")).alias("parent_path"), F.when(k % 2 == 0, "qp").otherwise("ms").alias("role"), (k % 3).cast("string").alias("file"))
    return L.index_findings(rows)


@query("SELECT id, list_filter(range(2, n + 1), lambda p: NOT list_contains(a, p)) AS pages FROM (SELECT o_custkey AS id, 40 AS n, list(CAST(o_orderkey % 40 AS BIGINT)) AS a FROM orders GROUP BY 1)", with_roles=False)
def so5_uncovered_pages(r: Roles):
    p = r.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit(40).alias("page_count"), F.collect_set((F.col("o_orderkey") % 40).cast("int")).alias("assigned"))
    return L.uncovered_pages(p).select("id", F.col("pages").cast("array<bigint>").alias("pages"))


@query("""
, s AS (SELECT paper_id AS id, list(number_path ORDER BY id) AS a FROM question GROUP BY 1), c AS (SELECT paper_id AS id, list(number_path ORDER BY id) AS b FROM question WHERE id % 97 <> 5 GROUP BY 1)
SELECT id, list_filter(a, lambda x: NOT list_contains(b, x)) AS only_stored, list_filter(b, lambda x: NOT list_contains(a, x)) AS only_computed,
  CAST(list_min(list_filter(range(0, len(a)), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1])) AS INTEGER) AS first_difference FROM s JOIN c USING (id)
""")
def so6_path_divergence(r: Roles):
    def paths(q):
        return q.groupBy(F.col("paper_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "number_path"))), lambda x: x["number_path"]).alias("paths"))

    return L.path_divergence(paths(r.questions()), paths(r.questions().where("id % 97 <> 5")))


@query("SELECT s_suppkey AS document, 'r' || CAST(s_nationkey % 3 AS VARCHAR) AS role, CASE WHEN s_suppkey % 7 = 0 THEN 'missing_role' WHEN s_suppkey % 5 = 0 THEN 'different' ELSE 'same' END AS verdict FROM supplier", with_roles=False)
def j26_hash_reconciliation(r: Roles):
    s = r.table("supplier").select(F.col("s_suppkey").alias("document"), F.concat(F.lit("r"), (F.col("s_nationkey") % 3).cast("string")).alias("role"), F.sha2("s_name", 256).alias("sha256"))
    table = s.where("document % 7 <> 0").withColumn("sha256", F.when(F.col("document") % 5 == 0, "other").otherwise(F.col("sha256")))
    return L.hash_reconciliation(s, table)


@query("SELECT o_orderkey AS run_id, o_custkey AS document_id, c_nationkey AS revision_no, n_name AS sha256 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", with_roles=False)
def j2_lineage(r: Roles):
    runs = r.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_revision_id"))
    rev = r.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("artifact_id"), F.col("c_nationkey").alias("revision_no"))
    return L.lineage(runs, rev, r.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("sha256")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'h' || p_brand WHEN p_type <> 'PROMO' THEN 'l' || p_type END AS item FROM part", with_roles=False)
def j25_labelled_pages(r: Roles):
    p = r.table("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("page_hash"), F.col("p_type").alias("label"))
    brands = r.table("part").select(F.col("p_brand").alias("page_hash"), F.concat(F.lit("h"), "p_brand").alias("item")).distinct()
    types = r.table("part").where("p_type <> 'PROMO'").select(F.col("p_type").alias("label"), F.concat(F.lit("l"), "p_type").alias("item")).distinct()
    return L.labelled_pages(p, brands, types).select("p_partkey", "item")


@query("SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) s ON c.k = s.k", with_roles=False)
def j28_assembled_sets(r: Roles):
    c = r.table("customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    s = r.table("supplier").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return L.assembled({"c": c, "s": s}, ["k"]).select("k", F.col("c.n").alias("customers"), F.col("s.n").alias("suppliers"))


@query("""
SELECT user_id AS identity, props AS sha256, count(*) AS probes, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY min(ts), props) AS INTEGER) AS variant FROM events WHERE event_type <> 'error' GROUP BY 1, 2
""", with_roles=False)
def g6_audio_variants(r: Roles):
    e = r.table("events").select(F.col("user_id").alias("identity"), F.lit("s").alias("scope"), F.lit(1).alias("part"), F.col("props").alias("sha256"), F.col("ts").alias("seen_at"), (F.col("event_type") == "error").alias("failed"))
    return L.audio_variants(e).select("identity", "sha256", "probes", "variant")


@query("SELECT 'supplier:' || s_suppkey AS public_id, 'supplier' AS kind FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation", with_roles=False)
def s18_catalog_build(r: Roles):
    return L.catalog({"supplier": r.table("supplier").select("s_suppkey", "s_name"), "nation": r.table("nation").select("n_nationkey", "n_name")}).select("public_id", "kind")


@query("SELECT id, other FROM (SELECT id, parent_id AS other FROM question WHERE parent_id IS NOT NULL UNION ALL SELECT parent_id, id FROM question WHERE parent_id IS NOT NULL)")
def j13_symmetric_pairs(r: Roles):
    return J.symmetric_pairs(r.questions().where("parent_id is not null").select(F.col("id").alias("a"), F.col("parent_id").alias("b")))


@query("""
SELECT q.id, (SELECT count(*) FROM link l WHERE l.question_id = q.id) AS topics, (SELECT count(*) FROM difficulty d WHERE d.question_id = q.id) AS difficulties FROM question q
""")
def j12_question_bundle(r: Roles):
    return J.bundle(r.questions(), {"topics": r.links(), "difficulties": r.difficulty()}).select("id", F.size("topics").cast("long").alias("topics"), F.size("difficulties").cast("long").alias("difficulties"))


@query("""
, a AS (SELECT question_id AS id, min(code) AS code_a FROM link WHERE source = 'auto' GROUP BY 1), c AS (SELECT question_id AS id, list(code) AS codes FROM link WHERE source = 'auto' GROUP BY 1)
SELECT CAST(id % 10 AS INTEGER) AS "group", count(*) AS questions FROM a GROUP BY 1
""")
def a10_agreement(r: Roles):
    from pyspark.sql import Window

    ranked = r.links().where("source = 'auto'").select(F.col("question_id").alias("id"), (F.col("question_id") % 10).cast("int").alias("group"), "code", F.row_number().over(Window.partitionBy("question_id").orderBy("code")).alias("rank"))
    return R.agreement(ranked, ranked, "group").where("top1 = 1 and coverage = 1").select("group", "questions")
