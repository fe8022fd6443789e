"""Scalar functions, merges and listings that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.functions import text as X
from paperglass.operators import answers as A
from paperglass.operators import governance as G
from paperglass.operators import listings as L
from paperglass.operators import relations as J
from paperglass.operators import reports as R
from paperglass.operators import tagging as T
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles
from paperglass.sources import tables as S


@query("SELECT board, count(*) AS total, count(*) FILTER (year < 2018) AS old, count(*) FILTER (level IS NULL) AS unlevelled FROM paper GROUP BY 1")
def a35_board_health(r: Roles):
    return R.counts_by_state(r.papers(), ["board"], {"old": F.col("year") < 2018, "unlevelled": F.col("level").isNull()})


@query("""
, lost AS (SELECT id, paper_id, number_path FROM entry WHERE id % 5 = 0)
SELECT l.id, q.id AS question_id FROM lost l LEFT JOIN question q ON q.paper_id = l.paper_id AND q.number_path = CASE WHEN l.number_path LIKE '%(i)' THEN left(l.number_path, -3) ELSE l.number_path END
""")
def j7_relink_orphans(r: Roles):
    return J.link_entries(r.entries().where("id % 5 = 0"), r.questions()).select("id", "question_id")


@query("""
, good AS (SELECT paper_id, number_path FROM entry WHERE trim(text) <> '' GROUP BY 1, 2)
SELECT q.id, 'gap' AS kind FROM question q LEFT JOIN good g USING (paper_id, number_path) LEFT JOIN official o ON o.question_id = q.id WHERE g.number_path IS NULL AND o.question_id IS NULL
""")
def j11_answer_gaps(r: Roles):
    found = J.resolve_answers(r.questions().select("id", "paper_id", "number_path"), r.entries(), r.official())
    return found.where("mode <> 'exact'").select("id", F.lit("gap").alias("kind"))


@query("""
SELECT s_suppkey AS target_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS value, CASE WHEN s_suppkey % 3 = 0 THEN 'first' WHEN s_suppkey % 2 = 0 THEN s_name END AS source_value
FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0
""", with_roles=False)
def s15_set_overrides(r: Roles):
    s = r.table("supplier").select(F.lit("question").alias("target_type"), F.col("s_suppkey").alias("target_id"), F.lit("marks").alias("field"), "s_name")
    key = ["target_type", "target_id", "field"]
    old = s.where("target_id % 3 = 0").select(*key, F.lit("old").alias("value"), F.lit("first").alias("source_value"), F.lit("a").alias("author"), F.lit(True).alias("active"))
    edits = s.select(*key, F.lit("new").alias("value"), F.when(F.col("target_id") % 2 == 0, "b").alias("author"))
    allowed = r.spark.createDataFrame([("question", "marks")], "target_type string, field string")
    return L.set_overrides(old, edits, s.select(*key, F.col("s_name").alias("value")), allowed)[0].select("target_id", "value", "source_value")


@query("SELECT p_brand AS code, CAST(NULL AS VARCHAR) AS parent_code, 'unit' AS node_type, 1 AS depth FROM part GROUP BY 1 UNION ALL SELECT p_brand || '/' || p_type, p_brand, 'topic', 2 FROM part GROUP BY p_brand, p_type UNION ALL SELECT p_brand || '/' || p_type || '/' || p_partkey, p_brand || '/' || p_type, 'point', 3 FROM part", with_roles=False)
def s13_specification_tree(r: Roles):
    topic = F.concat_ws("/", "p_brand", "p_type")
    points = r.table("part").groupBy("p_brand", topic.alias("t")).agg(F.collect_list(F.struct(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"))).alias("points"))
    units = points.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("t").alias("code"), F.col("t").alias("name"), "points")).alias("topics"))
    spec = units.select(F.array(F.struct(F.col("p_brand").alias("code"), F.col("p_brand").alias("name"), "topics")).alias("units"))
    return S.flatten_specification(spec).select("code", "parent_code", "node_type", "depth")


@query("SELECT DISTINCT p_name AS keyword, CASE WHEN length(p_name) >= 14 THEN 3.0 WHEN length(p_name) >= 9 THEN 2.2 WHEN length(p_name) >= 6 THEN 1.5 ELSE 1.0 END AS weight FROM part", with_roles=False)
def x10_keyword_weights(r: Roles):
    return r.table("part").select(F.col("p_name").alias("keyword"), T.keyword_weight(F.col("p_name")).alias("weight")).distinct()


@query("SELECT id, CASE WHEN parent_id IS NOT NULL THEN split_part(number_path, '(', 1) END AS parent, split_part(number_path, '(', 1) AS root FROM question")
def x17_path_functions(r: Roles):
    return r.questions().select("id", J.parent_path("number_path").alias("parent"), J.root_path("number_path").alias("root"))


@query("SELECT id AS question_id, 2 AS n_points FROM entry")
def x20_scaffold(r: Roles):
    e = r.entries().select(F.col("id").alias("question_id"), F.concat(F.lit(" first ;"), F.lit("\n"), F.lit("second "), F.trim("text")).alias("text"))
    return G.scaffold(e).select("question_id", "n_points")


@query("SELECT doc_id, round(len(list_filter(['the', 'with', 'der'], lambda w: list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), w))) / 3, 4) AS share FROM documents", with_roles=False)
def x26_token_share(r: Roles):
    need = F.array(F.lit("the"), F.lit("with"), F.lit("der"))
    return r.table("documents").select("doc_id", F.round(X.overlap_share(need, F.split(F.lower("text"), "[^a-z0-9]+")), 4).alias("share"))


@query("SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN round(least(1.0, value / 50) * CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE least(1.0, 0.5 + (event_id % 10) / 10) END, 6) ELSE 0.0 END AS score FROM events", with_roles=False)
def x29_confidence(r: Roles):
    margin = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10) / 10)
    return r.table("events").select("event_id", F.round(A.confidence(F.col("user_id") % 5 != 0, F.lit(True), F.col("value") / 50, F.lit(None).cast("double"), margin), 6).alias("score"))
