"""Text functions, topics, similarity and difficulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.functions import text as X
from paperglass.operators import ranking as W
from paperglass.operators import similarity as Y
from paperglass.operators import tagging as T
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles
from paperglass.sources import tables as S


@query("SELECT p_partkey, sha1(lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) || chr(31) || lower(p_brand) || chr(31) || CAST(p_size AS VARCHAR)) AS key FROM part", with_roles=False)
def x1_identity_key(r: Roles):
    return r.table("part").select("p_partkey", X.identity_key(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part", with_roles=False)
def x2_slugify(r: Roles):
    return r.table("part").select("p_partkey", X.slugify(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("""
WITH c AS (SELECT p_partkey, sha256('brand=' || p_brand || '|key=' || p_partkey) AS h FROM part)
SELECT p_partkey, 'pt_' || array_to_string(list_transform(range(32), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS public_id FROM c
""", with_roles=False)
def x3_public_ids(r: Roles):
    return r.table("part").select("p_partkey", X.public_id("pt_", {"brand": F.col("p_brand"), "key": F.col("p_partkey")}).alias("public_id"))


@query("SELECT c_custkey, sha256('name=' || c_name || '|segment=' || c_mktsegment) AS hash FROM customer", with_roles=False)
def x4_content_hash(r: Roles):
    return r.table("customer").select("c_custkey", X.content_hash({"segment": F.col("c_mktsegment"), "name": F.col("c_name")}).alias("hash"))


@query()
def x5_near_normal(r: Roles):
    return r.table("documents").select("doc_id", X.near_normal(F.col("text")).alias("norm"))


@query("""
SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, substr(text, CAST(i AS INTEGER), 3) AS gram FROM benchmark, unnest(range(1, greatest(length(text) - 1, 2))) AS t(i)) GROUP BY 1, 2
""", with_roles=False)
def x6_char_ngrams(r: Roles):
    return r.table("benchmark").select("item_id", F.explode(X.char_ngrams(F.col("text"))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("tf"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({_STOP}, w))) AS n_words FROM documents", with_roles=False)
def x8_topic_words(r: Roles):
    return r.table("documents").select("doc_id", F.size(X.topic_words(F.col("text"))).alias("n_words"))


@query("""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>|</(?:p|div|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')) AS text
FROM pages
""", with_roles=False)
def s7_strip_html(r: Roles):
    return r.table("pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, CAST((length(lower(html)) - length(replace(lower(html), 'the', ''))) / 3 AS BIGINT) AS hits FROM pages", with_roles=False)
def x32_occurrences(r: Roles):
    return r.table("pages").select("page_id", X.occurrences(F.col("html"), "the").alias("hits"))


@query("""
WITH t AS (SELECT item_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+(?:\\.[0-9]+)?', '#', 'g'), '[^a-z0-9# ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM benchmark),
g AS (SELECT id, substr(t, CAST(i AS INTEGER), 3) AS gram, count(*) AS tf FROM t, unnest(range(1, greatest(length(t) - 1, 2))) AS x(i) WHERE length(t) >= 25 GROUP BY 1, 2),
n AS (SELECT count(DISTINCT id) AS n FROM g), d AS (SELECT gram, count(*) AS df FROM g GROUP BY 1),
w AS (SELECT id, gram, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM g JOIN d USING (gram) CROSS JOIN n), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.gram = b.gram AND a.id < b.id WHERE a.df BETWEEN 2 AND 400 GROUP BY 1, 2),
c AS (SELECT a, b, s / (x.l * y.l) AS score FROM p JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE s / (x.l * y.l) >= 0.3),
r AS (SELECT a, b, score, row_number() OVER (PARTITION BY me ORDER BY score DESC, other) AS k FROM (SELECT a, b, score, a AS me, b AS other FROM c UNION ALL SELECT a, b, score, b, a FROM c))
SELECT DISTINCT a AS lo, b AS hi, round(score, 4) AS score FROM r WHERE k <= 5
""", with_roles=False)
def g1_similar_questions(r: Roles):
    return Y.similar_pairs(r.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("stem_text")), min_score=0.3)


_TREE = """
WITH base AS (SELECT item_id AS id, item_id // 8 AS paper, item_id % 8 AS k, text FROM benchmark),
q AS (SELECT b.id, b.paper, CAST(1 + b.k // 4 AS VARCHAR) || CASE b.k % 4 WHEN 0 THEN '' ELSE '(' || chr(CAST(96 + b.k % 4 AS INTEGER)) || ')' END AS path, CASE WHEN b.k % 4 = 0 THEN b.text ELSE r.text || ' ' || b.text END AS text
  FROM base b LEFT JOIN base r ON r.id = b.id - b.k % 4),
t AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+(?:\\.[0-9]+)?', '#', 'g'), '[^a-z0-9# ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM q WHERE text IS NOT NULL),
g AS (SELECT id, substr(t, CAST(i AS INTEGER), 3) AS gram, count(*) AS tf FROM t, unnest(range(1, greatest(length(t) - 1, 2))) AS x(i) WHERE length(t) >= 25 GROUP BY 1, 2),
n AS (SELECT count(DISTINCT id) AS n FROM g), d AS (SELECT gram, count(*) AS df FROM g GROUP BY 1),
w AS (SELECT id, gram, df, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM g JOIN d USING (gram) CROSS JOIN n), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.gram = b.gram AND a.id < b.id WHERE a.df BETWEEN 2 AND 400 GROUP BY 1, 2),
c AS (SELECT a, b, s / (x.l * y.l) AS score FROM p JOIN l x ON x.id = a JOIN l y ON y.id = b JOIN q qa ON qa.id = a JOIN q qb ON qb.id = b
  WHERE s / (x.l * y.l) >= 0.25 AND NOT (qa.paper = qb.paper AND regexp_extract(qa.path, '^[0-9]+') = regexp_extract(qb.path, '^[0-9]+'))),
r AS (SELECT a, b, score, row_number() OVER (PARTITION BY me ORDER BY score DESC, other) AS k FROM (SELECT a, b, score, a AS me, b AS other FROM c UNION ALL SELECT a, b, score, b, a FROM c)),
found AS (SELECT DISTINCT a AS lo, b AS hi, round(score, 4) AS score FROM r WHERE k <= 5)
"""


def _tree(r: Roles):
    """Items as questions of papers, two roots of three parts each; a part's text holds its root's."""
    b, k = r.table("benchmark"), F.col("item_id") % 8
    label = F.concat(F.lit("("), F.char(96 + k % 4), F.lit(")"))
    root = b.select(F.col("item_id").alias("root"), F.col("text").alias("above"))
    q = b.select(F.col("item_id").alias("id"), F.floor(F.col("item_id") / 8).alias("paper"), F.concat((1 + F.floor(k / 4)).cast("string"), F.when(k % 4 == 0, "").otherwise(label)).alias("path"), (k % 4).alias("part"), (F.col("item_id") - k % 4).alias("root"), "text")
    return q.join(root, "root", "left").withColumn("stem_text", F.when(F.col("part") == 0, F.col("text")).otherwise(F.concat("above", F.lit(" "), "text"))).where("stem_text is not null")


@query(_TREE + "SELECT * FROM found", with_roles=False)
def g1_similar_without_parts(r: Roles):
    return Y.similar_pairs(_tree(r), min_score=0.25, paper_col="paper", path_col="path")


@query(_TREE + "SELECT * FROM found WHERE (lo % 3 = 0 OR hi % 3 = 0) AND lo % 2 <> 0", with_roles=False)
def g1_similar_for_targets(r: Roles):
    """Pairs with a lower id that is even are there already; only those of every third question are asked for."""
    q = _tree(r)
    every = q.select("id")
    existing = Y.similar_pairs(q, min_score=0.25, paper_col="paper", path_col="path").where("lo % 2 = 0")
    return Y.similar_pairs(q, min_score=0.25, paper_col="paper", path_col="path", targets=every.where("id % 3 = 0"), existing=existing)


def _points(r: Roles):
    return r.table("benchmark").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("name"), F.substring_index("text", ".", 1).alias("head"))


_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) >= 6)"


def _words(text):
    """Words of six letters or more: a vocabulary that both engines split alike."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 6)


@query(f"""
WITH w AS (SELECT item_id AS key, unnest({_TOKENS.format("text")}) AS term, 3.0 AS x FROM benchmark UNION ALL SELECT item_id, unnest({_TOKENS.format("split_part(text, '.', 1)")}), 1.0 FROM benchmark),
tf AS (SELECT key, term, sum(x) AS tf FROM w GROUP BY 1, 2),
l AS (SELECT b.item_id AS key, coalesce(sum(x), 0) AS len FROM benchmark b LEFT JOIN w ON w.key = b.item_id GROUP BY 1),
s AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
p AS (SELECT key, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) AS part FROM tf JOIN df USING (term) JOIN l USING (key), s),
q AS (SELECT DISTINCT doc_id AS id, unnest({_TOKENS.format("text")}) AS term FROM documents),
score AS (SELECT id, key, sum(part) AS score FROM q JOIN p USING (term) GROUP BY 1, 2)
SELECT id, key, rank, round(score, 4) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, CAST(key AS VARCHAR)) AS INTEGER) AS rank FROM (SELECT id, CAST(key AS VARCHAR) AS key, score FROM score)) WHERE rank <= 3
""", with_roles=False)
def g2_bm25_topics(r: Roles):
    scores = T.bm25_scores(_points(r), r.table("documents").select(F.col("doc_id").alias("id"), "text"), {"name": 3.0, "head": 1.0}, tokens=_words)
    top = T.top_scores(scores.withColumn("score", F.round("score", 9)), 3)
    return top.select("id", "key", "rank", F.round("score", 4).alias("score"))


@query()
def w2_w3_tag_confidence(r: Roles):
    scores = T.bm25_scores(_points(r), r.table("documents").select(F.col("doc_id").alias("id"), "text"), {"name": 3.0}, tokens=_words)
    ranked = W.running_confidence(scores, "id", "score", [F.desc("score"), F.asc("key")], 15.0, 0.65, 0.35, 3)
    return W.second_tag(ranked, "id", "score", 0.5).select("id", "key", "rank", "confidence")


_KEYWORDS = {"A": ["there", "that", "erstion"], "B": ["which", "with", "from"], "C": ["ontion", "inganderes", "thing"], "D": ["der", "die", "nicht"], "E": ["les", "dans", "que"]}


@query("""
WITH k AS (SELECT * FROM (VALUES ('A','there'),('A','that'),('A','erstion'),('B','which'),('B','with'),('B','from'),('C','ontion'),('C','inganderes'),('C','thing'),('D','der'),('D','die'),('D','nicht'),('E','les'),('E','dans'),('E','que')) AS t(code, keyword)),
w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS keyword FROM documents),
s AS (SELECT id, code, sum(CASE WHEN length(keyword) >= 14 THEN 3.0 WHEN length(keyword) >= 9 THEN 2.2 WHEN length(keyword) >= 6 THEN 1.5 ELSE 1.0 END) AS score FROM w JOIN k USING (keyword) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS n, max(score) OVER (PARTITION BY id) AS best FROM s)
SELECT id, code, CAST(round(score, 3) AS DOUBLE) AS score, CAST(round(0.65 * least(1.0, score / 6) + 0.35 * score / best, 4) AS DOUBLE) AS confidence FROM r WHERE n <= 2 AND round(0.65 * least(1.0, score / 6) + 0.35 * score / best, 4) >= 0.18
""", with_roles=False)
def g3_keyword_topics(r: Roles):
    keywords = r.spark.createDataFrame([(c, k) for c, ks in _KEYWORDS.items() for k in ks], "code string, keyword string")
    return T.keyword_topics(r.table("documents").select(F.col("doc_id").alias("id"), "text"), keywords)


@query("""
, c AS (SELECT parent_id, count(*) AS n FROM question WHERE parent_id IS NOT NULL GROUP BY 1), t AS (SELECT question_id, count(*) AS n FROM link GROUP BY 1),
f AS (SELECT q.id, coalesce(marks, 0) AS m, length(stem_text) AS len, coalesce(c.n, 0) AS ch, depth, q.id IN (SELECT question_id FROM asset) AS fig, coalesce(t.n, 0) AS tp, regexp_matches(stem_text, '(?i)\\burgent\\b') AS hit
  FROM question q LEFT JOIN c ON c.parent_id = q.id LEFT JOIN t ON t.question_id = q.id),
v AS (SELECT id, m, least(1.0, greatest(0.0, 0.34 * least(1.0, m / 12) + 0.16 * least(1.0, ln(1 + len) / ln(601)) + 0.14 * least(1.0, ch / 6) + 0.08 * least(1.0, depth / 3) + CASE WHEN fig THEN 0.08 ELSE 0 END + 0.06 * least(1.0, tp / 3) + CASE WHEN hit THEN 0.22 ELSE 0 END)) AS value FROM f)
SELECT id, CAST(round(CASE WHEN m <= 1 THEN least(value, 0.45) WHEN m = 2 THEN least(value, 0.65) ELSE value END, 4) AS DOUBLE) AS value FROM v
""")
def x11_difficulty(r: Roles):
    from paperglass.operators.reports import question_facts

    q = r.questions().join(question_facts(r.questions(), r.links(), r.assets()), "id")
    d = T.difficulty(F.col("marks"), F.col("stem_text"), F.col("child_count"), F.col("depth"), F.col("has_asset"), F.col("topic_count"), {"urgent": 0.22})
    return q.select("id", d["value"].alias("value"))


@query("""
, d AS (SELECT id AS question_id, CASE id % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'change' WHEN 2 THEN 'drop' WHEN 3 THEN 'change' ELSE 'what' END AS decision, CASE id % 5 WHEN 1 THEN 'T2' WHEN 3 THEN 'T99' END AS code FROM question WHERE id % 3 = 0),
a AS (SELECT question_id, min(code) AS old FROM link WHERE source = 'auto' GROUP BY 1)
SELECT d.question_id, CASE WHEN decision = 'what' THEN 'error_unknown_decision' WHEN old IS NULL THEN 'error_no_tag' WHEN decision = 'change' AND d.code = 'T99' THEN 'error_unknown_code'
  WHEN decision = 'change' AND d.code = old THEN 'kept' WHEN decision = 'keep' THEN 'kept' WHEN decision = 'change' THEN 'changed' ELSE 'dropped' END AS outcome,
  CASE WHEN decision = 'keep' AND old IS NOT NULL THEN old WHEN decision = 'change' AND d.code <> 'T99' AND old IS NOT NULL THEN d.code END AS final_code
FROM d LEFT JOIN a USING (question_id)
""")
def g4_apply_review(r: Roles):
    m = F.col("id") % 5
    d = r.questions().where("id % 3 = 0").select(F.col("id").alias("question_id"), F.when(m == 0, "keep").when(m.isin(1, 3), "change").when(m == 2, "drop").otherwise("what").alias("decision"), F.when(m == 1, "T2").when(m == 3, "T99").alias("code"))
    return T.apply_review(d, r.links(), r.nodes())


@query("SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 5) + 1 AS BIGINT) AS batch FROM orders", with_roles=False)
def s10_review_batches(r: Roles):
    return S.review_batches(r.table("orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 5)


@query("SELECT r_name AS board, CAST(year(o_orderdate) AS VARCHAR) AS key, count(*) AS events, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, list_sort(list(DISTINCT c_mktsegment)) AS subjects FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", with_roles=False)
def s11_season_index(r: Roles):
    j = r.table("orders").join(r.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.season_index(j.select(F.col("r_name").alias("board"), F.year("o_orderdate").cast("string").alias("key"), F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("subject_code")))


@query("""
WITH o AS (SELECT user_id AS scope, date_trunc('day', ts) AS native_at, ts AS observed_at, props AS payload FROM events),
t AS (SELECT scope, max(native_at) AS native_at FROM o GROUP BY 1)
SELECT scope, max(observed_at) AS observed_at, max_by(payload, observed_at) AS payload, CASE WHEN count(DISTINCT payload) > 1 THEN 'conflict' ELSE 'current' END AS state FROM o JOIN t USING (scope, native_at) GROUP BY 1
""", with_roles=False)
def st2_latest_checkpoints(r: Roles):
    from paperglass.streaming.crawl import latest_checkpoints, newest

    o = r.table("events").select(F.col("user_id").alias("scope"), F.date_trunc("day", "ts").alias("native_at"), F.col("ts").alias("observed_at"), F.col("props").alias("payload"))
    return newest(latest_checkpoints(o)).select("scope", "observed_at", "payload", "state")
