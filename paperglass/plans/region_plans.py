"""Provinces, groups of papers and phrases, on labels made of two aliases and the year."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.functions import regions as G
from paperglass.operators import tagging as T
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles

#: Aliases of both kinds, codes and names that mean nothing.
_NAMES = [*G.ALIASES, *G.GROUP_ALIASES, *G.CODES, "sh", "ii卷", "山东省", "新疆特别行政区", "BJ市", "火星省", "", " 沪 ", "某地"]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


def _label(r: Roles, column):
    names = F.array(*map(F.lit, _NAMES))
    at = lambda k: F.element_at(names, (k % len(_NAMES) + 1).cast("int"))
    k = F.col("p_partkey")
    return r.table("part").select("p_partkey", column(F.concat((2000 + k % 25).cast("string"), at(k), F.lit(" x "), F.when(k % 3 == 0, at(k * 7)).otherwise(""))).alias("found"))


_LABEL = f"""WITH name AS (SELECT * FROM {_values(list(enumerate(_NAMES)))} AS t(i, a)),
label AS (SELECT p_partkey, CAST(2000 + p_partkey % 25 AS VARCHAR) || n.a || ' x ' || CASE WHEN p_partkey % 3 = 0 THEN m.a ELSE '' END AS text
  FROM part JOIN name n ON n.i = p_partkey % {len(_NAMES)} JOIN name m ON m.i = (p_partkey * 7) % {len(_NAMES)})"""


@query(f"{_LABEL}, o AS (SELECT * FROM {_values([(k, a, G.GROUP_ALIASES[a]) for k, a in enumerate(G.GROUP_ORDER)])} AS t(k, a, g)) SELECT p_partkey, min_by(g, k) AS found FROM label LEFT JOIN o ON contains(text, o.a) GROUP BY p_partkey", with_roles=False)
def x34_group_in_text(r: Roles):
    return _label(r, G.group_in)


@query(f"{_LABEL}, o AS (SELECT * FROM {_values([(k, a, n) for k, (a, n) in enumerate(G.PROVINCE_ORDER)])} AS t(k, a, n)) SELECT p_partkey, min_by(n, k) AS found FROM label LEFT JOIN o ON contains(text, o.a) GROUP BY p_partkey", with_roles=False)
def x34_province_in_text(r: Roles):
    return _label(r, G.province_in)


_LOOKUP = f"""name AS (SELECT *, trim(a) AS s, regexp_replace(trim(a), '(省|市|特别行政区)$', '') AS inner_name FROM {_values(list(enumerate(_NAMES)))} AS t(i, a)),
province AS (SELECT * FROM {_values(list(G.ALIASES.items()))} AS t(a, n) UNION ALL SELECT * FROM {_values(list(G.CODES.items()))} AS t(a, n)),
grp AS (SELECT * FROM {_values(list(G.GROUP_ALIASES.items()))} AS t(a, g)),
found AS (SELECT i, a, (SELECT any_value(n) FROM province p WHERE p.a = s OR (p.a = upper(s) AND length(p.a) = 2)) AS p, (SELECT any_value(g) FROM grp WHERE upper(grp.a) = upper(s)) AS g,
  (SELECT any_value(n) FROM province p WHERE p.a = inner_name AND inner_name <> s) AS ended FROM name)"""


@query(f"WITH {_LOOKUP} SELECT p_partkey, coalesce(p, CASE WHEN g IS NULL THEN ended END) AS province, CASE WHEN p IS NULL THEN g END AS \"group\" FROM part JOIN found ON i = p_partkey % {len(_NAMES)}", with_roles=False)
def x34_normalised_region(r: Roles):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return r.table("part").select("p_partkey", G.normalised_region(name).alias("x")).select("p_partkey", "x.*")


@query(
    f"WITH m AS (SELECT * FROM {_values([(k, p) for k, ps in G.MEMBERS.items() for p in ps])} AS t(g, p)), grp AS (SELECT * FROM {_values(list(G.GROUP_ALIASES.items()))} AS t(a, g)), name AS (SELECT * FROM {_values(list(enumerate(_NAMES)))} AS t(i, a)) "
    f"SELECT p_partkey, coalesce(string_agg(p, ',' ORDER BY p), '') AS members FROM part JOIN name ON i = p_partkey % {len(_NAMES)} LEFT JOIN grp ON upper(grp.a) = upper(name.a) LEFT JOIN m ON m.g = grp.g GROUP BY p_partkey",
    with_roles=False,
)
def x34_group_members(r: Roles):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return r.table("part").select("p_partkey", F.array_join(G.group_members(name), ",").alias("members"))


_PHRASES = [("A", "of the"), ("A", "in the"), ("A", "the"), ("B", "is a"), ("B", "to be or"), ("C", "de la"), ("C", "que le"), ("D", "der und"), ("D", "in-the"), ("E", ", and the"), ("E", "a.b"), ("E", "et la")]


@query(f"""
WITH k AS (SELECT * FROM {_values(_PHRASES)} AS t(code, keyword)),
s AS (SELECT doc_id AS id, code, sum(CASE WHEN length(keyword) >= 14 THEN 3.0 WHEN length(keyword) >= 9 THEN 2.2 WHEN length(keyword) >= 6 THEN 1.5 ELSE 1.0 END) AS score
  FROM documents JOIN k ON regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(keyword) || '($|[^a-z0-9])') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, code) AS n, max(score) OVER (PARTITION BY id) AS best FROM s)
SELECT id, code, CAST(round(score, 3) AS DOUBLE) AS score, CAST(round(0.65 * least(1.0, score / 6) + 0.35 * score / best, 4) AS DOUBLE) AS confidence FROM r WHERE n <= 2 AND round(0.65 * least(1.0, score / 6) + 0.35 * score / best, 4) >= 0.18
""", with_roles=False)
def g3_keyword_phrases(r: Roles):
    return T.keyword_topics(r.table("documents").select(F.col("doc_id").alias("id"), "text"), r.spark.createDataFrame(_PHRASES, "code string, keyword string"))
