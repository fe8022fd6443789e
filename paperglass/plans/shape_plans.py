"""Shapes of payloads: the events' own, and two versions of nested ones built from the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.operators import shapes as H
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


def _versions(r: Roles) -> tuple[DataFrame, DataFrame]:
    """Payloads of roots with their parts, before and after: marks become text, a member is renamed, lists empty and mix."""
    q = r.questions()
    key = F.col("parent_id")

    def payload(member: str, marks, tags) -> DataFrame:
        part = F.struct(F.col("number_path").alias("n"), marks.alias("marks"), F.struct(F.col("stem_text").alias(member), F.array(F.array(F.col("id"))).alias("grid")).alias("deep"))
        parts = q.where("parent_id is not null").groupBy(key.alias("id")).agg(F.collect_list(part).alias("parts"))
        return parts.select("id", F.to_json(F.struct(F.col("parts").alias("p.q"), tags.alias("tags")), {"ignoreNullFields": "false"}).alias("payload"))

    tags = F.array(F.lit("a"), F.lit("b"))
    before = payload("stem", F.when(F.col("id") % 11 != 0, F.col("marks")), F.when(F.col("id") % 8 == 0, tags).otherwise(F.array().cast("array<string>")))
    after = payload("text", F.when(F.col("id") % 5 != 0, F.col("marks").cast("string")), F.when(F.col("id") % 12 == 0, tags).otherwise(F.array().cast("array<string>")))
    return before.where("id % 28 <> 0"), after.where("id % 20 <> 0")


_SQL = """, part AS (SELECT parent_id AS key, bool_or(id % 11 <> 0) AS num, bool_or(id % 11 = 0) AS nil, bool_or(id % 5 <> 0 AND id % 11 <> 0) AS str, bool_or(id % 5 = 0 OR id % 11 = 0) AS nil2
  FROM question WHERE parent_id IS NOT NULL GROUP BY 1),
side(name) AS (VALUES ('before'), ('after')),
path AS (
  SELECT key, name, x.path, x.kinds FROM part, side, (VALUES
    ('$', 'dict'), ('$."["p.q"]"', ''), ('$.tags', ''), ('$.tags[]', ''), ('p[]', 'dict'), ('p[].n', 'str'), ('p[].marks', ''), ('p[].deep', 'dict'), ('p[].deep.W', 'str'), ('p[].deep.grid', 'list'),
    ('p[].deep.grid[]', 'list'), ('p[].deep.grid[][]', 'int')) AS x(path, kinds)
), filled AS (
  SELECT key, name, CASE path WHEN '$."["p.q"]"' THEN '$.["p.q"]' WHEN 'p[].deep.W' THEN '$.["p.q"][].deep.' || CASE name WHEN 'before' THEN 'stem' ELSE 'text' END ELSE replace(path, 'p[]', '$.["p.q"][]') END AS path,
    CASE path WHEN '$."["p.q"]"' THEN 'list' WHEN '$.tags' THEN CASE WHEN tagged THEN 'list' ELSE 'empty list' END WHEN '$.tags[]' THEN 'str'
      WHEN 'p[].marks' THEN CASE name WHEN 'before' THEN concat_ws('|', CASE WHEN num THEN 'int' END, CASE WHEN nil THEN 'none' END) ELSE concat_ws('|', CASE WHEN nil2 THEN 'none' END, CASE WHEN str THEN 'str' END) END ELSE kinds END AS kinds
  FROM (SELECT path.*, num, nil, str, nil2, CASE name WHEN 'before' THEN key % 8 = 0 ELSE key % 12 = 0 END AS tagged FROM path JOIN part USING (key))
  WHERE (path <> '$.tags[]' OR tagged) AND CASE name WHEN 'before' THEN key % 28 <> 0 ELSE key % 20 <> 0 END
)"""


@query("SELECT event_id AS key, '$' AS path, 'dict' AS kinds FROM events WHERE props LIKE '{\"k\": %}' UNION ALL SELECT event_id, '$.k', 'int' FROM events WHERE props LIKE '{\"k\": %}'", with_roles=False)
def x39_payload_shape(r: Roles):
    return H.payload_paths(r.table("events"), "event_id", "props").select("key", "path", F.array_join("kinds", "|").alias("kinds"))


@query(f"{_SQL} SELECT key, path, kinds FROM filled WHERE name = 'before'")
def x39_nested_shape(r: Roles):
    return H.payload_paths(_versions(r)[0], "id", "payload").select("key", "path", F.array_join("kinds", "|").alias("kinds"))


@query(f"""{_SQL}, change AS (
  SELECT coalesce(b.key, a.key) AS key, coalesce(b.path, a.path) AS path, CASE WHEN a.key IS NULL THEN 'removed' WHEN b.key IS NULL THEN 'added' ELSE 'kind' END AS change, b.kinds AS before, a.kinds AS after
  FROM (SELECT * FROM filled WHERE name = 'before') b FULL JOIN (SELECT * FROM filled WHERE name = 'after') a ON a.key = b.key AND a.path = b.path WHERE a.kinds IS DISTINCT FROM b.kinds)
SELECT * FROM change c WHERE change = 'kind' OR NOT EXISTS (SELECT 1 FROM change d WHERE d.key = c.key AND d.change = c.change AND d.path <> c.path AND starts_with(c.path, d.path) AND substr(c.path, len(d.path) + 1, 1) IN ('.', '['))
""")
def x39_shape_changes(r: Roles):
    before, after = _versions(r)
    return H.shape_changes(H.payload_paths(before, "id", "payload"), H.payload_paths(after, "id", "payload"))


@query(f"{_SQL} SELECT key, sha256(string_agg(path || ':' || kinds, chr(10) ORDER BY path || ':' || kinds)) AS fingerprint FROM filled WHERE name = 'after' GROUP BY key")
def x39_fingerprint(r: Roles):
    return H.fingerprints(H.payload_paths(_versions(r)[1], "id", "payload"))
