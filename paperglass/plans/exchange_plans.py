"""Canonical tables from nested files, which are built from the questions: one file a paper, its system by number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperglass.operators import exchange as X
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


def _when(condition: str, value: Column) -> Column:
    return F.when(F.expr(condition), value)


def _raw(r: Roles) -> DataFrame:
    """Files (source_id, system, payload). One of eleven is cut off, one of thirteen is null."""
    every = r.questions()
    p, number, stem = F.col("paper_id"), F.col("number_path"), F.col("stem_text")
    label = F.concat
    top = [F.lit("synthetic").alias("fixture_kind"), F.lit("1").alias("schema_version")]
    none = F.lit(None).cast("string")

    def nested(system: int, part: Column, root) -> DataFrame:
        """A system's papers with their roots, each made from its row and its parts, which are of the same paper."""
        q = every.where(f"paper_id % 4 = {system}")
        parts = q.where("parent_id is not null").select(F.col("parent_id").alias("root_id"), part.alias("part"), F.col("id").alias("at")).groupBy("root_id").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
        roots = q.where("parent_id is null").join(parts, F.col("id") == F.col("root_id"), "left").withColumn("parts", F.transform("parts", lambda x: x["part"]))
        return roots.select("paper_id", F.struct(F.col("id").alias("at"), root.alias("root")).alias("x")).groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["root"]).alias("roots"))

    documents = F.filter(F.array(F.struct(F.lit("qp").alias("role"), label(F.lit(" Q"), p.cast("string")).alias("sha256")), _when("paper_id % 3 <> 0", F.struct(F.lit("ms").alias("role"), none.alias("sha256")))), lambda x: x.isNotNull())
    cie = nested(
        0,
        F.struct(number.alias("question"), stem.alias("text"), "marks", _when("id % 5 = 0", label(F.lit("own "), F.col("id").cast("string"))).alias("answer"), _when("id % 9 = 0", F.lit("sideways")).alias("answer_mode")),
        F.struct(
            number.alias("question"), stem.alias("text"), "marks", _when("id % 8 = 0", label(F.lit("root "), F.col("id").cast("string"))).alias("answer"), _when("id % 16 = 4", F.lit("descendants")).alias("answer_mode"),
            F.array(F.struct((1 + F.col("id") % 3).alias("page"), _when("id % 5 <> 0", F.array(F.lit(1), F.lit(2), F.lit(3), F.col("id").cast("int"))).alias("bbox"), _when("id % 28 = 0", F.lit("other")).alias("document_sha256"))).alias("regions"), "parts",
        ),
    ).select(p, F.to_json(F.struct(
        *top, F.struct(label(F.lit("S"), (p % 7).cast("string")).alias("subject"), (2015 + p % 10).alias("year"), F.lit("june").alias("season"), p.cast("string").alias("paper")).alias("identity"),
        documents.alias("documents"), F.array(F.struct(F.lit(1).alias("page"), F.array(F.lit(0), F.lit(1)).alias("rotation_transform")), F.struct(F.lit(2).alias("page"), F.lit(None).cast("array<int>").alias("rotation_transform"))).alias("pages"),
        F.struct(F.lit("ancestor").alias("default_mode")).alias("answer_resolution"), _when("paper_id % 5 = 0", F.lit(1)).alias("surplus"), F.col("roots").alias("questions"))).alias("payload"))
    session = F.struct(F.lit("june").alias("session"), _when("id % 3 <> 0", F.lit("2020-06-01")).alias("date"), F.lit("unknown").alias("date_unknown_reason"))
    edexcel = nested(
        1,
        F.struct("id"),
        F.struct(number.alias("native_id"), number.alias("unit_code"), F.array(session).alias("sessions"), F.array(F.struct(F.lit("qp").alias("role"), F.col("id").cast("string").alias("sha256"))).alias("documents"),
                 _when("id % 8 = 0", F.array(F.struct(F.lit("ms").alias("document_role"), F.lit(4).alias("page"), F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox")))).alias("regions")),
    ).select(p, F.to_json(F.struct(*top, F.array(F.struct(label(F.lit("E"), p.cast("string")).alias("native_id"), F.lit("ial").alias("qualification_level"), F.array(F.lit("x"), F.lit("y")).alias("alias_ids"), F.col("roots").alias("units"))).alias("subjects"))).alias("payload"))
    image = F.array(F.struct(F.lit("map").alias("role"), F.lit("X").alias("sha256")))
    ielts = nested(
        2,
        F.struct(number.alias("native_id"), stem.alias("prompt"), "marks", _when("id % 3 = 0", F.lit("C")).alias("answer"), _when("id % 7 = 0", image).alias("required_images")),
        F.struct(number.alias("native_id"), stem.alias("prompt"), _when("id % 24 = 0", F.lit(True)).alias("missing_answer"), _when("id % 8 = 0", F.lit("A")).alias("answer"), _when("id % 8 = 0", F.lit("grouped_alternatives")).alias("kind"), _when("id % 8 = 0", F.array(F.lit("B"))).alias("alternative_answers"), F.col("parts").alias("children")),
    ).select(p, F.to_json(F.struct(
        *top, F.lit("r1").alias("dataset_revision"), F.struct(label(F.lit("B"), p.cast("string")).alias("native_id"), _when("paper_id % 8 = 2", F.lit(True)).alias("edition_uncertain")).alias("book"),
        F.array(F.struct(F.lit("scan").alias("role"), _when("paper_id % 3 = 0", F.lit("H")).alias("sha256"))).alias("documents"), F.col("roots").alias("questions"))).alias("payload"))
    kind = F.element_at(F.array(F.lit("single_choice"), F.lit("multiple_choice"), F.lit("table_choice")), (F.col("id") % 4).cast("int"))
    toefl = nested(
        3,
        F.struct(number.alias("native_id"), stem.alias("prompt"), kind.alias("kind"), _when("id % 4 = 1", F.array(F.lit("A"), F.lit("B"))).alias("options"), F.lit("A").alias("answer"), _when("id % 5 = 0", F.array(F.lit("A"), F.lit("B"))).alias("selected")),
        F.struct(number.alias("native_id"), F.when(F.expr("id % 12 = 0"), "jj").otherwise("tpo").alias("source_kind"), label(F.when(F.expr("id % 20 = 0"), "http").otherwise("https"), F.lit("://h.example/detail/read/"), F.col("id").cast("string"), F.lit(".html")).alias("kmf_url"),
                 (F.col("id") % 28 == 0).alias("restricted"), _when("id % 3 <> 0", F.lit("2020-01-01")).alias("exam_date"), F.col("parts").alias("questions")),
    ).select(p, F.to_json(F.struct(*top, F.lit("r2").alias("dataset_revision"), F.col("roots").alias("sets"))).alias("payload"))
    payload = F.when(p % 11 == 5, F.left("payload", F.length("payload") - 1)).when(p % 13 != 6, F.col("payload"))
    return reduce(DataFrame.unionByName, [x.select(p.cast("string").alias("source_id"), F.lit(name).alias("system"), payload.alias("payload")) for name, x in zip(X.SYSTEMS, (cie, edexcel, ielts, toefl), strict=True)])


_OF = """, root AS (SELECT * FROM question WHERE parent_id IS NULL), part AS (SELECT q.*, r.number_path AS root_path, r.id AS root_id FROM question q JOIN root r ON r.id = q.parent_id AND r.paper_id = q.paper_id),
file AS (SELECT DISTINCT paper_id FROM root), good AS (SELECT paper_id FROM file WHERE paper_id % 11 <> 5 AND paper_id % 13 <> 6),
r AS (SELECT * FROM root WHERE paper_id IN (SELECT paper_id FROM good)), p AS (SELECT * FROM part WHERE paper_id IN (SELECT paper_id FROM good)),
stated AS (
  SELECT id, paper_id, 'cie' AS system, number_path, id % 8 = 0 AS has, 'root ' || id AS value, 'exact' AS method FROM r WHERE paper_id % 4 = 0
  UNION ALL SELECT id, paper_id, 'cie', number_path, id % 5 = 0, 'own ' || id, 'exact' FROM p WHERE paper_id % 4 = 0
  UNION ALL SELECT id, paper_id, 'ielts', number_path, id % 8 = 0 AND id % 24 <> 0, 'A', 'grouped' FROM r WHERE paper_id % 4 = 2
  UNION ALL SELECT id, paper_id, 'ielts', number_path, id % 3 = 0, 'C', 'unresolved' FROM p WHERE paper_id % 4 = 2
  UNION ALL SELECT id, paper_id, 'toefl', number_path, true, 'A', CASE WHEN id % 5 = 0 THEN 'in_any_order' ELSE 'exact' END FROM p WHERE paper_id % 4 = 3 AND root_id % 28 <> 0
)"""


@query(f"""{_OF}
SELECT paper_id::VARCHAR AS source_id, 'cie' AS system, 'S' || (paper_id % 7) AS native_code, NULL AS qualification, 'S' || (paper_id % 7) AS name, '' AS aliases, (2015 + paper_id % 10)::VARCHAR AS years FROM good WHERE paper_id % 4 = 0
UNION ALL SELECT paper_id::VARCHAR, 'edexcel', 'E' || paper_id, 'ial', 'E' || paper_id, 'x,y', '' FROM good WHERE paper_id % 4 = 1
UNION ALL SELECT paper_id::VARCHAR, 'ielts', 'B' || paper_id, NULL, 'B' || paper_id, '', '' FROM good WHERE paper_id % 4 = 2
UNION ALL SELECT DISTINCT paper_id::VARCHAR, 'toefl', k, NULL, k, '', '' FROM (SELECT paper_id, CASE WHEN id % 12 = 0 THEN 'jj' ELSE 'tpo' END AS k FROM r WHERE paper_id % 4 = 3)
""")
def s16_canonical_courses(r: Roles):
    return X.normalised(_raw(r), "courses").select("source_id", "system", "native_code", "qualification", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join(F.col("applicable_years").cast("array<string>"), ",").alias("years"))


@query(f"""{_OF}
SELECT paper_id::VARCHAR AS source_id, 'paper' AS kind, NULL AS revision, CASE WHEN paper_id % 3 = 0 THEN 1 ELSE 2 END AS documents,
  '{{"subject":"S' || (paper_id % 7) || '","year":"' || (2015 + paper_id % 10) || '","season":"june","paper":"' || paper_id || '","date":null}}' AS native FROM good WHERE paper_id % 4 = 0
UNION ALL SELECT paper_id::VARCHAR, 'paper', NULL, 1, '{{"qualification_level":"ial","unit_code":"' || number_path || '","paper_code":null}}' FROM r WHERE paper_id % 4 = 1
UNION ALL SELECT paper_id::VARCHAR, 'book', 'r1', 1, '{{"book":"B' || paper_id || '","revision":"r1"}}' FROM good WHERE paper_id % 4 = 2
UNION ALL SELECT paper_id::VARCHAR, 'set', 'r2', 0, '{{"set":"' || number_path || '","source_kind":"' || CASE WHEN id % 12 = 0 THEN 'jj' ELSE 'tpo' END || '"}}' FROM r WHERE paper_id % 4 = 3
""")
def s16_canonical_containers(r: Roles):
    return X.normalised(_raw(r), "containers").select("source_id", "kind", "revision", "documents", "native")


@query(f"""{_OF}
SELECT paper_id::VARCHAR AS source_id, number_path AS native_id, number_path AS path, NULL AS parent_ref, CASE WHEN paper_id % 4 = 2 AND id % 8 = 0 THEN 'single_choice' ELSE 'short_answer' END AS question_type, stem_text AS stem,
  CASE WHEN paper_id % 4 = 0 THEN marks END AS marks, CASE WHEN paper_id % 4 = 2 AND id % 8 = 0 THEN 'A,B' ELSE '' END AS options FROM r WHERE paper_id % 4 IN (0, 2)
UNION ALL SELECT paper_id::VARCHAR, number_path, root_path || '>' || number_path, root_path, 'short_answer', stem_text, marks, '' FROM p WHERE paper_id % 4 IN (0, 2)
UNION ALL SELECT paper_id::VARCHAR, number_path, number_path, NULL, CASE id % 4 WHEN 1 THEN 'single_choice' WHEN 2 THEN 'multiple_choice' ELSE 'table_choice' END, stem_text, NULL, CASE id % 4 WHEN 1 THEN 'A,B' ELSE '' END
  FROM p WHERE paper_id % 4 = 3 AND root_id % 28 <> 0
""")
def s16_canonical_questions(r: Roles):
    return X.normalised(_raw(r), "questions").select("source_id", "native_id", F.array_join("number_path", ">").alias("path"), "parent_ref", "question_type", "stem", "marks", F.array_join("options", ",").alias("options"))


@query(f"""{_OF}
SELECT paper_id::VARCHAR AS source_id, number_path AS question_ref, value AS original_value, CASE method WHEN 'grouped' THEN 'B' WHEN 'in_any_order' THEN 'B' ELSE '' END AS alternatives, NULL AS ordering_rule, method AS matching_method, number_path AS parents
FROM stated WHERE has
UNION ALL SELECT paper_id::VARCHAR, number_path, 'root ' || root_id, '', NULL, 'ancestor', root_path FROM p WHERE paper_id % 4 = 0 AND id % 5 <> 0 AND id % 9 <> 0 AND root_id % 8 = 0
UNION ALL SELECT paper_id::VARCHAR, root_path, NULL, string_agg('own ' || id, ',' ORDER BY id), 'descendant_order', 'descendants', string_agg(number_path, ',' ORDER BY id) FROM p WHERE paper_id % 4 = 0 AND id % 5 = 0 AND root_id % 16 = 4 GROUP BY paper_id, root_path
""")
def s16_canonical_answers(r: Roles):
    return X.normalised(_raw(r), "answers").select("source_id", "question_ref", "original_value", F.array_join("alternatives", ",").alias("alternatives"), "ordering_rule", "matching_method", F.array_join("parent_refs", ",").alias("parents"))


@query(f"""{_OF}
SELECT paper_id::VARCHAR AS source_id, 'qp' AS role, 'q' || paper_id AS sha256, NULL AS media_type FROM good WHERE paper_id % 4 = 0
UNION ALL SELECT paper_id::VARCHAR, 'ms', NULL, NULL FROM good WHERE paper_id % 4 = 0 AND paper_id % 3 <> 0
UNION ALL SELECT paper_id::VARCHAR, 'qp', id::VARCHAR, 'application/pdf' FROM r WHERE paper_id % 4 = 1
UNION ALL SELECT paper_id::VARCHAR, 'map', 'X', NULL FROM p WHERE paper_id % 4 = 2 AND id % 7 = 0
""")
def s16_canonical_assets(r: Roles):
    return X.normalised(_raw(r), "assets").select("source_id", "role", "sha256", "media_type")


@query(f"""{_OF}
SELECT paper_id::VARCHAR AS source_id, number_path AS native_ref, 'qp' AS document_role, CASE WHEN id % 28 = 0 THEN 'other' ELSE 'q' || paper_id END AS document_sha256, CAST(1 + id % 3 AS INTEGER) AS page,
  CASE WHEN id % 5 <> 0 THEN id END AS last_bound, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS turned FROM r WHERE paper_id % 4 = 0
UNION ALL SELECT paper_id::VARCHAR, number_path, 'ms', NULL, 4, 3, 0 FROM r WHERE paper_id % 4 = 1 AND id % 8 = 0
""")
def s16_canonical_regions(r: Roles):
    return X.normalised(_raw(r), "regions").select(
        "source_id", "native_ref", "document_role", "document_sha256", "page", F.try_element_at("bbox", F.lit(4)).cast("long").alias("last_bound"), F.coalesce(F.size("rotation_transform"), F.lit(0)).alias("turned")
    )


@query(f"""{_OF}
, bad AS (
  SELECT paper_id, CASE WHEN paper_id % 11 = 5 THEN 'invalid_json' ELSE CASE WHEN paper_id % 4 < 2 THEN 'missing_index' ELSE 'missing_source' END END AS code, NULL AS ref FROM file WHERE paper_id NOT IN (SELECT paper_id FROM good)
  UNION ALL SELECT paper_id, 'unexpected_member', NULL FROM good WHERE paper_id % 4 = 0 AND paper_id % 5 = 0
  UNION ALL SELECT paper_id, 'missing_ms', NULL FROM good WHERE paper_id % 4 = 0 AND paper_id % 3 = 0
  UNION ALL SELECT paper_id, 'unknown_date', NULL FROM good WHERE paper_id % 4 = 0
  UNION ALL SELECT paper_id, 'unresolved_answer_mode', number_path FROM p WHERE paper_id % 4 = 0 AND id % 9 = 0
  UNION ALL SELECT paper_id, 'missing_answer', number_path FROM p WHERE paper_id % 4 = 0 AND id % 9 <> 0 AND id % 5 <> 0 AND root_id % 8 <> 0
  UNION ALL SELECT paper_id, 'missing_answer', number_path FROM r WHERE paper_id % 4 = 0 AND id % 8 <> 0 AND NOT (id % 16 = 4 AND EXISTS (SELECT 1 FROM p WHERE p.root_id = r.id AND p.id % 5 = 0))
  UNION ALL SELECT paper_id, 'hash_conflict', number_path FROM r WHERE paper_id % 4 = 0 AND id % 28 = 0
  UNION ALL SELECT paper_id, 'missing_region_bbox', number_path FROM r WHERE paper_id % 4 = 0 AND id % 5 = 0
  UNION ALL SELECT paper_id, 'unknown_rotation', number_path FROM r WHERE paper_id % 4 = 0 AND id % 3 = 2
  UNION ALL SELECT paper_id, 'missing_ms', NULL FROM r WHERE paper_id % 4 = 1
  UNION ALL SELECT paper_id, 'unknown_date', NULL FROM r WHERE paper_id % 4 = 1 AND id % 3 = 0
  UNION ALL SELECT paper_id, 'missing_document_role', number_path FROM r WHERE paper_id % 4 = 1 AND id % 8 = 0
  UNION ALL SELECT paper_id, 'unresolved_edition', 'B' || paper_id FROM good WHERE paper_id % 8 = 2
  UNION ALL SELECT paper_id, 'missing_document_hash', 'scan' FROM good WHERE paper_id % 4 = 2 AND paper_id % 3 <> 0
  UNION ALL SELECT paper_id, 'missing_answer_slot', number_path FROM r WHERE paper_id % 4 = 2 AND id % 24 = 0
  UNION ALL SELECT paper_id, 'missing_asset', number_path FROM p WHERE paper_id % 4 = 2 AND id % 7 = 0
  UNION ALL SELECT paper_id, 'invalid_kmf_url', number_path FROM r WHERE paper_id % 4 = 3 AND id % 20 = 0
  UNION ALL SELECT paper_id, 'restricted_source', number_path FROM r WHERE paper_id % 4 = 3 AND id % 28 = 0
  UNION ALL SELECT paper_id, 'unknown_date', number_path FROM r WHERE paper_id % 4 = 3 AND id % 3 = 0
  UNION ALL SELECT paper_id, 'missing_options', number_path FROM p WHERE paper_id % 4 = 3 AND id % 4 = 2 AND root_id % 28 <> 0
  UNION ALL SELECT paper_id, 'missing_table', number_path FROM p WHERE paper_id % 4 = 3 AND id % 4 = 3 AND root_id % 28 <> 0
)
SELECT paper_id::VARCHAR AS source_id, code, ref AS native_ref, count(*) AS n FROM bad GROUP BY ALL
""")
def s16_canonical_problems(r: Roles):
    return X.normalised(_raw(r), "problems").groupBy("source_id", "code", "native_ref").agg(F.count("*").alias("n"))
