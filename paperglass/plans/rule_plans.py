"""Rules of answers, transcripts, document types, overrides and completeness, on inputs that show each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperglass.functions import papers as P
from paperglass.functions import text as X
from paperglass.operators import answers as A
from paperglass.operators import coverage as C
from paperglass.operators import listings as L
from paperglass.operators import relations as J
from paperglass.operators import reports as R
from paperglass.plans.registry import query
from paperglass.plans.roles import Roles


def _case(values: list[str | None], by: str):
    """The value at column % len(values)."""
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(F.col(by) % len(values) == k, F.lit(v)).otherwise(out)
    return out


_PHRASES = ["Mark\nScheme", "Question Paper. Answer ALL questions [ 3 ]", "SPECIMEN question paper for examination from 2020", "Examiner Report: candidates often did well", "insert", "transcript of the listening test (M1)", "scheme of work"]
_ENDS = [" and more words of this first page here", " Maximum Mark: 80 partial marks here for all of them", " x"]


def _types_sql() -> str:
    page = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(v.replace("\n", "' || chr(10) || '") for v in _PHRASES)) + " END || CASE p_size % 3 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_ENDS)) + " END"
    sums = [" + ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in own.items()) for own in P.TYPE_SIGNS.values()]
    scores = ", ".join(f"{s} AS s{k}" for k, s in enumerate(sums))
    columns = ", ".join(f"s{k}" for k in range(len(sums)))
    first = "CASE " + " ".join(f"WHEN s{k} = b THEN '{name}'" for k, name in enumerate(P.TYPE_SIGNS)) + " END"
    return f"""
WITH page AS (SELECT p_partkey, regexp_replace({page}, '\\s+', ' ', 'g') AS t FROM part), s AS (SELECT p_partkey, t, {scores} FROM page),
b AS (SELECT *, greatest({columns}) AS b, list_sort([{columns}], 'DESC')[2] AS r, len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) < 5 AS poor FROM s)
SELECT p_partkey, CASE WHEN NOT poor AND b > 0 THEN {first} END AS type, CASE WHEN NOT poor AND b > 0 THEN round(least(1::DOUBLE, b / 1.5::DOUBLE) * b / (b + r), 4) ELSE 0 END AS confidence,
  CASE WHEN poor THEN 'text_layer_unreadable' END AS error FROM b
"""


@query(_types_sql(), with_roles=False)
def x12_content_type(r: Roles):
    page = F.concat(_case(_PHRASES, "p_partkey"), _case(_ENDS, "p_size"))
    return r.table("part").select("p_partkey", P.content_type(page).alias("t")).select("p_partkey", "t.type", "t.confidence", "t.error")


@query("""
WITH l AS (SELECT p_partkey, [NULL, 'question_paper', 'specimen_paper', 'mark_scheme', 'specimen_mark_scheme'][1 + p_partkey % 5] AS a, [NULL, 'question_paper', 'mark_scheme'][1 + p_size % 3] AS b, [0.5, 0.95][1 + p_partkey % 2]::DOUBLE AS c FROM part)
SELECT p_partkey, coalesce(a, b, 'other') AS type,
  CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL THEN 'label' WHEN a IS NULL THEN 'content' WHEN a = b OR a = 'specimen_' || replace(b, 'question_', '') THEN 'label+content' ELSE 'conflict' END AS method,
  CAST(CASE WHEN a IS NULL AND b IS NULL THEN 0.2 WHEN b IS NULL THEN 0.6 WHEN a IS NULL THEN least(0.75, c) WHEN a = b OR a = 'specimen_' || replace(b, 'question_', '') THEN greatest(0.9, c) ELSE 0.35 END AS DOUBLE) AS confidence FROM l
""", with_roles=False)
def x13_reconcile_type(r: Roles):
    label = _case([None, "question_paper", "specimen_paper", "mark_scheme", "specimen_mark_scheme"], "p_partkey")
    content = _case([None, "question_paper", "mark_scheme"], "p_size")
    t = P.reconcile_type(label, content, F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(0.95))
    return r.table("part").select("p_partkey", t["type"].alias("type"), t["method"].alias("method"), t["confidence"].alias("confidence"))


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS n_m, CAST(1 + p_size % 2 AS BIGINT) AS n_a, CAST(0 AS BIGINT) AS n_b, p_size % 5 = 0 AS ecf,
  CASE p_partkey % 3 WHEN 0 THEN ['4'] WHEN 1 THEN ['x = 2', 'the same'] ELSE ['1', '2', '3', '4', '5', '6'] END AS acceptable FROM part
""", with_roles=False)
def x19_mark_codes(r: Roles):
    answer = _case(["M1 for method M oe 4; ", "M2 accept x = 2; or the same. ", "M1 or 1; or 2; or 3; or 4; or 5; or 6; or 7; "], "p_partkey")
    guidance = F.concat(F.when(F.col("p_size") % 2 == 1, "A1 A").otherwise("A1"), F.when(F.col("p_size") % 5 == 0, ", ft").otherwise(", left"))
    c = X.mark_codes(answer, guidance)
    return r.table("part").select("p_partkey", *[c[k].alias(k) for k in ("n_m", "n_a", "n_b", "ecf", "acceptable")])


@query("SELECT p_partkey, '\"' || lower(p_name) || '''s\" - x1.' AS answer FROM part", with_roles=False)
def x21_normalize_answer(r: Roles):
    return r.table("part").select("p_partkey", X.normalize_answer(F.concat(F.lit("  “"), F.upper("p_name"), F.lit("’S”  –\t Ｘ１. "))).alias("answer"))


@query("""
SELECT p_partkey, list_sort(list_distinct(CASE p_partkey % 4 WHEN 0 THEN ['the ' || p_name, p_type, p_name, '(the) ' || p_name || ' / ' || p_type] WHEN 1 THEN ['1/2/2020'] WHEN 2 THEN
  ['a in ' || p_name, 'a at ' || p_name, 'a ' || p_name, 'a (in/at) ' || p_name] ELSE ['a b c', 'a b', 'a c', 'a', 'b c', 'b', 'c', '(a) (b) (c)'] END)) AS variants FROM part
""", with_roles=False)
def x22_expand_variants(r: Roles):
    m = F.col("p_partkey") % 4
    text = F.when(m == 0, F.concat(F.lit("(the) "), "p_name", F.lit(" / "), "p_type")).when(m == 1, "1/2/2020").when(m == 2, F.concat(F.lit("a (in/at) "), "p_name")).otherwise("(a) (b) (c)")
    return r.table("part").select("p_partkey", X.variants(text).alias("variants"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST([12, 20, 90, 1000][1 + p_size % 4] AS VARCHAR) WHEN 1 THEN '12' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 2 THEN CAST(p_size AS VARCHAR) END AS number,
  CASE WHEN p_partkey % 4 = 3 AND p_size <= 31 THEN '2020-03-' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS date FROM part
""", with_roles=False)
def x23_number_forms(r: Roles):
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    word = _case(["Twelve", " twenty", "ninety", "thousand"], "p_size")
    text = F.when(m == 0, word).when(m == 1, F.concat(F.lit("12,"), F.lpad(size, 3, "0"))).when(m == 2, F.concat(F.lit("00"), size)).otherwise(F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(".3.2020"))).otherwise(F.concat(F.lit("2020/03/"), size)))
    return r.table("part").select("p_partkey", X.number_form(text).alias("number"), X.date_form(text).alias("date"))


@query("SELECT p_partkey, [NULL, 'tfng', 'ynng', NULL][1 + p_size % 4] AS family, ['maybe', 'true', 'no', 'ng'][1 + p_size % 4] AS choice FROM part", with_roles=False)
def x24_choice_families(r: Roles):
    family = X.choice_family(_case(["Complete the notes", "Write True, False or Not Given", "yes / no / not given", "write truer words"], "p_size"))
    return r.table("part").select("p_partkey", family.alias("family"), X.normalize_choice(_case(["Maybe", "T", " N ", "NG"], "p_size"), family).alias("choice"))


_PAIRS = [("", "x", "empty"), ("Red  Car", "red car", "exact"), ("T", "TRUE", "exact"), ("e", "every", "single_letter_mismatch"), ("(the) beach", "Beach / sea", "variant"), ("colour", "color", "allowed_variant"), ("six", "6", "number_word"), ("1.2.2020", "2020-02-01", "date_variant"), ("cat", "cats", "mismatch"), ("1/2", "2", "mismatch")]


@query(f"SELECT p_partkey, {[p[2] for p in _PAIRS]}[1 + p_partkey % {len(_PAIRS)}] AS reason, {[p[2] in ('exact', 'variant', 'allowed_variant', 'number_word', 'date_variant') for p in _PAIRS]}[1 + p_partkey % {len(_PAIRS)}] AS \"equal\" FROM part", with_roles=False)
def x25_compare_answers(r: Roles):
    a, b = (_case([p[k] for p in _PAIRS], "p_partkey") for k in (0, 1))
    family = F.when(F.col("p_partkey") % len(_PAIRS) == 2, "tfng")
    c = X.compare_answers(a, b, family, allowed_a=F.array(F.lit("Color")), number_word=True, dates=True)
    return r.table("part").select("p_partkey", c["reason"].alias("reason"), c["equal"].alias("equal"))


_GROUPS = [  # submitted, accepted, required, ordered, reuse, scoring, reason
    (["B ", "a"], [["a", "b"], ["c"]], 2, False, False, None, "set_match"), (["b", "b"], [["a", "b"]], 2, False, False, None, "set_mismatch"), (["b", "b"], [["b", "b"]], 2, False, True, None, "set_match"),
    (["c"], [["a", "b"], ["c", "d"]], 2, False, False, "any_of", "any_of_hit"), (["e"], [["a", "b"], ["c", "d"]], 1, False, False, "any_of", "any_of_miss"), (["a"], [["a", "b"]], 2, False, False, None, "count_mismatch"),
    (["a", "b"], [["b", "a"], ["A", "B"]], 2, True, False, None, "ordered_match"), (["a", "b"], [["b", "a"]], None, True, False, None, "set_mismatch"), (["a", "b"], [["b", "a"]], None, False, True, "exact_set", "set_match"),
]


@query(f"SELECT p_partkey, {[g[6] for g in _GROUPS]}[1 + p_partkey % {len(_GROUPS)}] AS reason, {[g[6] in ('any_of_hit', 'ordered_match', 'set_match') for g in _GROUPS]}[1 + p_partkey % {len(_GROUPS)}] AS pass FROM part", with_roles=False)
def a28_group_grading(r: Roles):
    cases = r.spark.createDataFrame([(k, *g[:6]) for k, g in enumerate(_GROUPS)], "k long, submitted array<string>, accepted array<array<string>>, required int, ordered boolean, reuse boolean, scoring string")
    g = A.grade_group(*(F.col(c) for c in ("submitted", "accepted", "required", "ordered", "reuse", "scoring")))
    rows = r.table("part").select("p_partkey", (F.col("p_partkey") % len(_GROUPS)).alias("k")).join(cases, "k")
    return rows.select("p_partkey", g["reason"].alias("reason"), g["pass"].alias("pass"))


@query("""
WITH t AS (SELECT doc_id, replace(text || ' C:\\tmp\\x.txt "/home/u/a b" \\\\host\\share tok-42', 'tok-42', '<secret>') AS t FROM documents)
SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(t, '\\\\\\\\[^\\s''"]+', '<path>', 'g'), '(?:[A-Za-z]:[\\\\/]|/)[^\\s''"]+', '<path>', 'g'), '\\s+', ' ', 'g')), 500) AS redacted FROM t
""", with_roles=False)
def x38_redact(r: Roles):
    text = F.concat("text", F.lit(' C:\\tmp\\x.txt "/home/u/a b" \\\\host\\share tok-42'))
    return r.table("documents").select("doc_id", X.redact(text, ("tok-42",)).alias("redacted"))


@query("""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words, regexp_matches(t, '(?:\\.\\.\\.|…)\\s*$') AS tail_ellipsis,
  regexp_matches(t, '(?i)<(?:!doctype|html|head|body|script|div|p|meta)\\b') AS html_like, regexp_matches(t, '(?i)adsbygoogle|document\\.createElement') OR regexp_matches(t, '(?im)^Advertisements$') AS ad_like FROM t
""", with_roles=False)
def x30_text_quality(r: Roles):
    q = X.text_quality(F.col("text"))
    return r.table("documents").select("doc_id", *[q[k].alias(k) for k in ("chars", "words", "tail_ellipsis", "html_like", "ad_like")])


@query("""
SELECT item_id, ['same', 'extends', 'extended_by', 'differ'][1 + item_id % 4] AS tail, ['same', 'same', 'same', 'differ'][1 + item_id % 4] AS head FROM benchmark WHERE len(regexp_split_to_array(text, '[^A-Za-z0-9'']+')) >= 45
""", with_roles=False)
def x31_head_tail(r: Roles):
    k = F.col("item_id") % 4
    words = P.transcript_words(F.col("text"))
    most = F.slice(words, F.lit(1), F.size(words) - 20)
    a, b = F.when(k == 2, most).otherwise(words), F.when(k == 1, most).when(k == 3, F.reverse(words)).otherwise(words)
    rows = r.table("benchmark").where("size(split(text, \"[^A-Za-z0-9']+\")) >= 45").select("item_id", a.alias("a"), b.alias("b"))
    return rows.select("item_id", P.tail_relation(F.col("a"), F.col("b")).alias("tail"), P.head_relation(F.col("a"), F.col("b")).alias("head"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') AND NOT contains(p_name, 'ring red') THEN 'G' WHEN contains(p_name, 'red') THEN 'R' END AS region FROM part", with_roles=False)
def x34_regions(r: Roles):
    """`ring` is longer than `red` and counts first; the longest of all, `ring red`, means R."""
    return r.table("part").select("p_partkey", P.region_of(F.col("p_name"), {"red": "R", "ring": "G", "ring red": "R"}).alias("region"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderkey % 3 AS e FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'forbidden_basis' WHEN 1 THEN 'unrecognised_basis' WHEN 2 THEN 'no_change' WHEN 3 THEN 'not_in_table'
  WHEN 4 THEN CASE WHEN e = 0 THEN 'evidence_not_accepted' ELSE 'permitted' END WHEN 5 THEN CASE WHEN e = 0 THEN 'evidence_not_accepted' ELSE 'requirement_not_satisfied' END
  WHEN 6 THEN CASE WHEN e = 0 THEN 'evidence_not_accepted' ELSE 'permitted' END ELSE 'permitted' END AS reason,
  k = 2 OR k = 7 OR (k IN (4, 6) AND e <> 0) AS allowed FROM c
""", with_roles=False)
def x37_transitions(r: Roles):
    k, id_ = F.col("o_orderkey") % 8, F.col("o_orderkey")
    changes = [("content", "unknown", "missing"), ("content", "unknown", "missing"), ("assets", "x", "x"), ("content", "complete", "missing"), ("answer_verification", "unverified", "source_verified"), ("content", "partial", "complete"), ("audio_alignment", "unverified", "verified"), ("content", "missing", "partial")]
    d, a, b = (_case([c[n] for c in changes], "o_orderkey") for n in range(3))
    label = _case(["synthetic_fixture", "isolated_real_data", "full_source_validation"], "o_orderkey")
    label = F.when((k == 5) & (id_ % 3 == 0), "static_inspection").otherwise(label)
    context = F.when(k == 6, F.array(F.lit("alignment_evidence_present"))).otherwise(F.array().cast("array<string>"))
    basis = F.when(k == 0, "row_number").when(k == 1, "a hunch")
    rows = r.table("orders").select(id_.alias("id"), d.alias("dimension"), a.alias("before"), b.alias("after"), label.alias("label"), context.alias("context"), basis.alias("basis"))
    return C.transitions(rows, C.transition_table(r.spark)).select(F.col("id").alias("o_orderkey"), "reason", "allowed")


@query("""
RECURSIVE p AS (SELECT unit, position, row_number() OVER (PARTITION BY unit ORDER BY position) AS n, CASE WHEN major <> topic THEN topic || '.' || minor ELSE major || '.' || minor END AS c
  FROM (SELECT p_brand AS unit, p_partkey AS position, CAST(p_size % 3 AS VARCHAR) AS topic, CAST(p_partkey % 4 AS VARCHAR) AS major, CAST(p_size % 5 AS VARCHAR) AS minor FROM part)),
w AS (SELECT DISTINCT unit, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS repaired FROM p
  UNION ALL SELECT unit, n, list_append(seen, new), new FROM (SELECT w.unit, p.n, seen, CASE WHEN NOT list_contains(seen, c) THEN c ELSE split_part(c, '.', 1) || '.' ||
    CAST(list_filter(range(CAST(split_part(c, '.', 2) AS BIGINT) + 1, CAST(split_part(c, '.', 2) AS BIGINT) + 2 + len(seen)), lambda k: NOT list_contains(seen, split_part(c, '.', 1) || '.' || CAST(k AS VARCHAR)))[1] AS VARCHAR) END AS new
    FROM w JOIN p ON p.unit = w.unit AND p.n = w.n + 1))
SELECT w.unit, position, repaired FROM w JOIN p ON p.unit = w.unit AND p.n = w.n
""".replace("RECURSIVE", "WITH RECURSIVE", 1), with_roles=False)
def w16_code_repairs(r: Roles):
    part = lambda c, n: (F.col(c) % n).cast("string")
    rows = r.table("part").select(F.col("p_brand").alias("unit"), part("p_size", 3).alias("topic"), F.concat_ws(".", part("p_partkey", 4), part("p_size", 5)).alias("code"), F.col("p_partkey").cast("long").alias("position"))
    return L.code_repairs(rows).select("unit", "position", "repaired")


@query("""
SELECT item_id, ['ok', 'ok', 'ok', 'review', 'missing', 'partial'][1 + item_id % 6] AS status, ['a', 'a', 'b', 'a', NULL, 'a'][1 + item_id % 6] AS source,
  ['cross_source_agreement', 'single_source_signals', 'cross_source_prefix_agreement', NULL, NULL, NULL][1 + item_id % 6] AS complete_basis FROM benchmark WHERE length(text) >= 240 AND len(regexp_split_to_array(text, '[^A-Za-z0-9'']+')) >= 30
""", with_roles=False)
def w17_transcript_choice(r: Roles):
    k, text = F.col("item_id") % 6, F.regexp_replace("text", r"[^\x20-\x7E]|[<>]", "x")
    items = r.table("benchmark").where("length(text) >= 240 and size(split(text, \"[^A-Za-z0-9']+\")) >= 30").select("item_id", k.alias("k"), F.concat(text, F.lit(" end of it.")).alias("text"))
    cut = F.concat(F.substring("text", F.lit(1), F.length("text") - 40), F.lit("..."))
    page = F.concat(F.lit("<html><body>"), "text")
    a = items.select("item_id", F.lit("a").alias("source"), F.when(F.col("k").isin(2, 5), cut).when(F.col("k") == 4, page).otherwise(F.col("text")).alias("text"))
    other = F.when(F.col("k") == 3, F.reverse(F.substring("text", F.lit(1), F.length("text") - 20))).otherwise(F.col("text"))
    b = items.where("k in (0, 2, 3)").select("item_id", F.lit("b").alias("source"), other.alias("text"))
    rows = a.unionByName(b).withColumn("identity_ok", F.lit(True)).withColumn("duration_sec", F.lit(None).cast("double"))
    return L.transcript_choice(rows, ["item_id"])[0].select("item_id", "status", "source", "complete_basis")


@query("""
SELECT DISTINCT l_orderkey AS paper_id, l_orderkey || chr(97 + CAST(l_linenumber % 2 AS INTEGER)) AS second, l_orderkey || chr(97 + CAST(l_linenumber % 2 AS INTEGER)) || l_linenumber AS third FROM lineitem
""", with_roles=False)
def a36_paper_tree(r: Roles):
    paper, n = F.col("l_orderkey"), F.col("l_linenumber")
    second = F.concat(paper.cast("string"), F.when(n % 2 == 0, "a").otherwise("b"))
    li = r.table("lineitem").select(paper.alias("paper_id"), n.cast("int").alias("n"), paper.cast("string").alias("first"), second.alias("second"), F.concat(second, n.cast("string")).alias("third"))
    row = lambda df, id_, parent, order, path: df.select("paper_id", F.col(id_).alias("id"), parent.alias("parent_id"), order.alias("display_order"), F.lit(path).alias("number_path")).distinct()
    q = row(li, "first", F.lit(None).cast("string"), F.lit(0), "1").unionByName(row(li, "second", F.col("first"), F.col("n") % 2, "1(a)")).unionByName(row(li, "third", F.col("second"), F.col("n"), "1(a)(i)"))
    tree = R.paper_tree(q, 2).select("paper_id", F.explode("tree.children").alias("c")).select("paper_id", F.explode("c").alias("c"))
    return tree.select("paper_id", F.col("c.id").alias("second"), F.explode("c.children").alias("d")).select("paper_id", "second", F.col("d.id").alias("third"))


@query("""
, a AS (SELECT id, id % 28 <> 0 AS fits, CASE WHEN id % 14 = 0 THEN '99' ELSE '7' END AS value, CASE WHEN id % 21 = 0 THEN '1' ELSE CAST(marks AS VARCHAR) END AS base FROM question WHERE id % 7 = 0 AND id % 11 <> 0),
s1 AS (SELECT q.id, CASE WHEN a.fits AND a.base IS NOT DISTINCT FROM CAST(marks AS VARCHAR) THEN a.value ELSE CAST(marks AS VARCHAR) END AS m,
  coalesce(a.fits AND a.base IS NOT DISTINCT FROM CAST(marks AS VARCHAR), false) AS over1, a.id IS NOT NULL AND NOT (a.fits AND a.base IS NOT DISTINCT FROM CAST(marks AS VARCHAR)) AS con1 FROM question q LEFT JOIN a ON a.id = q.id)
SELECT id, CASE WHEN id % 35 = 0 AND m = '99' THEN '100' ELSE m END AS marks, over1 OR (id % 35 = 0 AND coalesce(m = '99', false)) AS overridden, con1 OR (id % 35 = 0 AND NOT coalesce(m = '99', false)) AS conflict FROM s1
""")
def j9_apply_overrides(r: Roles):
    """Two overrides of one field in order, others of another field, inactive ones and ones of another version."""
    q = r.questions().select("id", F.col("marks").cast("string").alias("marks"))
    k = F.col("target_id")
    base = q.select(F.col("id").alias("target_id"), F.col("marks").alias("current")).withColumn("target_type", F.lit("question"))
    every = F.array(F.lit("*"))
    first = base.where("target_id % 7 = 0").select(
        (2 * k).alias("id"), "target_type", "target_id", F.lit("marks").alias("field_path"), F.when(k % 14 == 0, "99").otherwise("7").alias("value"), F.when(k % 21 == 0, "1").otherwise(F.col("current")).alias("source_value"),
        F.when(k % 28 == 0, F.array(F.lit("v9"))).when(k % 2 == 0, every).otherwise(F.array(F.lit("v1"), F.lit("v2"))).alias("applies_to"), (k % 11 != 0).alias("active"),
    )
    second = base.where("target_id % 35 = 0").select((2 * k + 1).alias("id"), "target_type", "target_id", F.lit("marks").alias("field_path"), F.lit("100").alias("value"), F.lit("99").alias("source_value"), F.lit(None).cast("array<string>").alias("applies_to"), F.lit(True).alias("active"))
    other = base.where("target_id % 3 = 0").select((2 * k + 2).alias("id"), "target_type", "target_id", F.lit("stem").alias("field_path"), F.lit("x").alias("value"), F.col("current").alias("source_value"), every.alias("applies_to"), F.lit(True).alias("active"))
    return J.apply_overrides(q, first.unionByName(second).unionByName(other), "marks", "v2")


@query("""
, own AS (SELECT id, parent_id, id % 6 <> 3 AS known, CASE WHEN parent_id IS NULL AND id % 7 = 0 THEN 3 END AS expected,
    CASE id % 6 WHEN 0 THEN ['options'] WHEN 1 THEN ['table_columns', 'table_rows', 'table_answer_structure'] WHEN 2 THEN ['matching_lists'] WHEN 3 THEN ['native_shape_known'] WHEN 4 THEN ['diagram_asset', 'diagram_labels'] ELSE ['stem'] END AS need,
    CASE id % 3 WHEN 0 THEN ['options', 'matching_lists', 'table_rows', 'stem'] WHEN 1 THEN ['diagram_asset', 'matching_lists'] ELSE ['matching_lists'] END AS has,
    CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS asset, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 1 ELSE 0 END AS asset_ok FROM question),
n AS (SELECT *, len(need) + asset AS n, len(list_intersect(need, has)) + asset_ok AS ok FROM own),
part AS (SELECT parent_id, count(*) AS parts, count(*) FILTER (known AND n = ok) AS good FROM n WHERE parent_id IS NOT NULL GROUP BY 1),
f AS (SELECT n.id, known, n + coalesce(parts, 0) + CASE WHEN expected IS NULL THEN 0 ELSE 1 END AS r, ok + coalesce(good, 0) + CASE WHEN expected = coalesce(parts, 0) THEN 1 ELSE 0 END AS s FROM n LEFT JOIN part ON part.parent_id = n.id)
SELECT id, CAST(r AS BIGINT) AS requirements, CAST(s AS BIGINT) AS satisfied, CASE WHEN known THEN round(100.0 * s / r, 2) END AS percentage, CASE WHEN NOT known THEN 'unknown' WHEN s = r THEN 'complete' WHEN s = 0 THEN 'missing' ELSE 'partial' END AS status FROM f
""")
def a22_completeness(r: Roles):
    k = F.col("id")
    kind = _case(["single_choice", "table_choice", "matching", "unknown", "diagram_labels", "essay"], "id")
    names = lambda *v: F.array(*[F.lit(x) for x in v])
    has = F.when(k % 3 == 0, names("options", "matching_lists", "table_rows", "stem")).when(k % 3 == 1, names("diagram_asset", "matching_lists")).otherwise(names("matching_lists"))
    asset = F.array(F.struct((k % 5 == 0).alias("required"), (k % 2 == 0).alias("present")))
    q = r.questions().select("id", "parent_id", kind.alias("question_type"), has.alias("has"), F.when(k % 5 <= 1, asset).alias("assets"), F.when(F.col("parent_id").isNull() & (k % 7 == 0), 3).alias("expected_children"))
    return C.completeness(q, 2).drop("parent_id")


def _snapshot_sql(question: str, entry: str) -> str:
    return f"""SELECT q.paper_id, f.field, CASE f.field WHEN 'questions' THEN q.questions WHEN 'roots' THEN q.roots WHEN 'marks_sum' THEN q.marks WHEN 'duplicate_paths' THEN q.twice
  WHEN 'assets' THEN coalesce(a.n, 0) WHEN 'mark_scheme_entries' THEN coalesce(e.n, 0) ELSE coalesce(e.linked, 0) END AS v
  FROM (SELECT paper_id, count(*) AS questions, count(*) FILTER (parent_id IS NULL) AS roots, coalesce(sum(marks) FILTER (parent_id IS NULL), 0) AS marks, count(number_path) - count(DISTINCT number_path) AS twice FROM question WHERE {question} GROUP BY 1) q
  LEFT JOIN (SELECT paper_id, count(*) AS n, count(*) FILTER (id % 2 = 0) AS linked FROM entry WHERE {entry} GROUP BY 1) e USING (paper_id)
  LEFT JOIN (SELECT paper_id, count(*) AS n FROM asset JOIN question ON question.id = asset.question_id WHERE {question} GROUP BY 1) a USING (paper_id)
  CROSS JOIN (SELECT unnest(['questions', 'roots', 'marks_sum', 'assets', 'mark_scheme_entries', 'entries_linked', 'duplicate_paths']) AS field) f"""


@query(f"""
, b AS ({_snapshot_sql("true", "true")}), a AS ({_snapshot_sql("id % 13 <> 0 AND paper_id % 10 <> 3", "id % 5 <> 0 AND paper_id % 10 <> 4")}),
j AS (SELECT coalesce(b.paper_id, a.paper_id) AS paper_id, coalesce(b.field, a.field) AS field, coalesce(b.v, 0) AS before, coalesce(a.v, 0) AS after FROM b FULL JOIN a ON a.paper_id = b.paper_id AND a.field = b.field)
SELECT paper_id, field, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CASE WHEN field IN ('entries_linked', 'questions') AND before > 0 AND after = 0 THEN field || '_to_zero'
  WHEN field <> 'duplicate_paths' AND before > 0 AND after < before * (1 - CASE WHEN field = 'assets' THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END) THEN 'dropped' WHEN field = 'duplicate_paths' AND after > before THEN 'duplicates_up' END AS reason
FROM j WHERE before <> after
""")
def a12_snapshot_diff(r: Roles):
    """Documents that vanish, entries that lose all links, and smaller falls."""
    entries = r.entries().withColumn("question_id", F.when(F.col("id") % 2 == 0, F.col("id")))
    before = R.snapshot(r.questions(), entries, r.assets())
    after = R.snapshot(r.questions().where("id % 13 <> 0 and paper_id % 10 <> 3"), entries.where("id % 5 <> 0 and paper_id % 10 <> 4"), r.assets())
    return R.snapshot_diff(before, after).select("paper_id", "field", "before", "after", "reason")
