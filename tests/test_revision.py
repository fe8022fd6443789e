"""Revisions of tables, trees of questions, intervals, boards and tagged questions."""

import pytest

from paperglass.operators import ranking as W
from paperglass.operators import reports as R
from paperglass.operators import revision as V
from paperglass.operators import search as S

NESTED = "id int, m map<string,int>, s struct<b:int,a:array<struct<y:string,x:double>>>, t string"
ROWS = [(1, {"k": 1, "j": 2}, (1, [("p", 0.5)]), "é"), (2, None, None, None), (2, None, None, None), (3, {}, (None, []), "")]


def revision(df):
    (row,) = V.dataset_revision(df).collect()
    return row.revision, row.rows


def test_revision_of_any_order(spark):
    df = spark.createDataFrame(ROWS, NESTED)
    name, n = revision(df)
    assert n == 4 and name.startswith("rev-") and len(name) == 36
    other = [(1, {"j": 2, "k": 1}, (1, [("p", 0.5)]), "é"), *ROWS[1:]]
    assert revision(spark.createDataFrame(other[::-1], NESTED).repartition(3)) == (name, n)
    assert revision(df.select("t", "s", "id", "m")) == (name, n)
    turned = df.selectExpr("id", "m", "named_struct('a', transform(s.a, v -> named_struct('x', v.x, 'y', v.y)), 'b', s.b) as q", "t", "s is null as z").selectExpr("id", "m", "if(z, null, q) as s", "t")
    assert revision(turned) == (name, n)


@pytest.mark.parametrize("rows", [ROWS[:3], [*ROWS, ROWS[0]], [(1, {"k": 1, "j": 2}, (1, [("p", 0.25)]), "é"), *ROWS[1:]], [(1, {"k": 1}, (1, [("p", 0.5)]), "é"), *ROWS[1:]], [*ROWS[:3], (3, {}, (None, []), None)], [*ROWS[:3], (3, None, (None, []), "")]])
def test_revision_of_other_rows(spark, rows):
    assert revision(spark.createDataFrame(rows, NESTED))[0] != revision(spark.createDataFrame(ROWS, NESTED))[0]


def test_revision_of_nothing(spark):
    df = spark.createDataFrame(ROWS, NESTED)
    assert revision(df.limit(0)) == (revision(df.where("id > 9"))[0], 0)
    changes = V.revision_changes(df, df.where("id <> 1").unionByName(df.where("id = 3").withColumn("id", df.id + 1))).collect()
    assert sorted((r.change, r.rows_before, r.rows_after) for r in changes) == [("added", None, 1), ("removed", 1, None)]


QUESTION = "id int, paper_id int, parent_id int, number_path string, depth int, display_order int"


@pytest.mark.parametrize(("rows", "found"), [
    ([(1, None, "1", 0, 0), (2, None, "2", 0, 1), (3, 2, "2(a)", 1, 2)], []),
    ([(1, None, "2", 0, 0)], [(1, "numbering_not_start_at_one", "error", "2")]),
    ([(1, None, "1", 0, 0), (2, None, "4", 0, 1)], [(2, "numbering_gap", "error", "1 -> 4")]),
    ([(1, None, "2", 0, 0), (2, None, "1", 0, 1)], [(1, "numbering_not_start_at_one", "error", "2"), (2, "numbering_gap", "error", "2 -> 1")]),
    ([(1, None, "1", 0, 0), (2, None, "A", 0, 1), (3, None, "2", 0, 2)], [(2, "top_level_number_not_integer", "warning", "A")]),
    ([(1, None, None, 0, 0)], [(1, "top_level_number_not_integer", "warning", None)]),
    ([(1, None, "1", 0, 0), (2, None, "1", 0, 1)], [(2, "numbering_gap", "error", "1 -> 1"), (None, "duplicate_number_paths", "error", "1 x2")]),
    ([(1, None, "1", 0, 0), (2, 1, "1(i)", 2, 1)], [(2, "depth_skip", "warning", "0 -> 2")]),
    ([(1, None, "1", 0, 0), (2, 7, "1(a)", 1, 1)], [(2, "parent_missing", "error", "7")]),
    ([], []),
])
def test_findings_of_trees(spark, rows, found):
    df = spark.createDataFrame([(r[0], 5, *r[1:]) for r in rows], QUESTION)
    got = sorted(((r.id, r.rule, r.severity, r.detail) for r in W.tree_findings(df).collect()), key=lambda r: (r[0] is None, r))
    assert got == found


def test_parent_of_another_paper_is_missing(spark):
    df = spark.createDataFrame([(1, 5, None, "1", 0, 0), (2, 6, 1, "1(a)", 1, 0)], QUESTION)
    assert [(r.id, r.rule) for r in W.tree_findings(df).collect()] == [(2, "parent_missing")]


@pytest.mark.parametrize(("intervals", "clusters"), [
    ([(1, 5), (6, 9)], {}), ([(1, 5), (5, 9)], {1: [(1, 5), (5, 9)]}), ([(1, 9), (2, 3), (5, 6), (10, 11)], {1: [(1, 9), (2, 3), (5, 6)]}), ([(4, 4), (4, 4)], {1: [(4, 4), (4, 4)]}),
    ([(1, 2), (5, 8), (6, 7)], {2: [(5, 8), (6, 7)]}), ([(9, 1), (1, 9), (None, 4)], {}),
])
def test_overlapping_intervals(spark, intervals, clusters):
    df = spark.createDataFrame([("k", n, a, b) for n, (a, b) in enumerate(intervals)], "k string, part int, a int, b int")
    got = {}
    for r in W.overlapping_intervals(df, "k", "part", "a", "b").collect():
        got.setdefault(r.cluster, []).append((r.a, r.b))
    assert {c: sorted(v) for c, v in got.items()} == clusters


def test_findings_of_entries(spark):
    rows = [("1", 3), ("1(a)", 1), ("1(a)(i)", 1), ("1(b)", None), ("2", None), ("2(a)", 2), ("3", 1), ("3", 2), ("11", 1)]
    df = spark.createDataFrame([(1, p, m) for p, m in rows], "paper_id int, number_path string, marks int")
    assert {(r.number_path, r.rule, r.n) for r in R.entry_findings(df).collect()} == {
        ("1", "ms_parent_child_marks_ambiguous", 2), ("1(a)", "ms_parent_child_marks_ambiguous", 1), ("1(b)", "ms_marks_missing", 1), ("2", "ms_marks_missing", 1), ("3", "ms_duplicate_numbers", 2),
    }


def test_status_of_boards(spark):
    frame = spark.createDataFrame
    status = R.board_status(
        frame([("a",), ("b",), ("c",)], "board string"), frame([(1, "a", "parsed"), (2, "a", "failed"), (3, "b", None), (4, "z", "failed")], "id int, board string, status string"), frame([(10, 1), (11, 1), (12, 2), (13, None)], "id int, document_id int"),
        frame([(10,), (10,), (10,), (11,), (99,)], "paper_id int"), frame([(1, "error", "open"), (1, "critical", "open"), (1, "warning", "open"), (2, "error", "closed"), (3, "info", "open")], "document_id int, severity string, status string"),
        frame([(1, "open"), (3, "done")], "document_id int, status string"),
    )
    assert sorted(tuple(r) for r in status.collect()) == [("a", 2, 3, 4, 1, 2, 1, 0.5, 1.3333, False), ("b", 1, 0, 0, 0, 0, 0, 0.0, None, True), ("c", 0, 0, 0, 0, 0, 0, None, None, None)]


@pytest.fixture(scope="module")
def tagged(spark):
    papers = spark.createDataFrame([(1, "E", "maths", 2024, "june", "1"), (2, "E", "maths", 2023, "january", "2"), (3, "C", None, 2024, None, "1")], "id int, board string, subject_code string, year int, session string, paper_code string")
    stems = ["Solve  the equation\n  3x + 2 = 11. " + "x" * 250, "Calculate the gradient.", "Sketch the curve.", "Prove it.", "Evaluate.", "Another board's."]
    questions = spark.createDataFrame([(n + 1, p, path, m, o, stems[n]) for n, (p, path, m, o) in enumerate([(1, "1", 4, 0), (1, "2(a)", 2, 1), (1, "3", 6, 2), (1, "4", 5, 3), (2, "1", 3, 0), (3, "1", 4, 0)])], "id int, paper_id int, number_path string, marks int, display_order int, stem_text string")
    nodes = spark.createDataFrame([(1, "U", "E", "Unit 1"), (2, "T", "E", "Topic 1"), (3, "T.2", "E", "Point 1.2"), (4, "T.10", "E", "Point 1.10"), (5, "T", None, "Legacy"), (6, "T.2", "C", "Algebra")], "id int, code string, board string, name string")
    links = spark.createDataFrame([(1, 3, "auto", 0.9, "agent"), (2, 3, "manual", 0.4, None), (2, 3, "auto", 0.3, "x"), (3, 2, "official", 1.0, None), (4, 1, "auto", 0.5, None), (4, 5, "auto", 0.5, None), (5, 4, "auto", 0.8, None), (6, 6, "auto", 0.7, None)], "question_id int, node_id int, source string, confidence double, assigned_by string")
    entries = spark.createDataFrame([(1, 1, "1", "x = 3"), (2, 1, "2", "2x"), (3, 2, "9", "none")], "id int, paper_id int, number_path string, text string")
    official = spark.createDataFrame([], "question_id int, content string")
    return lambda code, **kw: S.tagged_questions(questions, papers, links, code, **{"board": "E", "nodes": nodes, "entries": entries, "official": official, **kw}).orderBy("id").collect()


def test_tagged_question_in_full(tagged):
    first, second = tagged("T.2")
    got = first.asDict()
    line = got.pop("excerpt")
    assert len(line) == 200 and line.startswith("Solve the equation 3x + 2 = 11. x")
    assert got == dict(id=1, year=2024, paper_id=1, confidence=0.9, total=2, number_path="1", marks=4, board="E", subject_code="maths", session="june", paper_code="1", taxonomy_code="T.2", source="auto", assigned_by="agent", taxonomy_name="Point 1.2", answer_mode="exact", answer="x = 3")
    assert (second.id, second.confidence, second.source, second.assigned_by, second.answer_mode, second.answer) == (2, 0.4, "manual", None, "ancestor", "2x")


@pytest.mark.parametrize(("code", "filters", "ids"), [
    ("T.10", {}, [5]), ("T.10", {"year_from": 2024}, []), ("T.10", {"session": "january"}, [5]), ("T.10", {"session": "june"}, []), ("T.10", {"paper_code": "2"}, [5]), ("T.2", {"min_confidence": 0.5}, [1]),
    ("T.2", {"subject_code": "biology"}, []), ("T.2", {"subject_code": "maths"}, [1, 2]), ("T", {}, [3]), ("NOPE", {}, []), ("T.2", {"board": "C"}, [6]), ("T.2", {"board": None}, [1, 2, 6]), ("T.2", {"limit": 1}, [1]), ("T.2", {"limit": 1, "offset": 1}, [2]),
])
def test_tagged_questions_by_filter(tagged, code, filters, ids):
    rows = tagged(code, **filters)
    assert [r.id for r in rows] == ids
    assert {r.total for r in rows} <= {2 if "limit" in filters else len(ids)}


@pytest.mark.parametrize("page", [{"limit": 0}, {"limit": -1}, {"offset": -1}])
def test_tagged_page_is_checked(tagged, page):
    with pytest.raises(ValueError):
        tagged("T.2", **page)
