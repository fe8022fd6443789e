"""Canonical tables from nested files of four systems, on hand-made files."""

import json

import pytest

from paperglass.operators import exchange as X

TOP = {"fixture_kind": "synthetic", "schema_version": 1}
CIE = {
    **TOP,
    "identity": {"subject": "9700", "year": 2020, "season": "june", "paper": "1", "subject_alias": "bio"},
    "documents": [{"role": "qp", "sha256": " ABC "}],
    "pages": [{"page": 1, "rotation_transform": [1, 0]}],
    "answer_resolution": {"default_mode": "ancestor"},
    "odd": 1,
    "questions": [
        {
            "question": 1, "text": "s", "answer": "42", "marks": 4,
            "regions": [{"page": 1, "bbox": [1, 2, 3, 4]}, {"page": 2, "bbox": [1, "x"], "document_sha256": "dd"}],
            "parts": [
                {"question": "1a", "parts": [{"question": "i", "answer_mode": "what"}, {"question": "ii", "answer_mode": "exact"}, {"question": "iii", "answer_mode": "none"}]},
                {"question": "1b", "answer_mode": "descendants", "parts": [{"question": "p", "answer": "x"}, {"question": "q", "answer": 7}]},
            ],
        },
        "bad",
        {"text": "no id"},
    ],
}
EDEXCEL = {**TOP, "subjects": [{"native_id": "S", "title": "T", "qualification_level": "ial", "units": [
    {"native_id": "u", "unit_code": "U1", "sessions": [{"session": "j", "date": None}, {"session": "k", "date": "2020"}], "documents": [{"role": "ms", "sha256": "E"}], "regions": [{"page": 3}]}]}]}
IELTS = {**TOP, "dataset_revision": "r1", "book": {"native_id": "b1", "edition": None}, "documents": [{"role": "scan"}], "questions": [
    {"native_id": "41", "missing_answer": True, "kind": "missing_answer_slot"},
    {"question": "2", "parent_native_id": "2", "answer": "A", "alternative_answers": ["B"], "kind": "grouped_alternatives", "required_images": [{"role": "map"}],
     "children": [{"native_id": "2a", "answer_conflicts": [{}, {}]}, {"native_id": "2b", "answer_conflicts": [{}, {}], "manual_decision": {"value": "A"}}]}]}
TOEFL = {**TOP, "sets": [
    {"native_id": "s1", "source_kind": "tpo", "kmf_url": "https://h.x/detail/read/ab1.html/1", "exam_date": "d", "questions": [
        {"native_id": "q1", "kind": "single_choice", "options": [], "answer": "A", "selected": ["A", "B"], "selection_count": 2}, {"native_id": "q2", "kind": "table_choice"}, {"native_id": "q3", "required_images": [{"role": "fig"}]}]},
    {"native_id": "s2", "restricted": True, "questions": [{"native_id": "z"}]}]}


@pytest.fixture(scope="module")
def raw(spark):
    deep = {"question": "0"}
    for k in range(1, 12):
        deep = {"question": str(k), "parts": [deep]}
    rows = [
        ("a", "cie", json.dumps(CIE)), ("b", "edexcel", json.dumps(EDEXCEL)), ("c", "ielts", json.dumps(IELTS)), ("d", "toefl", json.dumps(TOEFL)), ("e", "cie", "{bad"), ("f", "cie", "[1]"), ("g", "cie", None),
        ("h", "nope", "{}"), ("i", "toefl", '{"fixture_kind":"x"}'), ("j", "cie", '{"fixture_kind":"synthetic","schema_version":"2"}'), ("l", None, "{}"), ("m", "ielts", ""), ("n", "ielts", None),
        ("k", "cie", '{"fixture_kind":"synthetic","schema_version":"1","questions":{"a":1},"documents":7,"identity":"x"}'), ("o", "ielts", '{"fixture_kind":"synthetic","schema_version":"9"}'),
        ("p", "cie", json.dumps({**TOP, "documents": [{"role": "qp"}, {"role": "ms"}], "identity": {"date": "d"}, "questions": [deep]})),
    ]
    return spark.createDataFrame(rows, "source_id string, system string, payload string")


def test_questions(raw):
    rows = {(r["source_id"], r["native_id"]): r for r in X.normalised(raw, "questions").collect()}
    assert {k for k in rows if k[0] != "p"} == {("a", x) for x in ("1", "1a", "i", "ii", "iii", "1b", "p", "q")} | {("c", x) for x in ("41", "2", "2a", "2b")} | {("d", x) for x in ("q1", "q2", "q3")}
    assert rows["a", "ii"]["number_path"] == ["1", "1a", "ii"] and rows["a", "ii"]["parent_ref"] == "1a" and rows["a", "1"]["marks"] == 4
    kinds = {k: rows[k]["question_type"] for k in (("a", "1"), ("c", "41"), ("c", "2"), ("d", "q1"), ("d", "q2"), ("d", "q3"))}
    assert list(kinds.values()) == ["short_answer", "unknown", "single_choice", "single_choice", "table_choice", "fill_blank"]
    assert rows["c", "2"]["options"] == ["A", "B"]
    assert max(len(r["number_path"]) for r in rows.values()) == X.DEPTH + 1


def test_answers(raw):
    got = {(r["source_id"], r["question_ref"]): (r["original_value"], r["alternatives"], r["matching_method"], r["parent_refs"]) for r in X.normalised(raw, "answers").collect()}
    assert got == {
        ("a", "1"): ("42", [], "exact", ["1"]),
        ("a", "1a"): ("42", [], "ancestor", ["1"]),
        ("a", "1b"): (None, ["x", "7"], "descendants", ["p", "q"]),
        ("a", "p"): ("x", [], "exact", ["p"]),
        ("a", "q"): ("7", [], "exact", ["q"]),
        ("c", "2"): ("A", ["B"], "grouped", ["2"]),
        ("c", "2a"): (None, [], "unresolved", ["2a"]),
        ("c", "2b"): (None, [], "unresolved", ["2b"]),
        ("d", "q1"): ("A", ["B"], "in_any_order", ["q1"]),
    }


def test_problems(raw):
    got = sorted((r["source_id"], r["code"], r["native_ref"] or "", r["detail"] or "") for r in X.normalised(raw, "problems").collect())
    deep = [("p", "missing_answer", str(k), "") for k in range(3, 12)] + [("p", "too_deep", "3", "")]
    assert got == sorted([
        ("a", "hash_conflict", "1", "qp"), ("a", "missing_answer", "ii", ""), ("a", "missing_ms", "", "ms"), ("a", "missing_native_id", "", ""), ("a", "missing_native_id", "", ""), ("a", "missing_region_bbox", "1", "1"),
        ("a", "unexpected_member", "", "odd"), ("a", "unknown_date", "", ""), ("a", "unknown_rotation", "1", "2"), ("a", "unresolved_answer_mode", "i", "what"),
        ("b", "missing_document_role", "", "qp"), ("b", "missing_document_role", "u", "qp"), ("b", "missing_region_bbox", "u", "0"), ("b", "unknown_date", "", ""),
        ("c", "answer_conflict", "2a", ""), ("c", "missing_answer_slot", "41", ""), ("c", "missing_asset", "2", "map"), ("c", "missing_document_hash", "scan", ""), ("c", "unresolved_edition", "b1", ""), ("c", "unresolved_identity", "2", ""),
        ("d", "invalid_kmf_url", "s2", ""), ("d", "missing_asset", "q3", "fig"), ("d", "missing_options", "q1", ""), ("d", "missing_table", "q2", ""), ("d", "restricted_source", "s2", ""), ("d", "unknown_date", "s2", ""),
        ("e", "invalid_json", "", ""), ("f", "invalid_json", "", ""), ("g", "missing_index", "", ""), ("h", "unknown_system", "", ""), ("i", "wrong_source_kind", "", ""), ("j", "unsupported_schema_version", "", ""),
        ("k", "missing_document_role", "", "qp"), ("k", "missing_ms", "", "ms"), ("k", "unknown_date", "", ""), ("l", "unknown_system", "", ""), ("m", "invalid_json", "", ""), ("n", "missing_source", "", ""),
        ("o", "unsupported_schema_version", "", "9"), *deep,
    ])


def test_containers_courses_regions_and_assets(raw):
    natives = {r["native"] for r in X.normalised(raw, "containers").where("source_id in ('a', 'b', 'c', 'd')").collect()}
    assert natives == {
        '{"subject":"9700","year":"2020","season":"june","paper":"1","date":null}', '{"qualification_level":"ial","unit_code":"U1","paper_code":null}', '{"book":"b1","revision":"r1"}',
        '{"set":"s1","source_kind":"tpo"}', '{"set":"s2","source_kind":"unknown"}',
    }
    courses = {(r["source_id"], r["native_code"]): (r["name"], r["aliases"], r["applicable_years"]) for r in X.normalised(raw, "courses").where("source_id in ('a', 'b', 'c', 'd')").collect()}
    assert courses == {("a", "9700"): ("bio", ["bio"], [2020]), ("b", "S"): ("T", [], []), ("c", "b1"): ("b1", [], []), ("d", "tpo"): ("tpo", [], []), ("d", "unknown"): ("unknown", [], [])}
    regions = {(r["source_id"], r["place"]): (r["document_sha256"], r["page"], r["bbox"], r["rotation_transform"]) for r in X.normalised(raw, "regions").collect()}
    assert regions == {("a", 0): ("abc", 1, [1, 2, 3, 4], [1, 0]), ("a", 1): ("dd", 2, [], None), ("b", 0): (None, 3, [], None)}
    assets = sorted((r["source_id"], r["role"], r["sha256"], r["media_type"]) for r in X.normalised(raw, "assets").where("source_id < 'e'").collect())
    assert assets == [("a", "qp", "abc", None), ("b", "ms", "e", "application/pdf"), ("c", "map", None, None), ("d", "fig", None, None)]


def test_no_files(raw):
    assert all(X.normalised(raw.where("false"), t).count() == 0 for t in ("questions", "problems"))


@pytest.mark.parametrize("name", ["problems", "regions"])
def test_files_are_parsed_once_and_nothing_is_joined(raw, name):
    plan = X.normalised(raw, name)._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" not in plan and "Join" not in plan


def test_regions_stay_with_their_file(raw):
    """A file that is given twice has its regions twice, not each with each."""
    assert X.normalised(raw.where("source_id = 'a'").unionByName(raw.where("source_id = 'a'")), "regions").count() == 4
