"""Rules of manifests, each alone and beside another, and their coverage."""

import pytest

from paperglass.operators import manifests as M

ITEM = "book int, id string, variant string, skill string, test string, part string, status string, evidence array<struct<file_page:int>>, expected_numbers array<int>, assets array<string>, groups array<struct<id:string, asset_ref:string, parts:array<string>>>"


def item(book=1, id="i", variant="shared", skill="listening", test="1", part="P1", status="verified", evidence=((3,),), numbers=(1, 2), assets=(), groups=()):
    return (book, id, variant, skill, test, part, status, None if evidence is None else list(evidence), None if numbers is None else list(numbers), list(assets), list(groups))


def rules(spark, *items):
    return sorted((r.rule, r.severity, r.detail) for r in M.manifest_findings(spark.createDataFrame(list(items), ITEM)).collect())


@pytest.mark.parametrize(("change", "found"), [
    ({}, []),
    ({"status": "done"}, [("illegal_status", "error", None)]),
    ({"status": None}, [("illegal_status", "error", None)]),
    ({"variant": "private"}, [("illegal_variant", "error", None), ("variant_not_allowed", "error", None)]),
    ({"variant": "general"}, [("variant_not_allowed", "error", None)]),
    ({"skill": "dance", "part": "X"}, [("illegal_skill", "error", None)]),
    ({"part": "P5"}, [("invalid_part", "error", None)]),
    ({"part": None}, [("invalid_part", "error", None)]),
    ({"evidence": ()}, [("verified_without_evidence", "error", None)]),
    ({"evidence": None}, [("verified_without_evidence", "error", None)]),
    ({"evidence": ((None,),)}, [("verified_without_page", "warning", None)]),
    ({"evidence": (), "status": "unverified"}, []),
    ({"numbers": (1, 3)}, [("not_contiguous_from_1", "error", "shared:listening:1"), ("numbers_not_gap_free", "error", None)]),
    ({"numbers": (2, 1)}, []),
    ({"numbers": (2, 3)}, [("not_contiguous_from_1", "error", "shared:listening:1")]),
    ({"numbers": (1, 1)}, [("not_contiguous_from_1", "error", "shared:listening:1"), ("numbers_not_gap_free", "error", None), ("overlapping_number", "error", "shared:listening:1:1")]),
    ({"numbers": None}, []),
    ({"groups": [("g", "a1", ["P2"])], "assets": ["a1"]}, []),
    ({"groups": [("g", "a2", ["P2", "WT1"])], "assets": ["a1"]}, [("invalid_group_part", "error", "g:WT1"), ("unknown_asset", "error", "g")]),
    ({"groups": [("g", None, None)]}, []),
    ({"part": "P9", "status": "x"}, [("illegal_status", "error", None), ("invalid_part", "error", None)]),
])
def test_rules_of_an_item(spark, change, found):
    assert rules(spark, item(**change)) == found


def test_rules_over_items(spark):
    parts = [item(id="a", numbers=(1, 2)), item(id="b", part="P2", numbers=(3, 4))]
    assert rules(spark, *parts) == []
    assert rules(spark, *parts, item(id="c", part="P3", numbers=(4, 5))) == [("not_contiguous_from_1", "error", "shared:listening:1"), ("overlapping_number", "error", "shared:listening:1:4")]
    assert rules(spark, *parts, item(id="c", part="P3", numbers=(6,))) == [("not_contiguous_from_1", "error", "shared:listening:1")]
    assert rules(spark, *parts, item(book=2, id="a")) == [("duplicate_item_id", "error", "2")] * 2
    assert rules(spark, item(test="A"), item(id="j", test="a", numbers=(3,))) == []


def test_coverage(spark):
    rows = [
        item(id="1"), item(id="2", part="P2", numbers=(3,)), item(id="3", test="2"), item(id="4", test="2", status="unverified"), item(id="5", test="3", status="not_in_book", numbers=()),
        item(id="6", variant="academic", skill="writing", part="WT1", status=None, numbers=None), item(book=2, id="7", test="T"), item(book=2, id="8", test="t"),
    ]
    df = spark.createDataFrame(rows, ITEM)
    got = {(r.level, r.book, r.variant, r.skill): tuple(r)[4:] for r in M.manifest_coverage(df, [["variant", "skill"], ["book"], []]).select("level", "book", "variant", "skill", "expected_units", "verified_units", "not_in_book_units", "unverified_units", "questions_expected").collect()}
    assert got == {
        ("variant,skill", None, "shared", "listening"): (4, 2, 1, 1, 11), ("variant,skill", None, "academic", "writing"): (1, 0, 0, 1, 0),
        ("book", 1, None, None): (4, 1, 1, 2, 7), ("book", 2, None, None): (1, 1, 0, 0, 4), ("", None, None, None): (5, 2, 1, 2, 11),
    }
    assert M.manifest_coverage(df.limit(0), [["variant", "skill"], ["book"]]).count() == 0


def test_complete_books(spark):
    rows = [item(book=b, id=str(b)) for b in (1, 2, 3, 4)] + [item(book=5, id="5", status="unverified"), item(book=6, id="6", status=None)]
    books = [(1, "complete", "in_book", None), (2, "complete", "", "not_in_book"), (3, "partial", "in_book", None), (4, None, "unverified", "in_book"), (5, "complete", None, "in_book"), (6, "complete", "in_book", None), (7, "complete", "in_book", None)]
    got = M.book_completeness(spark.createDataFrame(rows, ITEM), spark.createDataFrame(books, "book int, extraction string, general string, gt string")).collect()
    assert {r.book: r.reasons for r in got} == {1: [], 2: [], 3: ["extraction_open"], 4: ["extraction_open", "general_open"], 5: ["items_not_verified"], 6: ["items_not_verified"], 7: ["no_items"]}
    assert {r.book for r in got if r.complete} == {1, 2}


def test_gaps_are_found_without_sorting(spark):
    """Nulls, repeats, any order and the ends of the integers; the rule sorts nothing."""
    big = 2**31 - 1
    numbers = [[3, 1, 2], [1, 3], [2, 2], [1, None], [None], [], None, [big, big], [-(2**31), big], [big, big - 1], [1, 2, 3, 3], [None, None]]
    schema = "book long, id string, variant string, skill string, test string, part string, status string, evidence array<struct<file_page:int>>, expected_numbers array<int>, assets array<string>, groups array<struct<id:string,asset_ref:string,parts:array<string>>>"
    rows = [(1, str(k), "shared", "listening", "1", "P1", "unverified", None, n, None, None) for k, n in enumerate(numbers)]
    found = M.manifest_findings(spark.createDataFrame(rows, schema))
    assert sorted(int(r["item_id"]) for r in found.where("rule = 'numbers_not_gap_free'").collect()) == [1, 2, 3, 7, 8, 10, 11]
    assert "array_sort" not in found._jdf.queryExecution().optimizedPlan().toString()
