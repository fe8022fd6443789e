"""Filters of catalogue rows by lists and queries, and states of seasons with their reasons."""

import pytest

from paperglass.operators import search as S

ROWS = [(1, ["a", "b"], "x", {"k": "Deep  Blue"}, [([7], True)]), (2, ["b"], "y", None, None), (3, None, None, {"k": None}, []), (4, [], "X", {}, [([1, 2], False)])]


@pytest.mark.parametrize(("wanted", "query", "ids"), [
    ({}, None, [1, 2, 3, 4]), ({"tags": "b"}, None, [1, 2]), ({"tags": "a", "kind": "x"}, None, [1]), ({"kind": "y"}, "", [2]), ({"id": 3}, None, [3]), ({"id": "3"}, " ", [3]), ({"none": "b"}, None, []), ({"kind": "None"}, None, []),
    ({}, "blue", [1]), ({}, "1 2 false", [4]), ({}, "b  x", [1]), ({}, "%", []), ({"tags": "b"}, "7", [1]),
])
def test_rows_by_lists_and_query(spark, wanted, query, ids):
    df = spark.createDataFrame(ROWS, "id int, tags array<string>, kind string, `m.x` map<string,string>, deep array<struct<n:array<int>,f:boolean>>")
    assert sorted(r.id for r in S.row_filter(df, wanted, query).collect()) == ids


def test_states_of_seasons(spark):
    key = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = key([("a|2020-06",), ("a|2020-06|R",), ("a|2021-01",), ("a|2021-01|R",), ("a|2022-06",), ("a|2022-06|R",), ("b|2020-06",), (None,)], "key string")
    got = S.season_availability(
        asked, key([("a|2020-06",), ("a|2021-01|R",), ("a|2020-06",)], "key string"), key([("a|2021-01", "exams off"), ("a|2020-06", "late")], "key string, reason string"),
        key([("a|2022-06|R", "z", "e2"), ("a|2022-06|R", "gone", "e1"), ("a|2021-01", "gone", "e")], "key string, reason string, evidence string"),
    )
    assert {tuple(r) for r in got.collect()} == {
        ("a|2020-06", "available", None, None), ("a|2020-06|R", "cancelled", "late", None), ("a|2021-01", "cancelled", "exams off", None), ("a|2021-01|R", "available", None, None),
        ("a|2022-06", "not_listed", None, None), ("a|2022-06|R", "unobtainable", "gone", "e1"), ("b|2020-06", "not_listed", None, None), (None, "not_listed", None, None),
    }
