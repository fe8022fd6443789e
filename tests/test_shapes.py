"""Payload shapes against a recursive walk."""

import json
import random
import re

from paperglass.operators import shapes as H


def walk(v, path="$", depth=99):
    kind = {type(None): "none", bool: "bool", int: "int", float: "float", str: "str", dict: "dict", list: "list" if v else "empty list"}[type(v)]
    yield path, kind
    below = [(f"{path}.{json.dumps([k], ensure_ascii=False) if re.search(r'[.\[\]\"]|^$', k) else k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"{path}[]", x) for x in v] if isinstance(v, list) else []
    if below and not depth:
        yield path, "deeper"
    elif below:
        for p, x in below:
            yield from walk(x, p, depth - 1)


def merged(v, depth=99):
    out = {}
    for p, k in walk(v, depth=depth):
        out.setdefault(p, set()).add(k)
    return {p: sorted(k) for p, k in out.items()}


def made(rng, depth):
    kind = rng.randrange(9 if depth else 7)
    if kind < 7:
        return [None, True, rng.randrange(-(10**12), 10**12), 1.5, 1.0, "x", ""][kind]
    if kind == 7:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "é", "a.b", "x[]", "", "k"]): made(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_paths_like_a_recursive_walk(spark):
    rng = random.Random(1)
    deep = 1
    for k in range(20):
        deep = [deep, "s"] if k % 2 else {"d": deep}
    values = [made(rng, 5) for _ in range(300)] + [deep, 10**25, 12345678901234567890, {}, [], [[], [1], {}], {"a": [{"b": 1}, {"b": "x"}, {"c": None}]}]
    rows = [(k, json.dumps(v, ensure_ascii=False), 1) for k, v in enumerate(values)] + [(-1, None, 1), (-2, "{", 1), (-3, "", 1)]
    got = {}
    for r in H.payload_paths(spark.createDataFrame(rows, "id int, text string, path int"), "id", "text").collect():
        got.setdefault(r["key"], {})[r["path"]] = r["kinds"]
    assert got == {**{k: merged(v) for k, v in enumerate(values)}, -2: {"$": ["malformed"]}, -3: {"$": ["malformed"]}}


def test_what_lies_below_the_depth_is_told(spark):
    value = {"a": [{"b": {"c": 1}}], "d": {}}
    got = {r["path"]: r["kinds"] for r in H.payload_paths(spark.createDataFrame([(1, json.dumps(value))], "id int, text string"), "id", "text", depth=3).collect()}
    assert got == merged(value, 3) and got["$.a[].b"] == ["deeper", "dict"]


def test_changes(spark):
    pairs = [
        ({"a": 1, "b": {"c": [1], "d": {"e": 1}}}, {"a": "1", "b": {"c": []}, "f": {"g": [2]}}),
        ([1, [2]], [[2.5]]),
        ({"x": [{"a": 1}, {"a": "s"}]}, {"x": [{"a": "s"}, {"a": 1}]}),
        ({"x": 1}, [1]),
    ]
    before, after = (H.payload_paths(spark.createDataFrame([(k, json.dumps(p[i])) for k, p in enumerate(pairs)], "id int, text string"), "id", "text") for i in (0, 1))
    got = sorted(tuple(r) for r in H.shape_changes(before, after).fillna("").collect())
    assert got == [
        (0, "$.a", "kind", "int", "str"), (0, "$.b.c", "kind", "list", "empty list"), (0, "$.b.c[]", "removed", "int", ""), (0, "$.b.d", "removed", "dict", ""), (0, "$.f", "added", "", "dict"),
        (1, "$[]", "kind", "int|list", "list"), (1, "$[][]", "kind", "int", "float"), (3, "$", "kind", "dict", "list"), (3, "$.x", "removed", "int", ""), (3, "$[]", "added", "", "int"),
    ]
    marks = {r["key"]: r["fingerprint"] for r in H.fingerprints(before).collect()}, {r["key"]: r["fingerprint"] for r in H.fingerprints(after).collect()}
    assert [marks[0][k] == marks[1][k] for k in range(4)] == [False, False, True, False]


def test_changes_read_each_payload_once(spark):
    """The payloads of either side are walked once, and members of removed and added paths are left out at any depth."""
    rows = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, payload string")
    before = rows('{"a": {"b": {"c": 1}}, "d": 1}', '{"x": []}', "[1")
    after = rows('{"d": "s", "e": [{"f": 1}]}', '{"x": [[1, null]]}')
    found = H.shape_changes(H.payload_paths(before, "id", "payload"), H.payload_paths(after, "id", "payload"))
    assert sorted(tuple(r) for r in found.fillna("").collect()) == [
        (0, "$.a", "removed", "dict", ""), (0, "$.d", "kind", "int", "str"), (0, "$.e", "added", "", "list"),
        (1, "$.x", "kind", "empty list", "list"), (1, "$.x[]", "added", "", "list"), (2, "$", "removed", "malformed", ""),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") <= 2
