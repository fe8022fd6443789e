"""Phrases by automaton against brute force, and names of regions."""

import random

import pytest
from pyspark.sql import functions as F

from paperglass.functions import phrase_match as M
from paperglass.functions import regions as G
from paperglass.operators import tagging


def test_spans_like_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        phrases = ["".join(rng.choice("ab 卷") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 8))]
        text = "".join(rng.choice("ab 卷") for _ in range(rng.randint(0, 30)))
        known = {p: phrases.index(p) for p in phrases if p}
        all_ = sorted((i, i + len(p), k) for p, k in known.items() for i in range(len(text)) if text.startswith(p, i))
        found = M.spans(M.automaton(phrases), phrases, text)
        assert sorted(found) == all_
        taken, at = [], 0
        while at < len(text):
            here = max(((b, k) for a, b, k in all_ if a == at), default=None)
            if here is None:
                at += 1
            else:
                taken.append((at, here[0], here[1]))
                at = here[0]
        assert M.longest(found) == taken


@pytest.mark.parametrize("block", [100_000, 4])
def test_phrases_in_texts(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(block)
    phrases = ["a b", "b", "a-b", "", "b a b", "é a", "1", "b1", "a  b"] + ["".join(rng.choice("ab-") for _ in range(3)) for _ in range(8)]
    texts = [(k, "".join(rng.choice("ab1é -") for _ in range(rng.randint(0, 40)))) for k in range(80)] + [(500, None), (501, ""), (None, "a b"), (3, "a b")]
    got = M.phrases_in(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string"), M.stands_alone)
    word = set("abcdefghijklmnopqrstuvwxyz0123456789")
    expected = []
    for i, t in texts:
        for p in {p for p in phrases if p}:
            if any((t or "").startswith(p, k) and not (k and t[k - 1] in word) and not (k + len(p) < len(t) and t[k + len(p)] in word) for k in range(len(t or ""))):
                expected.append((i, p))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_regions_by_hand(spark):
    """Cases as the rules say them: short names, codes, endings, groups before provinces of one letter, order of aliases."""
    names = {
        "山东": ("山东", None), " 沪 ": ("上海", None), "sh": ("上海", None), "北京卷": ("北京", None), "山东省": ("山东", None), "BJ市": ("北京", None), "新高考1": (None, "全国1"), "ii卷": (None, "全国2"),
        "东北": (None, "黑吉辽蒙"), "黑龙江卷": (None, None), "": (None, None), None: (None, None), "火星": (None, None), "甲卷文科": (None, "全国甲卷"),
    }
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["x"]["province"], r["x"]["group"]) for r in frame.select("name", G.normalised_region(F.col("name")).alias("x")).collect()}
    assert got == names
    texts = {"2020新课标I卷英语": ("全国1", "新疆"), "黑吉辽蒙2024": ("黑吉辽蒙", "黑龙江"), "江苏卷 数学": (None, "江苏"), "全国II卷 全国I卷": ("全国1", None), "none": (None, None), None: (None, None), "": (None, None), "内蒙古": (None, "内蒙古")}
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["g"], r["p"]) for r in frame.select("text", G.group_in(F.col("text")).alias("g"), G.province_in(F.col("text")).alias("p")).collect()}
    assert {t: g for t, (g, _) in got.items()} == {t: g for t, (g, _) in texts.items()}
    for t in texts:
        assert got[t][1] == next((n for a, n in G.PROVINCE_ORDER if t and a in t), None), t
    assert got["江苏卷 数学"][1] == "江苏" and got["内蒙古"][1] == "内蒙古"
    members = frame.limit(1).select(G.group_members(F.lit("ii卷")).alias("m")).first()["m"]
    assert len(members) == 17 and len(G.NAMES) == 31 and sum(map(len, G.GROUPS.values())) == 34


def test_no_phrase_takes_no_pass(spark):
    """Without phrases no text goes through Python; keywords of one word each have none."""
    texts = spark.createDataFrame([(1, "a simple test"), (2, None)], "id long, text string")
    none = M.phrases_in(texts, spark.createDataFrame([("",)], "phrase string"))
    assert none.collect() == [] and none.columns == ["id", "phrase"] and none.schema["id"].dataType.simpleString() == "bigint"
    topics = tagging.keyword_topics(texts, spark.createDataFrame([("A", "simple")], "code string, keyword string"))
    assert "MapInArrow" not in topics._jdf.queryExecution().toString() and [r["code"] for r in topics.collect()] == ["A"]
