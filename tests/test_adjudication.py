"""Adjudication: prepared comparisons against whole ones, and the plan of the query."""

import itertools

from pyspark.sql import functions as F

from paperglass.functions import text as X
from paperglass.operators import answers as A
from paperglass.plans.catalogue import QUERIES

TEXTS = [None, "", " ", "a", "B", "(a) b", "a / b", "Ten", "10", "1,000", "1/2/2020", "2020-02-01", "T", "true", "NG", "not  given", "ｂ", "(", "x)", "“q”"]


def test_prepared_comparison_is_the_whole_one(spark):
    rows = [(a, b, f) for a, b in itertools.product(TEXTS, TEXTS) for f in (None, "tfng", "ynng")]
    df = spark.createDataFrame(rows, "a string, b string, f string").withColumn("fa", X.normalize_answer_column("a")).withColumn("fb", X.normalize_answer_column("b"))
    how = {"number_word": True, "dates": True}
    prepared = X.answers_equal(F.col("a"), F.col("b"), X.in_family(F.col("fa"), F.col("f")), X.in_family(F.col("fb"), F.col("f")), **how)
    whole = X.compare_answers(F.col("a"), F.col("b"), F.col("f"), **how)["equal"]
    got = df.select(prepared.alias("p"), whole.alias("w"), (F.col("fa") == X.normalize_answer("a")).alias("same")).collect()
    assert all(r["p"] == r["w"] and r["same"] for r in got) and 0 < sum(r["p"] for r in got) < len(got)


def test_readings_are_expanded_only_to_be_compared(spark):
    """A candidate with many parentheses that stands alone costs no readings."""
    many = "(a)" * 25
    questions = spark.createDataFrame([(1, "x", None, None)], "k int, instruction string, options array<struct<label:string,text:string>>, allowed_variants array<string>")
    candidate = (1, 0, "u", None, True, False, False, False, False, many, None)
    fields = "k int, position int, upstream string, source_class string, verified boolean, visual_verified boolean, ocr boolean, edition_unverified boolean, order_unverified boolean, raw string, allowed_variants array<string>"
    decisions = spark.createDataFrame([], "k int, action string, from string, to string, book_value string, equivalents array<string>, artifact_values array<string>")
    row = A.adjudicate(questions, spark.createDataFrame([candidate, (1, 1, "w", *candidate[3:])], fields), decisions, ["k"]).first()
    assert (row["status"], row["answer"]) == ("source_verified", many)


def test_orders_are_neither_broadcast_nor_dealt_by_scene(spark):
    plan = QUERIES["a29_adjudicate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [k#" in line]
    assert len(joins) == 2 and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)


def test_texts_are_normalised_once(spark):
    plan = QUERIES["a29_adjudicate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("translate(") < 60
