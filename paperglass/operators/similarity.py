"""Near-duplicate questions by TF-IDF over character n-grams and an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperglass.functions.text import char_ngrams, near_normal
from paperglass.operators.relations import same_question


def weights(questions: DataFrame, id_col: str, text_col: str, min_chars: int = 25, n: int = 3) -> DataFrame:
    """(id, gram, df, w, norm): weights (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) of the texts that are long enough."""
    kept = questions.select(F.col(id_col).alias("id"), near_normal(F.col(text_col)).alias("t")).where(F.length("t") >= min_chars)
    total = kept.agg(F.count("*").alias("n_docs"))
    tf = kept.select("id", F.explode(char_ngrams(F.col("t"), n)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    w = tf.join(df.crossJoin(F.broadcast(total)), "gram").select("id", "gram", "df", ((1 + F.log("tf")) * idf).alias("w"))
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, "id")


def similar_pairs(
    questions: DataFrame, id_col: str = "id", text_col: str = "stem_text", scope: list[str] | None = None, min_score: float = 0.62, top_k: int = 5, min_chars: int = 25, df_max: int = 400,
    paper_col: str | None = None, path_col: str | None = None, targets: DataFrame | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    """(lo, hi, score): pairs of one scope that are among the top_k of either side, by cosine over shared grams.

    Grams in fewer than two or more than `df_max` texts leave the product but stay in the norms, which is the operator's
    definition and bounds each gram's pairs. With `paper_col` and `path_col`, questions of one paper that are parts of one question are
    no pairs and take no place among the top_k. With `targets` (id) only pairs with a target come back; with `existing` (lo, hi) only
    pairs that are not yet there, for a run that adds to an earlier one.
    """
    w = weights(questions, id_col, text_col, min_chars)
    posting = w.where(F.col("df").between(2, df_max)).select("id", "gram", (F.col("w") / F.col("norm")).alias("u"))
    a = posting.select(F.col("id").alias("lo"), "gram", F.col("u").alias("ua"))
    b = posting.select(F.col("id").alias("hi"), "gram", F.col("u").alias("ub"))
    pairs = a.join(b, "gram").where("lo < hi").groupBy("lo", "hi").agg(F.sum(F.col("ua") * F.col("ub")).alias("cos")).where(F.col("cos") >= min_score)
    held = {"_s": F.struct(*scope)} if scope else {}
    if paper_col and path_col:
        held |= {"_paper": F.col(paper_col), "_path": F.col(path_col)}
    if held:
        of = questions.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in held.items()))
        for side in ("lo", "hi"):
            pairs = pairs.join(of.select(F.col("_id").alias(side), *(F.col(k).alias(f"{k}_{side}") for k in held)), side)
        if scope:
            pairs = pairs.where(F.col("_s_lo").eqNullSafe(F.col("_s_hi")))
        if paper_col and path_col:
            pairs = pairs.where(~F.coalesce((F.col("_paper_lo") == F.col("_paper_hi")) & same_question(F.col("_path_lo"), F.col("_path_hi")), F.lit(False)))
    sides = pairs.select(F.col("lo").alias("q"), F.col("hi").alias("other"), "cos").unionByName(pairs.select(F.col("hi").alias("q"), F.col("lo").alias("other"), "cos"))
    best = sides.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "other"))).where(F.col("n") <= top_k)
    found = best.select(F.least("q", "other").alias("lo"), F.greatest("q", "other").alias("hi"), F.round("cos", 4).alias("score")).distinct()
    if targets is not None:
        asked = targets.select(F.col("id").alias("lo")).distinct().withColumn("_lo", F.lit(True))
        found = found.join(asked, "lo", "left").join(asked.select(F.col("lo").alias("hi"), F.col("_lo").alias("_hi")), "hi", "left").where("_lo or _hi").select("lo", "hi", "score")
    return found if existing is None else found.join(existing.select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")
