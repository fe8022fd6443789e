"""Secret scans in DataFrame expressions only.

Three base patterns give spans by kind. Two character Markov models, of random strings and of ordinary identifiers, add
spans: a long token outside the base spans is a secret if its log-likelihood ratio is high. The models are fitted on
labelled samples: values of base matches and generated keys are random, the short words of all texts are ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import free_name

#: Base kinds and their patterns, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of the Markov models; the last index stands for the edges of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: A token that the models judge, and the ratio from which it is a secret.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
LOG_RATIO = 10.0
#: Ordinary words are shorter than the tokens that are judged.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_]{2,18}+(?![A-Za-z0-9+/_=-])"
#: Generated keys in the sample of random strings, of each form.
GENERATED = 1_000


def bound(value: Column, body) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, k: int, group: int = 0, keep=None) -> Column:
    """Spans (start, k, end) of a pattern's leftmost matches that do not overlap, in code points, end exclusive. `keep`
    picks matches by the text of their group."""
    empty = F.array().cast("array<struct<start:int,k:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    hit = F.lit(pattern)
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, hit, F.lit(0)), F.length).alias("sizes"),
        F.regexp_extract_all(text, hit, F.lit(group)).alias("values"),
    )

    def spans(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + p["gaps"][i]
            end = start + p["sizes"][i]
            span = F.array(F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end")))
            return F.struct(end.alias("at"), F.concat(acc["spans"], span if keep is None else F.when(keep(p["values"][i]), span).otherwise(empty)).alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(p["sizes"]) - 1), zero, step)["spans"]

    return F.when(text.rlike(pattern), bound(parts, spans)).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": matches(text, ASSIGN, 0, 2, lambda v: F.length(v) >= 12),
        "access": matches(text, ACCESS, 1),
        "hex": matches(text, HEX, 2),
    }


def _code(token: Column, i: Column) -> Column:
    return F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))


def pair_codes(token: Column) -> Column:
    """Codes before * SIZE + after of a token's character pairs, with code 0 for the edges."""
    codes = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: _code(token, i)), F.array(F.lit(0)))
    return bound(codes, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: c[i - 1] * SIZE + c[i]))


def labelled_sample(texts: DataFrame) -> DataFrame:
    """(token, random): values of base matches over all texts and generated keys, and the distinct short words."""
    spark = texts.sparkSession
    values = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    hit = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    found = texts.where(hit).select(F.explode(values).alias("token"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.base64(F.unhex(digest))
    keys = spark.range(GENERATED).select(F.explode(F.array(mixed, F.lower(mixed), F.upper(mixed), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)))).alias("token"))
    return found.unionByName(keys).distinct().withColumn("random", F.lit(1)).unionByName(words.distinct().withColumn("random", F.lit(0)))


def fit(sample: DataFrame) -> list[float]:
    """Log ratios P(after | before, random) / P(after | before, ordinary), by pair code, with add-one smoothing."""
    pairs = sample.select("random", F.explode(pair_codes(F.col("token"))).alias("pair"))
    rows = pairs.groupBy("random", "pair").count().collect()  # at most 2 * SIZE * SIZE rows
    counts = [[1.0] * (SIZE * SIZE) for _ in range(2)]
    for r in rows:
        counts[r["random"]][r["pair"]] += r["count"]
    totals = [[sum(c[b * SIZE : (b + 1) * SIZE]) for b in range(SIZE)] for c in counts]
    return [math.log(counts[1][p] / totals[1][p // SIZE]) - math.log(counts[0][p] / totals[0][p // SIZE]) for p in range(SIZE * SIZE)]


def log_ratio(token: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(pair_codes(token), F.lit(0.0), lambda acc, p: acc + table[p])


def spans_of(text: Column, model: list[float]) -> Column:
    """Struct (base, spans) of a text: the base spans, and these with the spans that the models add."""

    def added(base: Column) -> Column:
        free = F.filter(
            matches(text, TOKEN, 3, 0, lambda v: log_ratio(v, model) > LOG_RATIO),
            lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, free)).alias("spans"))

    return bound(F.array_sort(F.concat(*base_spans(text).values())), added)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """(id, text, base, spans) of every row: arrays of (start, k, end), k an index of KINDS; `spans` holds base and added ones.

    A null text counts as empty and has no spans. Repeated rows and null ids give a row each; other columns are ignored,
    whatever their names. Texts are scanned whole. Of matches that begin at one place the kinds come in the order of KINDS.
    Added spans are tokens of 20 or more characters that no base span touches.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if model is None:
        model = fit(labelled_sample(texts.select("text")))
    found = texts.withColumn("found", spans_of(F.col("text"), model))
    return found.select(F.col("_id").alias(id_col), "text", "found.base", "found.spans")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, model: list[float] | None = None) -> DataFrame:
    """All rows and columns of `docs` with the secrets of each text replaced, and the length column, if named, counted anew
    where a text has changed. Null texts stay null; columns of any name are kept as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if model is None:
        model = fit(labelled_sample(docs.select(text.alias("text"))))
    spans, clean = free_name(docs, "_spans"), free_name(docs, "_clean")
    found = docs.withColumn(spans, spans_of(text, model)["spans"]).withColumn(clean, redacted(F.col(text_col), F.col(spans)))
    new = {text_col: F.col(clean)}
    if length_col:
        changed = F.coalesce(F.size(spans) > 0, F.lit(False))
        new[length_col] = F.when(changed, F.length(clean).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"], s["end"])), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and the list of all spans."""

    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")

    return scanned.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(gap).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
