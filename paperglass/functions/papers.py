"""Functions on papers and transcripts: types, cover pages, numbers, regions, clocks and relations of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperglass.functions.phrase_match import first_by_order
from paperglass.functions.text import once

#: Signs of document types on their first pages, with weights; of equal sums the first type counts (fixed values).
TYPE_SIGNS = {
    "mark_scheme": {
        r"mark scheme": 1.00, r"maximum mark\s*:": 0.60, r"published as an aid to teachers": 0.80, r"\bpartial marks\b": 0.50,
        r"\bquestion\b\s+\banswer\b\s+\bmarks\b": 0.45, r"how the marks should be awarded": 0.70, r"\bM1\b|\bA1\b|\bB1\b": 0.25,
    },
    "specimen_mark_scheme": {r"specimen": 0.45, r"mark scheme": 0.80, r"for examination from\s+\d{4}": 0.60},
    "question_paper": {
        r"question paper": 0.95, r"answer all questions": 0.70, r"write your answer": 0.50, r"you must answer on the question paper": 0.75,
        r"time allowed": 0.45, r"\[\s*\d+\s*\]": 0.20, r"before entering your candidate information": 0.85, r"write your name here": 0.55,
        r"you do not need any other materials": 0.45, r"instructions to (?:the )?(?:teacher/examiner|candidate)\b": 0.40, r"paper reference": 0.35,
        r"transcript of (?:the )?listening test": 0.65, r"\btranscript\b": 0.50, r"\btotal marks\b": 0.30,
    },
    "specimen_paper": {r"specimen": 0.50, r"question paper": 0.80, r"for examination from\s+\d{4}": 0.55},
    "examiner_report": {r"examiner report": 1.00, r"principal examiner": 0.80, r"general comments": 0.55, r"candidates?\s+(?:were|did|found|often)": 0.35, r"common misconceptions": 0.60},
    "scoring_guideline": {r"scoring guideline": 1.00, r"rubric": 0.55, r"free[- ]response": 0.40},
    "sample_response": {r"sample response": 1.00, r"exemplar": 0.70, r"candidate response": 0.60},
    "formula_booklet": {r"formula (?:booklet|sheet|list)": 1.00, r"list of formulae": 0.85, r"mathematical formulae": 0.70},
    "data_booklet": {r"data booklet": 1.00, r"periodic table": 0.55, r"data sheet": 0.70},
    "source_material": {r"source material": 1.00, r"insert": 0.55, r"clean copy": 0.45},
    "other": {
        r"scheme of work": 1.00, r"specification\b": 0.60, r"qualification guide": 0.80, r"getting started guide": 0.80, r"\bnotice\b": 0.40,
        r"past training|training content": 0.60, r"accredited specification": 0.70,
    },
}
#: Characters of a document that its type is read from (fixed value).
SCAN_CHARS = 6000


def content_type(text: Column) -> Column:
    """Struct (type, score, confidence, error): the type with the highest sum of weights, whose confidence is its sum against
    1.5, at most 1, times its share of the two highest sums. A text that cannot be read has an error, one without a sign
    neither type nor error."""
    part = F.substring(F.coalesce(text, F.lit("")), 1, SCAN_CHARS)

    def scored(page: Column) -> Column:
        flat, part = page["flat"], page["part"]
        control = F.length(F.regexp_replace(part, r"[^\x00-\x08\x0b-\x1f\x7f]", "")) / F.greatest(F.length(part), F.lit(1))
        poor = (F.size(F.regexp_extract_all(flat, F.lit("[A-Za-z]{3,}"), F.lit(0))) < 5) | (control > 0.10)
        error = F.when(poor, F.when(F.trim(flat) == "", "no_text_layer").otherwise("text_layer_unreadable"))
        scores = F.array(*[
            F.struct(reduce(lambda a, b: a + b, [F.when(flat.rlike(f"(?i){p}"), w).otherwise(0.0) for p, w in own.items()]).alias("score"), F.lit(-k).alias("k"), F.lit(kind).alias("type"))
            for k, (kind, own) in enumerate(TYPE_SIGNS.items())
        ])
        return F.struct(F.reverse(F.array_sort(scores)).alias("found"), error.alias("error"))

    def judged(page: Column) -> Column:
        best, runner, error = F.get(page["found"], 0), F.get(page["found"], 1)["score"], page["error"]
        sure = F.least(F.lit(1.0), best["score"] / 1.5) * best["score"] / (best["score"] + runner)
        some = error.isNull() & (best["score"] > 0)
        return F.struct(F.when(some, best["type"]).alias("type"), F.when(some, F.round(best["score"], 4)).otherwise(F.lit(None)).alias("score"), F.when(some, F.round(sure, 4)).otherwise(0.0).alias("confidence"), error.alias("error"))

    flat = once(part, lambda p: F.struct(p.alias("part"), F.regexp_replace(p, r"\s+", " ").alias("flat")))
    return once(once(flat, scored), judged)


#: Types that are a special form of another (fixed values).
SPECIALIZES = {"specimen_paper": "question_paper", "specimen_mark_scheme": "mark_scheme"}


def reconcile_type(label: Column, content: Column, content_confidence: Column) -> Column:
    """Struct (type, confidence, method) of a label's and the content's type. A label that is a special form of the content's
    type agrees with it. In a conflict the label stays, with a confidence that asks for a review."""
    general = F.element_at(F.create_map(*[F.lit(x) for kv in SPECIALIZES.items() for x in kv]), label)
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    agree = (label == content) | (general == content)
    method = F.when(label.isNotNull() & content.isNotNull(), F.when(agree, "label+content").otherwise("conflict")).when(content.isNotNull(), "content").when(label.isNotNull(), "label").otherwise("none")
    confidence = F.when(method == "label+content", clip(F.greatest(F.lit(0.9), content_confidence))).when(method == "conflict", 0.35).when(method == "content", clip(F.least(F.lit(0.75), content_confidence))).when(method == "label", 0.6).otherwise(0.2)
    return F.struct(F.coalesce(label, content, F.lit("other")).alias("type"), confidence.alias("confidence"), method.alias("method"))


def label_parts(label: Column) -> dict[str, Column]:
    """Year, session, paper, variant and kind of a resource label such as `June 2019 Question Paper 12`."""
    empty = lambda c: F.nullif(c, F.lit(""))
    number = empty(F.regexp_extract(label, r"(?i)(?:paper|scheme)\s*(\d)\d?\b", 1))
    return {
        "year": empty(F.regexp_extract(label, r"\b(20\d{2})\b", 1)).cast("int"),
        "session": F.lower(empty(F.regexp_extract(label, r"(?i)\b(january|march|june|october|november)\b", 1))),
        "paper": number.cast("int"),
        "variant": empty(F.regexp_extract(label, r"(?i)(?:paper|scheme)\s*\d(\d)\b", 1)).cast("int"),
        "kind": F.when(label.rlike(r"(?i)mark scheme"), "mark_scheme").when(label.rlike(r"(?i)question paper"), "question_paper").when(label.rlike(r"(?i)report"), "examiner_report"),
    }


def cover_page(text: Column) -> dict[str, Column]:
    """Codes, duration and total of a cover page."""
    from paperglass.functions.text import duration_minutes

    empty = lambda c: F.nullif(c, F.lit(""))
    return {
        "subject_code": empty(F.regexp_extract(text, r"\b(\d{4})/(\d)(\d)\b", 1)),
        "component": empty(F.regexp_extract(text, r"\b\d{4}/(\d)\d\b", 1)),
        "variant": empty(F.regexp_extract(text, r"\b\d{4}/\d(\d)\b", 1)),
        "minutes": duration_minutes(text),
        "total": empty(F.regexp_extract(text, r"(?i)total (?:mark|for (?:this )?paper)[^\d]{0,40}(\d{2,3})", 1)).cast("int"),
    }


def unit_code(attrs: Column, paper_code: Column) -> Column:
    """The unit of a JSON attribute, else the letters and digits that a paper code begins with."""
    return F.coalesce(F.get_json_object(attrs, "$.unit_code"), F.nullif(F.regexp_extract(paper_code, r"^([A-Z]{2,4}\d{2})", 1), F.lit("")))


def clock_units(times: DataFrame, key: list[str], time: str, duration: str) -> DataFrame:
    """(key, top, unit, confidence, reason): whether each key's times are seconds or milliseconds, by their greatest against the duration.

    Milliseconds need a span of a quarter of the recording; shorter ones stay seconds, so that the bounds tell of them. Without a duration
    only the size speaks, which may be `ambiguous`; what fits neither is `invalid`. Without times the unit is null.
    """
    top, length = F.col("top"), F.col("length")
    seen = times.groupBy(*key).agg(F.max(F.when(~F.isnan(F.col(time).cast("double")), F.col(time))).alias("top"), F.max(duration).alias("length"))
    high = length * 1.2 + 5

    def told(unit, confidence, reason):
        return F.struct(F.lit(unit).cast("string").alias("unit"), F.lit(confidence).cast("double").alias("confidence"), F.lit(reason).alias("reason"))

    sized = F.when(top > 7200, told("ms", 0.6, "magnitude_heuristic")).when(top > 3600, told("ambiguous", 0.3, "magnitude_ambiguous")).otherwise(told("sec", 0.4, "magnitude_heuristic_weak"))
    rescued = F.when(top / 1000 >= length * 0.25, told("ms", 0.95, "fits_duration_as_ms")).otherwise(told("sec", 0.5, "ms_span_implausible_keep_sec"))
    told_by = F.when(top.isNull(), told(None, 0.0, "no_values")).when(length.isNull() | (length <= 0), sized).when(top <= high, told("sec", 0.95, "fits_duration_as_sec")).when(top / 1000 <= high, rescued).otherwise(told("invalid", 0.9, "exceeds_duration_both_scales"))
    return seen.select(*key, "top", told_by.alias("x")).select(*key, "top", "x.*")


def transcript_words(text: Column) -> Column:
    """Lower-case words and digits of a transcript."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9']+"), lambda w: w != "")


def _joined(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def holds(words: Column, part: Column, front: int = 0, back: int = 0, least: int = 10) -> Column:
    """Whether `part` stands in a row in `words`, where up to `front` and `back` of its outer words may be cut off if `least`
    of them, or all of a shorter one, are left."""
    n = F.size(part)
    need, whole = F.least(F.lit(least), n), _joined(words)
    tries = []
    for f in range(front + 1):
        for b in range(back + 1):
            left = F.greatest(n - f - b, F.lit(0))
            probe = F.slice(part, F.lit(f + 1), left)
            tries.append((left >= need) & (left > 0) & F.contains(whole, _joined(probe)))
    return reduce(lambda x, y: x | y, tries)


def head_words(words: Column, n: int = 12) -> Column:
    return F.slice(words, 1, n)


def tail_words(words: Column, n: int = 16) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))


def tail_relation(a: Column, b: Column) -> Column:
    """How the last words of two texts relate: same, extends (b is cut off in a), extended_by, or differ."""
    in_b, in_a = holds(b, tail_words(a), back=3), holds(a, tail_words(b), back=3)
    return F.when((tail_words(a) == tail_words(b)) | (in_a & in_b), "same").when(in_a, "extends").when(in_b, "extended_by").otherwise("differ")


def head_relation(a: Column, b: Column) -> Column:
    """How the first words of two texts relate: same, extends, extended_by or differ."""
    ha, hb = head_words(a), head_words(b)
    return F.when(ha == hb, "same").when(holds(ha, hb, least=1 << 30), "extends").when(holds(hb, ha, least=1 << 30), "extended_by").otherwise("differ")


def region_of(text: Column, aliases: dict[str, str]) -> Column:
    """The region whose alias occurs in the text, the longest alias first; null without one. One pass over the text."""
    return first_by_order(text, sorted(aliases.items(), key=lambda kv: (len(kv[0]), kv[0]), reverse=True))


#: Instructions and their question types, the first match counts (fixed values).
INSTRUCTIONS = (
    (r"(?i)true.*false.*not given", "true_false_not_given"), (r"(?i)yes.*no.*not given", "yes_no_not_given"), (r"(?i)choose (?:two|three)", "multiple_choice"),
    (r"(?i)choose the correct letter", "single_choice"), (r"(?i)match", "matching"), (r"(?i)label (?:the )?(?:map|plan|diagram)", "diagram_labels"), (r"(?i)complete the|no more than", "fill_blank"), (r"(?i)answer the questions", "short_answer"),
)


def question_type(source_type: Column, instruction: Column, pool: Column) -> tuple[Column, Column]:
    """(type, conflict): the source's type, else the instruction's; a conflict where both are known and differ, or a choice
    has no pool of options."""
    by_text = F.lit(None).cast("string")
    for pattern, kind in reversed(INSTRUCTIONS):
        by_text = F.when(instruction.rlike(pattern), kind).otherwise(by_text)
    kind = F.coalesce(source_type, by_text)
    differ = source_type.isNotNull() & by_text.isNotNull() & (source_type != by_text)
    return kind, F.coalesce(differ, F.lit(False)) | (kind.isin("single_choice", "multiple_choice", "matching") & (F.coalesce(F.size(pool), F.lit(0)) <= 0))
