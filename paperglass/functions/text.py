"""Text and key functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def identity_key(*parts: Column) -> Column:
    """sha1 of the trimmed, lower-cased, space-collapsed parts; null counts as empty."""
    folded = [F.lower(F.regexp_replace(F.trim(F.coalesce(p.cast("string"), F.lit(""))), r"\s+", " ")) for p in parts]
    return F.sha1(F.concat_ws("\x1f", *folded))


def short_hash(*parts: Column, length: int = 12) -> Column:
    return F.substring(identity_key(*parts), 1, length)


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def canonical(fields: dict[str, Column]) -> Column:
    """`key=value` of the non-null fields in key order, for hashes that do not depend on the order of columns."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), fields[k].cast("string")) for k in sorted(fields)])


def public_id(prefix: str, fields: dict[str, Column]) -> Column:
    """A prefix and the first 20 bytes of the canonical string's sha256 in lower-case base32."""
    # conv writes the digits of base 32 as 0-9 and A-V; ten digits of base 16 are eight of base 32
    digits = once(F.sha2(canonical(fields), 256), lambda h: F.concat(*[F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]))
    return F.concat(F.lit(prefix), F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"))


def content_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical(fields), 256)


def _in_order(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields and whose maps their keys in name order, at any depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_in_order(value.getField(f.name), f.dataType).alias(f.name) for f in fields])) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _in_order(v, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), F.to_json(F.struct(_in_order(e["value"], kind.valueType).alias("v")), {"ignoreNullFields": "false"}).alias("value"))))
        return F.transform(pairs, lambda e: F.array(e["key"], e["value"]))
    return value


def sorted_json(fields: dict[str, Column], schema: T.StructType) -> Column:
    """JSON of fields in name order with nested names in order too and nulls kept; equal for equal values. A map is a list of its
    pairs by key, each value wrapped, since its own JSON would keep the order of its keys."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return F.to_json(F.struct(*[_in_order(fields[n], kinds[n]).alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def near_normal(text: Column) -> Column:
    """Lower case, thousands joined, numbers as #, other signs as blanks, blanks collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?<![\d.])(\d{1,3}) (?=\d{3}(?!\d))", "$1")
    t = F.regexp_replace(t, r"\d+(?:\.\d+)?", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9# ]+", " "), " +", " "))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams; a shorter text is its only one, an empty text has none."""
    size = F.length(text)
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


#: Words that carry no topic (fixed values).
STOPWORDS = (
    "a an the and or but of to in on at by for with from as is are was were be been being it its this that these those which "
    "who whom whose there here their they them he she his her you your we our us i not no nor so such than then thus also "
    "both each few more most other some only own same too very can could may might must shall should will would do does did "
    "done doing have has had having if when where why how what all any because before after during between into through "
    "about above below up down out off over under again further once calculate find show hence give write answer marks "
    "question questions total following"
).split()


def fold_plural(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(n <= 3, word)
        .when(F.endswith(word, F.lit("sses")), F.substring(word, F.lit(1), n - 2))
        .when(F.endswith(word, F.lit("ies")) & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(F.endswith(word, F.lit("s")) & ~word.rlike("(?:ss|is|us|os)$"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def topic_words(text: Column) -> Column:
    """Lower-case words, in compatibility form, of two or more letters or digits, without numbers and stop words, plurals folded."""
    words = F.regexp_extract_all(F.lower(compatible(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w))
    return F.transform(kept, fold_plural)


def strip_html(html: Column) -> Column:
    """Plain text of a page: breaks and closing block tags are newlines, other tags go, six entities are read."""
    t = F.regexp_replace(html, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))


def occurrences(text: Column, needle: str) -> Column:
    """How often a needle occurs, case-folded, without overlap."""
    low = F.lower(text)
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def snippet(text: Column, needle: str, around: int = 40) -> Column:
    """The text around the needle's first occurrence, on one line; null without one."""
    at = F.locate(needle.lower(), F.lower(text))
    begin = F.greatest(at - around, F.lit(1))
    cut = F.substring(text, begin, at - begin + len(needle) + around)
    return F.when(at > 0, F.regexp_replace(cut, r"\s+", " "))


def marks_of(text: Column) -> Column:
    """Marks from `[3]` or `(3 marks)`, null without either."""
    found = F.regexp_extract(text, r"\[(\d{1,2})\]|\((\d{1,2}) marks?\)", 0)
    return F.nullif(F.regexp_replace(found, r"\D", ""), F.lit("")).cast("int")


def number_label(text: Column) -> Column:
    """A line's leading question number `3`, `3(a)` or `3(a)(ii)` as a path; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"^\s*(\d{1,2}(?:\s*\([a-z]{1,5}\))*)(?=[\s.)]|$)", 1), r"\s+", ""), F.lit(""))


def duration_minutes(text: Column) -> Column:
    """Minutes of `1 hour 30 minutes`, `2 hours` or `45 minutes`."""
    hours = F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*hours?", 1), F.lit(""))
    minutes = F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*min(?:ute)?s?", 1), F.lit(""))
    total = F.coalesce(hours.cast("int"), F.lit(0)) * 60 + F.coalesce(minutes.cast("int"), F.lit(0))
    return F.when(hours.isNotNull() | minutes.isNotNull(), total)


def mark_codes(answer: Column, guidance: Column | None = None) -> dict[str, Column]:
    """Counts of method, accuracy and independent marks in an entry, whether errors carry forward, and the first six answers
    that `oe`, `or` and `accept` introduce."""
    text = F.concat(F.coalesce(answer, F.lit("")), F.lit(" "), F.coalesce(guidance, F.lit("")) if guidance is not None else F.lit(""))
    counts = {f"n_{c.lower()}": F.size(F.regexp_extract_all(text, F.lit(rf"\b{c}\d?"), F.lit(0))).cast("long") for c in "MAB"}
    said = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:oe|or|accept)\b\s*([^;.]{1,80})"), F.lit(1)), lambda v: F.trim(v))
    return counts | {"ecf": text.rlike(r"(?i)\b(?:FT|ECF)\b"), "acceptable": F.slice(F.filter(said, lambda v: v != ""), 1, 6)}


def paper_number(text: Column) -> Column:
    """A paper number with two digits."""
    return F.lpad(F.regexp_extract(text, r"(\d{1,2})\s*$", 1), 2, "0")


def redact(text: Column, secrets: tuple[str, ...] = (), limit: int = 500) -> Column:
    """Given secrets and anything that looks like a path replaced, blanks folded, at most `limit` characters."""
    t = text
    for secret in secrets:
        if secret:
            t = F.replace(t, F.lit(secret), F.lit("<secret>"))
    t = F.regexp_replace(t, r"""\\\\[^\s'"]+""", "<path>")
    t = F.regexp_replace(t, r"""(?:[A-Za-z]:[\\/]|/)[^\s'"]+""", "<path>")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, limit)


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """The compatibility forms of single characters: those of one character as two strings, longer ones as pairs."""
    one, to, longer = [], [], []
    for code in (*range(0xA0, 0x250), *range(0x2000, 0x2190), *range(0x2460, 0x2474), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)):
        form = unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and len(form) == 1:
            one.append(chr(code))
            to.append(form)
        elif form != chr(code) and (code in (0xBC, 0xBD, 0xBE, 0x2025, 0x2026, 0x2116, 0x2121, 0x2122) or code >= 0xFB00):
            longer.append((chr(code), form))
    return "".join(one), "".join(to), longer


ONE, TO, LONGER = _compatible()


def _compatible_form(t: Column) -> Column:
    out = F.translate(t, ONE, TO)
    for sign, form in LONGER:
        out = F.replace(out, F.lit(sign), F.lit(form))
    return F.when(t.rlike("[^\\x00-\\x7F]"), out).otherwise(t)


def compatible(text: Column) -> Column:
    """Characters in their compatibility form: full width, superscripts, ligatures, fractions, unusual blanks.

    Letters and their combining marks are not composed; texts hold composed letters."""
    return once(text, _compatible_form)


def _straight(compatible_text: Column) -> Column:
    t = F.translate(compatible_text, "‘’‚‛“”„‟–—", "'" * 4 + '"' * 4 + "--")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def normalize_answer(text: Column) -> Column:
    """Compatibility forms, straight quotes and dashes, blanks collapsed, lower case; null counts as empty."""
    return _straight(compatible(F.coalesce(text, F.lit(""))))


def normalize_answer_column(name: str) -> Column:
    """normalize_answer of a column by name, without lambdas, so that Spark compiles all of it."""
    return _straight(_compatible_form(F.coalesce(name, F.lit(""))))


#: Number words and choice families (fixed values).
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}
CHOICES = {
    "tfng": {"t": "true", "true": "true", "f": "false", "false": "false", "ng": "not given", "not given": "not given", "notgiven": "not given"},
    "ynng": {"y": "yes", "yes": "yes", "n": "no", "no": "no", "ng": "not given", "not given": "not given", "notgiven": "not given"},
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _number(s: Column) -> Column:
    words = literal_map({w: str(n) for w, n in NUMBER_WORDS.items()})
    return F.when(s.rlike(r"^\d{1,3}(?:,\d{3})+$"), F.replace(s, F.lit(","), F.lit(""))).when(s.rlike(r"^\d+$"), F.regexp_replace(s, "^0+(?=\\d)", "")).otherwise(F.element_at(words, s))


def number_form(text: Column) -> Column:
    """The digits of a number word or of digits with thousands signs, without leading zeros; null for other texts."""
    return once(normalize_answer(text), _number)


def _date(s: Column) -> Column:
    pattern = r"^(\d{1,4})[.\-/](\d{1,2})[.\-/](\d{1,4})$"
    first, month, last = (F.nullif(F.regexp_extract(s, pattern, k), F.lit("")) for k in (1, 2, 3))
    turned = F.length(first) == 4
    year, day, month = F.when(turned, first).otherwise(last).cast("int"), F.when(turned, last).otherwise(first).cast("int"), month.cast("int")
    return F.when(month.between(1, 12) & day.between(1, 31), F.format_string("%04d-%02d-%02d", year, month, day))


def date_form(text: Column) -> Column:
    """yyyy-mm-dd of day, month and year, or year, month and day, with points, dashes or slashes; null for other texts."""
    return once(normalize_answer(text), _date)


def choice_family(text: Column) -> Column:
    """The family that an instruction speaks of: tfng, ynng or null."""
    s = F.upper(F.coalesce(text, F.lit("")))
    return F.when(s.rlike(r"\b(?:TRUE|FALSE)\b"), "tfng").when(s.rlike(r"\b(?:YES|NO)\b"), "ynng")


def in_family(folded: Column, family: Column) -> Column:
    """A normalised answer, given as such, in a family's own words where it is one of its choices."""
    named = F.element_at(F.create_map(*[x for f, c in CHOICES.items() for x in (F.lit(f), literal_map(c))]), family)
    return F.coalesce(F.element_at(named, folded), folded)


def normalize_choice(text: Column, family: Column) -> Column:
    """A normalised answer, in a family's own words where it is one of its choices."""
    return once(normalize_answer(text), lambda s: in_family(s, family))


def _variant(a: Column, b: Column) -> Column:
    """Whether two texts that are not equal once normalised share a reading; those without parentheses and slashes have only their own."""
    several = lambda c: F.coalesce(F.contains(c, F.lit(")")) | F.contains(c, F.lit(" / ")), F.lit(False))
    forms = F.transform(F.array(a, b), lambda c: F.transform(variants(F.coalesce(c, F.lit(""))), normalize_answer))
    return F.when(several(a) | several(b), once(forms, lambda v: F.arrays_overlap(v[0], v[1]))).otherwise(F.lit(False))


#: Reasons for which two answers are equal.
EQUAL = ("exact", "variant", "allowed_variant", "number_word", "date_variant")


def _rules(a: Column, b: Column, x: Column, y: Column, allowed: Column | None, number_word: bool, dates: bool) -> list[tuple[Column, str]]:
    """Conditions with their reasons, the first that holds counts, for texts a and b with normalised choices x and y."""
    one = lambda c: c.rlike("^[a-z]$")
    rules = [((x == "") | (y == ""), "empty"), (x == y, "exact"), (one(x) != one(y), "single_letter_mismatch"), (_variant(a, b), "variant")]
    if allowed is not None:
        rules.append((allowed, "allowed_variant"))
    if number_word:
        rules.append((_number(x) == _number(y), "number_word"))
    if dates:
        rules.append((_date(x) == _date(y), "date_variant"))
    return rules


def answers_equal(a: Column, b: Column, x: Column, y: Column, allowed: Column | None = None, number_word: bool = False, dates: bool = False) -> Column:
    """compare_answers' `equal` for texts whose normalised choices x and y are known; `allowed` says whether one is listed for the other."""
    rules = _rules(a, b, x, y, allowed, number_word, dates)
    return reduce(lambda w, r: w.when(r[0], r[1] in EQUAL), rules, F.when(F.lit(False), False)).otherwise(False)


def compare_answers(a: Column, b: Column, family: Column | None = None, allowed_a: Column | None = None, allowed_b: Column | None = None, number_word: bool = False, dates: bool = False) -> Column:
    """Struct (equal, reason) of a strict comparison, the first that holds: empty, exact, single_letter_mismatch, variant,
    allowed_variant, number_word, date_variant, mismatch. Numbers as words and dates count only if asked for."""
    family = F.lit(None).cast("string") if family is None else family
    none = F.array().cast("array<string>")
    listed = lambda c, v: F.lit(False) if c is None else F.array_contains(F.transform(F.coalesce(c, none), normalize_answer), v)

    def judged(v: Column) -> Column:
        allowed = None if allowed_a is None and allowed_b is None else listed(allowed_a, v["y"]) | listed(allowed_b, v["x"])
        return reduce(lambda w, r: w.when(*r), _rules(v["a"], v["b"], v["x"], v["y"], allowed, number_word, dates), F.when(F.lit(False), "")).otherwise("mismatch")

    found = once(F.struct(normalize_choice(a, family).alias("x"), normalize_choice(b, family).alias("y"), a.alias("a"), b.alias("b")), judged)
    return once(found, lambda r: F.struct(r.isin(*EQUAL).alias("equal"), r.alias("reason")))


def variants(text: Column) -> Column:
    """Readings of an answer, sorted, itself among them: what stands in parentheses may be left out or is one of several
    alternatives with slashes, and slashes between blanks separate alternatives. Every pair of parentheses is read, so an
    answer with many of them has many readings."""
    fold = lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))
    pattern = r"(?s)^(.*?)\(([^()]*)\)(.*)$"

    def opened(v: Column) -> Column:
        before, inside, after = (F.regexp_extract(v, pattern, k) for k in (1, 2, 3))
        inner = F.filter(F.transform(F.split(inside, "/"), lambda x: F.trim(x)), lambda x: x != "")
        with_one = F.concat(F.transform(inner, lambda x: F.concat(before, x, after)), F.array(F.regexp_replace(F.concat(before, after), r"\s+", " ")))
        return F.when(~v.rlike(pattern), F.array(v)).when(F.size(inner) == 0, F.array(F.concat(before, after))).otherwise(with_one)

    pairs = F.size(F.split(text, r"\)")) - 1
    steps = F.when(pairs > 0, F.sequence(F.lit(1), pairs)).otherwise(F.array().cast("array<int>"))
    plain = F.aggregate(steps, F.array(text), lambda acc, _: F.array_distinct(F.flatten(F.transform(acc, opened))))
    split = F.flatten(F.transform(plain, lambda v: F.when(F.contains(v, F.lit(" / ")), F.transform(F.split(v, " / "), lambda x: F.trim(x))).otherwise(F.array(fold(v)))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(split, F.array(text)), lambda v: v != "")))


def overlap_share(needed: Column, found: Column) -> Column:
    """The share of the distinct needed tokens that occur among the found ones; 0 without any needed."""
    need = F.array_distinct(needed)
    return F.when(F.size(need) == 0, 0.0).otherwise(F.size(F.array_intersect(need, found)) / F.size(need))


def text_quality(text: Column) -> dict[str, Column]:
    """Signals of a transcript's text: sizes, how it ends, pages and advertisements in its place, lines of speakers."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), r"\s+$", "")
    blanks = lambda c: F.filter(c, lambda w: w != "")
    lines = blanks(F.transform(F.split(t, r"\n+"), lambda v: F.regexp_replace(F.regexp_replace(v, r"^\s+", ""), r"\s+$", "")))
    last, first = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), F.coalesce(F.get(lines, 0), F.lit(""))
    cut = t.rlike(r"(?:\.\.\.|…)\s*$")
    return {
        "chars": F.length(t).cast("long"),
        "words": F.size(blanks(F.split(t, r"\s+"))).cast("long"),
        "lines": F.size(lines).cast("long"),
        "ends_with_terminal": ~cut & last.rlike(r"""[.!?»"')\]]\s*$"""),
        "tail_ellipsis": cut,
        "html_like": t.rlike(r"(?i)<(?:!doctype|html|head|body|script|div|p|meta)\b"),
        "ad_like": t.rlike(r"(?i)adsbygoogle|document\.createElement") | t.rlike(r"(?im)^Advertisements$"),
        "speaker_lines": F.size(F.filter(lines, lambda v: v.rlike(r"^[A-Z][A-Za-z .'-]{1,24}:\s"))).cast("long"),
        "starts_with_marker": first.rlike(r"(?i)^(?:PART|SECTION)\s*[1-4]\b"),
    }


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
