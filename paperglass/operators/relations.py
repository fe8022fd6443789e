"""Joins: latest rows, unique and null-safe matches, path links, references, ranges and merges by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns, as one aggregate without a sort."""
    rest = [c for c in rows.columns if c not in key]
    packed = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(packed).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def unique_match(left: DataFrame, right: DataFrame, on: list[str], id_col: str, found: str) -> DataFrame:
    """Left rows with the right id if exactly one right row agrees in all columns, nulls equal to nulls; else null."""
    single = right.groupBy(*on).agg(F.count("*").alias("_n"), F.min(id_col).alias(found)).where("_n = 1").drop("_n")
    renamed = single.select(*[F.col(c).alias(f"_r_{c}") for c in on], found)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, same, "left").drop(*[f"_r_{c}" for c in on])


#: Fields in which a mark scheme and its paper agree, null with null (fixed values).
PAPER_FIELDS = ("board", "qualification", "subject_code", "series", "year", "component", "variant", "level", "paper_code")


def matching_papers(documents: DataFrame, papers: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, paper_document_id) of the mark schemes among documents (id, doc_type, current_revision_id, PAPER_FIELDS): the one paper that
    agrees in all fields, null with null; null if there is none or several.

    A specimen mark scheme looks for specimen papers, others for question papers. A paper (document_id, parse_run_id) counts only if its run (id,
    document_revision_id, status) was completed and read the document's current revision.
    """
    done = papers.join(runs.select(F.col("id").alias("parse_run_id"), F.col("document_revision_id").alias("_rev"), "status"), "parse_run_id").where("status = 'completed'")
    parsed = done.select(F.col("document_id").alias("id"), "_rev")
    read = documents.join(parsed, "id").where(F.col("_rev") == F.col("current_revision_id")).select("id", F.col("doc_type").alias("family"), *PAPER_FIELDS)
    schemes = documents.where(F.col("doc_type").isin("mark_scheme", "specimen_mark_scheme"))
    family = F.when(F.col("doc_type") == "specimen_mark_scheme", "specimen_paper").otherwise("question_paper")
    wanted = schemes.select(F.col("id").alias("scheme"), family.alias("family"), *PAPER_FIELDS)
    return unique_match(wanted, read, ["family", *PAPER_FIELDS], "id", "paper_document_id").select(F.col("scheme").alias("id"), "paper_document_id")


def ancestors(path: str | Column) -> Column:
    """The paths above `1(a)(i)`, nearest first: `1(a)`, `1`."""
    path = F.col(path) if isinstance(path, str) else path
    inner = F.size(F.split(path, r"\(")) - 1
    return F.when(inner > 0, F.transform(F.sequence(F.lit(1), inner), lambda k: F.call_function("substring_index", path, F.lit("("), (inner - k + 1).cast("int")))).otherwise(F.array().cast("array<string>"))


def parent_path(path: str | Column) -> Column:
    return F.get(ancestors(path), 0)


def root_path(path: str | Column) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "(", 1)


def same_question(path_a: Column, path_b: Column) -> Column:
    """Whether two paths of one paper belong to one question: equal, one a plain prefix of the other, or of the same leading number."""
    root = lambda p: F.regexp_extract(p, r"^\s*(\d+)", 1)
    named = (path_a != "") & (path_b != "")
    return F.coalesce(named & (F.startswith(path_a, path_b) | F.startswith(path_b, path_a) | ((root(path_a) != "") & (root(path_a) == root(path_b)))), F.lit(False))


def link_entries(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """Entries (id, paper_id, number_path) with the question of the nearest path: their own, else an ancestor's.

    Adds question_id and level, 0 for the own path; null where no question of the paper fits.
    """
    steps = entries.select("id", "paper_id", F.posexplode(F.concat(F.array("number_path"), ancestors("number_path"))).alias("level", "number_path"))
    keys = questions.groupBy("paper_id", "number_path").agg(F.min("id").alias("question_id"))
    hit = steps.join(keys, ["paper_id", "number_path"]).groupBy("id").agg(F.min_by("question_id", "level").alias("question_id"), F.min("level").alias("level"))
    return entries.join(hit, "id", "left")


def resolve_answers(questions: DataFrame, entries: DataFrame, official: DataFrame) -> DataFrame:
    """The answer of each question (id, paper_id, number_path): official or own entry, else the nearest ancestor's with a
    text, else the texts of all descendants in path order, else none. Only entries of its own paper count.

    Columns: id, mode (exact, ancestor, descendants, none), source_path, answer.
    """
    text = entries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    by_path = text.groupBy("paper_id", "number_path").agg(F.min_by("text", "id").alias("text"))
    own_official = official.groupBy(F.col("question_id").alias("id")).agg(F.min("content").alias("content"))
    exact = questions.join(by_path, ["paper_id", "number_path"], "left").join(own_official, "id", "left")
    exact = exact.select("id", "paper_id", "number_path", F.coalesce("content", "text").alias("own"))
    open_ = exact.where("own is null")
    up = open_.select("id", "paper_id", F.posexplode(ancestors("number_path")).alias("level", "number_path"))
    above = up.join(by_path, ["paper_id", "number_path"]).groupBy("id").agg(F.min_by(F.struct(F.col("number_path").alias("path"), "text"), "level").alias("above"))
    down = by_path.select("paper_id", F.col("number_path").alias("path"), "text", F.explode(ancestors("number_path")).alias("number_path"))
    below = open_.join(down, ["paper_id", "number_path"]).groupBy("id", "number_path").agg(F.array_sort(F.collect_list(F.struct(path_key(F.col("path")).alias("k"), "path", "text"))).alias("parts"))
    rest = F.transform("parts", lambda p: F.concat(F.substring(p["path"], F.length("number_path") + 1, F.length(p["path"])), F.lit(" "), p["text"]))
    below = below.select("id", F.array_join(rest, "\n\n").alias("below"))
    out = exact.join(above, "id", "left").join(below, "id", "left")
    mode = F.when(F.col("own").isNotNull(), "exact").when(F.col("above").isNotNull(), "ancestor").when(F.col("below").isNotNull(), "descendants").otherwise("none")
    path = F.when(mode == "exact", F.col("number_path")).when(mode == "ancestor", F.col("above.path"))
    return out.select("id", mode.alias("mode"), path.alias("source_path"), F.coalesce("own", "above.text", "below").alias("answer"))


def tree_answers(questions: DataFrame, default_mode: str = "exact") -> DataFrame:
    """(id, mode, method, source_id, answer, problem) of a tree of questions (id, parent_id, position, answer, answer_mode).

    A question's own answer always counts. Else its mode, or the default where it has none, decides: ancestor takes that of the
    nearest ancestor with one, descendants those of its direct parts in their order, exact and none nothing. An unknown mode is a
    problem and resolves nothing; a question without an answer is one too, except in mode none.
    """
    modes = ("exact", "ancestor", "descendants", "none")
    given = F.coalesce("answer_mode", F.lit(default_mode))
    q = questions.withColumn("mode", F.when(given.isin(*modes), given).otherwise("none")).withColumn("bad", ~given.isin(*modes))
    have = q.where("answer is not null").select(F.col("id").alias("ancestor_id"), F.col("answer").alias("_up"))
    up = ancestor_nodes(q.select("id", "parent_id")).where("distance > 0").join(have, "ancestor_id").groupBy("id").agg(F.min_by(F.struct(F.col("ancestor_id").alias("source_id"), F.col("_up").alias("answer")), "distance").alias("up"))
    down = q.where("parent_id is not null and answer is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "id", "answer"))).alias("parts"))
    j = q.join(up, "id", "left").join(down, "id", "left")
    method = F.when(F.col("answer").isNotNull(), "exact").when((F.col("mode") == "ancestor") & F.col("up").isNotNull(), "ancestor").when((F.col("mode") == "descendants") & F.col("parts").isNotNull(), "descendants").otherwise("none")
    answer = F.when(method == "exact", F.array("answer")).when(method == "ancestor", F.array("up.answer")).when(method == "descendants", F.transform("parts", lambda p: p["answer"]))
    problem = F.when(F.col("bad"), "unresolved_answer_mode").when((method == "none") & (F.col("mode") != "none"), "missing_answer")
    source = F.when(method == "exact", F.col("id")).when(method == "ancestor", F.col("up.source_id"))
    return j.select("id", "mode", method.alias("method"), source.alias("source_id"), answer.alias("answer"), problem.alias("problem"))


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


#: Lower-case roman numerals by value; sub-labels beyond them sort by their letters behind all numerals.
ROMAN = [_roman(n) for n in range(1, 90)]


def path_key(path: Column) -> Column:
    """A sortable key of a path: numbers by value, the first sub-label by letter, deeper ones as roman numerals."""
    parts = F.split(F.regexp_replace(path, r"\)", ""), r"\(")
    order = F.array(*[F.lit(r) for r in ROMAN])

    def part(p: Column, i: Column) -> Column:
        roman = F.array_position(order, p)
        number = F.when(p.rlike(r"^\d+$"), p.cast("int")).when((i >= 2) & (roman > 0), roman.cast("int"))
        return F.struct(F.coalesce(number, F.when(i >= 2, len(ROMAN) + 1).otherwise(0)).alias("n"), p.alias("s"))

    return F.transform(parts, part)


def code_key(code: Column) -> Column:
    """A sortable key of dotted codes: 1.2 before 1.10."""
    return F.array_join(F.transform(F.split(code, r"[.\-]"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), ".")


def dangling(refs: DataFrame, ref: str, entries: DataFrame) -> DataFrame:
    """References that neither an id nor an alias of the entries (public_id, aliases) answers."""
    known = entries.select(F.col("public_id").alias(ref)).union(entries.select(F.explode("aliases").alias(ref))).distinct()
    return refs.where(F.col(ref).isNotNull()).join(known, ref, "left_anti")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Normalised aliases that name more than one id."""
    folded = aliases.select(F.lower(F.trim("alias")).alias("alias"), "public_id")
    return folded.groupBy("alias").agg(F.count_distinct("public_id").alias("ids")).where("ids > 1")


def expected_observed(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only: `missing` if expected, `unexpected` if observed."""
    a, b = expected.select(*key).distinct(), observed.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("kind", F.lit("unexpected")))


def pairing(files: DataFrame, key: list[str], role: str, first: str, second: str) -> DataFrame:
    """Each key's files in two roles: paired, one side only, or ambiguous where a role has several."""
    n = [F.count_if(F.col(role) == r).alias(f"n_{k}") for k, r in enumerate((first, second))]
    state = F.when((F.col("n_0") > 1) | (F.col("n_1") > 1), "ambiguous").when((F.col("n_0") == 1) & (F.col("n_1") == 1), "paired").when(F.col("n_0") == 1, f"{first}_only").when(F.col("n_1") == 1, f"{second}_only").otherwise("none")
    return files.groupBy(*key).agg(*n).withColumn("status", state)


#: Ranges up to which they are broadcast.
SHORT = 1_000


def range_lookup(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """Rows with the name of the closed range that holds the value; null outside all. Ranges do not overlap.

    A short table of ranges is broadcast. Of a longer one each range is put into the buckets of the value that it touches,
    as many buckets as ranges, and rows meet it there.
    """
    if ranges.limit(SHORT + 1).count() <= SHORT:
        return rows.join(F.broadcast(ranges), F.col(value).between(F.col(low), F.col(high)), "left").drop(low, high)
    span = ranges.agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count("*").alias("n")).first()
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // span["n"]))
    place = lambda c: F.floor((c - span["lo"]) / width)
    held = ranges.select(name, low, high, F.explode(F.sequence(place(F.col(low)), place(F.col(high)))).alias("_b"))
    keyed = rows.withColumn("_b", F.when(F.col(value).between(span["lo"], span["hi"]), place(F.col(value))))
    inside = F.col(value).between(F.col(low), F.col(high)) & (keyed["_b"] == held["_b"])
    return keyed.join(held, inside, "left").drop(low, high, "_b")


def symmetric_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs from either side: (id, other, rest)."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    one = pairs.select(F.col(a).alias("id"), F.col(b).alias("other"), *rest)
    return one.unionByName(pairs.select(F.col(b).alias("id"), F.col(a).alias("other"), *rest))


def bundle(questions: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """Questions with an array of structs for each relation (question_id, ...), empty where they have none."""
    out = questions
    for name, df in relations.items():
        fields = [c for c in df.columns if c != "question_id"]
        lists = df.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def ancestor_nodes(nodes: DataFrame, levels: int = 8) -> DataFrame:
    """(id, ancestor_id, distance) of every node and of each of its ancestors, itself at 0, up to `levels` steps."""
    parents = nodes.select(F.col("id").alias("ancestor_id"), F.col("parent_id").alias("above"))
    step = nodes.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance"), F.col("parent_id").alias("above"))
    out = step.drop("above")
    for k in range(1, levels + 1):
        step = step.where("above is not null").select("id", F.col("above").alias("ancestor_id"), F.lit(k).alias("distance")).join(parents, "ancestor_id").select("id", "ancestor_id", "distance", "above")
        out = out.unionByName(step.drop("above"))
    return out


def apply_overrides(rows: DataFrame, overrides: DataFrame, field: str, version: str, target_type: str = "question") -> DataFrame:
    """`field` of rows (id, field) replaced by active overrides (id, target_type, target_id, field_path, value, source_value,
    applies_to array, active) of this type and field, with `overridden` and `conflict`.

    Overrides of one target count in the order of their ids, each against what the one before has left. One applies if its
    versions are missing, hold `*` or the version, and its baseline is the value then; else it is a conflict and the value stays.
    """
    own = overrides.where(F.col("active") & (F.col("target_type") == target_type) & (F.col("field_path") == field))
    applies = F.col("applies_to").isNull() | (F.size("applies_to") == 0) | F.array_contains("applies_to", "*") | F.array_contains("applies_to", version)
    lists = own.groupBy(F.col("target_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("n"), "value", "source_value", applies.alias("applies")))).alias("_own"))
    start = F.struct(F.col(field).alias("value"), F.lit(False).alias("overridden"), F.lit(False).alias("conflict"))

    def step(acc: Column, o: Column) -> Column:
        fits = o["applies"] & o["source_value"].eqNullSafe(acc["value"])
        return F.struct(F.when(fits, o["value"]).otherwise(acc["value"]).alias("value"), (acc["overridden"] | fits).alias("overridden"), (acc["conflict"] | ~fits).alias("conflict"))

    done = F.aggregate(F.coalesce("_own", F.array().cast(lists.schema["_own"].dataType)), start, step)
    return rows.join(lists, "id", "left").withColumn("_done", done).select("id", F.col("_done.value").alias(field), "_done.overridden", "_done.conflict")


def reattach(lost: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a rebuilt table by natural key: attached where exactly one question has it, orphaned otherwise."""
    hits = questions.groupBy(*key).agg(F.count("*").alias("_n"), F.min("id").alias("question_id")).where("_n = 1").drop("_n")
    return lost.join(hits, key, "left").withColumn("status", F.when(F.col("question_id").isNull(), "orphaned").otherwise("attached"))


def merge(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """A full merge by key: new values win, and each row says whether it was created, updated, same or kept."""
    o = old.select(*key, *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_old"))
    n = new.select(*key, *values, F.lit(True).alias("_new"))
    changed = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"_o_{v}")) for v in values])
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(changed, "updated").otherwise("same")
    return o.join(n, key, "full_outer").select(*key, *[F.when(F.col("_new").isNull(), F.col(f"_o_{v}")).otherwise(F.col(v)).alias(v) for v in values], action.alias("action"))
