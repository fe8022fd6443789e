"""Filtered, stably paged search over papers, questions and listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperglass.operators.relations import resolve_answers


@dataclass(frozen=True)
class PaperFilter:
    board: str | None = None
    qualification: str | None = None
    subject_code: str | None = None
    year: int | None = None
    session: str | None = None
    paper_code: str | None = None
    level: str | None = None
    doc_type: str | None = None


@dataclass(frozen=True)
class QuestionFilter(PaperFilter):
    number_path: str | None = None
    keyword: str | None = None
    marks_min: int | None = None
    marks_max: int | None = None
    leaves_only: bool = False
    roots_only: bool = False
    has_asset: bool | None = None
    has_official_answer: bool | None = None
    taxonomy_code: str | None = None
    taxonomy_source: str | None = None
    difficulty_min: float | None = None
    difficulty_max: float | None = None
    difficulty_source: str | None = None


def search_papers(papers: DataFrame, f: PaperFilter) -> DataFrame:
    """Papers whose columns equal all the set fields; unset fields do not filter."""
    for name in PaperFilter.__dataclass_fields__:
        value = getattr(f, name)
        if value is not None:
            papers = papers.where(F.col(name) == F.lit(value))
    return papers


def counted(rows: DataFrame, name: str = "total") -> DataFrame:
    """The number of rows as a frame of one row; paging plays no part."""
    return rows.agg(F.count("*").alias(name))


def contains_literal(text: str | Column, keyword: str) -> Column:
    """Whether the text holds the keyword, case-folded, with no wildcards."""
    text = F.col(text) if isinstance(text, str) else text
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def leaves(questions: DataFrame) -> DataFrame:
    """Questions that are no other question's parent."""
    parents = questions.select(F.col("parent_id").alias("id")).where("id is not null").distinct()
    return questions.join(parents, "id", "left_anti")


def roots(questions: DataFrame) -> DataFrame:
    return questions.where("parent_id is null")


def having(questions: DataFrame, related: DataFrame, wanted: bool | None) -> DataFrame:
    """Questions with (True) or without (False) a related row; None does not filter."""
    if wanted is None:
        return questions
    keys = related.select(F.col("question_id").alias("id")).distinct()
    return questions.join(keys, "id", "left_semi" if wanted else "left_anti")


def with_topic(questions: DataFrame, links: DataFrame, code: str | None, source: str | None) -> DataFrame:
    """Questions with a topic link that has the code and the source in one row."""
    if code is None and source is None:
        return questions
    if code is not None:
        links = links.where(F.col("code") == code)
    if source is not None:
        links = links.where(F.col("source") == source)
    return having(questions, links, True)


def with_difficulty(questions: DataFrame, difficulty: DataFrame, low: float | None, high: float | None, source: str | None) -> DataFrame:
    """Questions with a difficulty row that meets both bounds and the source."""
    if low is None and high is None and source is None:
        return questions
    if low is not None:
        difficulty = difficulty.where(F.col("value") >= low)
    if high is not None:
        difficulty = difficulty.where(F.col("value") <= high)
    if source is not None:
        difficulty = difficulty.where(F.col("source") == source)
    return having(questions, difficulty, True)


def star(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """Questions with their paper's columns."""
    return questions.join(papers.withColumnRenamed("id", "paper_id"), "paper_id")


def search_questions(questions: DataFrame, papers: DataFrame, links: DataFrame, difficulty: DataFrame, assets: DataFrame, answers: DataFrame, f: QuestionFilter) -> DataFrame:
    """Questions that meet every set field. Relations filter by semi-joins, so no question comes twice."""
    out = search_papers(star(questions, papers), PaperFilter(**{n: getattr(f, n) for n in PaperFilter.__dataclass_fields__}))
    if f.number_path is not None:
        out = out.where(F.col("number_path") == f.number_path)
    if f.keyword is not None:
        out = out.where(contains_literal("stem_text", f.keyword))
    if f.marks_min is not None:
        out = out.where(F.col("marks") >= f.marks_min)
    if f.marks_max is not None:
        out = out.where(F.col("marks") <= f.marks_max)
    if f.roots_only:
        out = roots(out)
    if f.leaves_only:
        parents = questions.select(F.col("parent_id").alias("id")).where("id is not null").distinct()
        out = out.join(parents, "id", "left_anti")
    out = having(having(out, assets, f.has_asset), answers, f.has_official_answer)
    out = with_topic(out, links, f.taxonomy_code, f.taxonomy_source)
    return with_difficulty(out, difficulty, f.difficulty_min, f.difficulty_max, f.difficulty_source)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit of a total order. A limit under 1 or an offset under 0 is refused."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def question_order() -> list[Column]:
    return [F.desc_nulls_last("year"), F.asc("paper_id"), F.asc("display_order"), F.asc("id")]


def keyset_page(rows: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """The next 1 to 200 rows after a key, with the key to go on from (null on the last page)."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    if after is not None:
        rows = rows.where(F.col(key) > after)
    some = rows.orderBy(key).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(key))
    numbered = some.withColumn("_n", place).withColumn("_all", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("_n") == limit, F.col(key))).over(Window.partitionBy())
    return numbered.withColumn("next_key", F.when(F.col("_all") > limit, last)).where(F.col("_n") <= limit).drop("_n", "_all")


def excerpt(text: str, length: int = 200) -> Column:
    """A text on one line, its first characters."""
    return F.substring(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), 1, length)


def tagged_questions(
    questions: DataFrame, papers: DataFrame, links: DataFrame, code: str, board: str | None = None, min_confidence: float | None = None, limit: int = 20, offset: int = 0, subject_code: str | None = None,
    year_from: int | None = None, session: str | None = None, paper_code: str | None = None, nodes: DataFrame | None = None, entries: DataFrame | None = None, official: DataFrame | None = None,
) -> DataFrame:
    """A page of the questions of a topic, with their excerpt and the total over all pages.

    A question with several links to the topic has the confidence (and source and assigned_by, where links hold them) of the surest
    one, ties to the greater source. With `nodes` (code, name, board) only nodes of the board, or of any if none is given, count
    and taxonomy_name is added: a topic of that code of another board brings no question in. Links then name nodes by node_id (nodes: id
    too), or by code, which counts for the node of the question's board. With `entries` and `official` the
    answer of each question of the page is resolved (answer_mode, answer). An unknown topic has no rows. year_from keeps no
    question without a year.
    """
    own = [c for c in ("source", "assigned_by") if c in links.columns]
    if "node_id" in links.columns:
        links = links.drop("code", "board").join(nodes.where(F.col("code") == code).select(F.col("id").alias("node_id"), "code", "board"), "node_id")
    of_node = ["board"] if "node_id" in links.columns else []
    links = links.where(F.col("code") == code)
    if min_confidence is not None:
        links = links.where(F.col("confidence") >= min_confidence)
    best = links.groupBy(F.col("question_id").alias("id"), *of_node).agg(F.max(F.struct("confidence", *own)).alias("_link")).select("id", *of_node, "_link.*")
    rows = search_papers(star(questions, papers), PaperFilter(board=board))
    for name, value in (("subject_code", subject_code), ("session", session), ("paper_code", paper_code)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if year_from is not None:
        rows = rows.where(F.col("year") >= year_from)
    rows = rows.join(best, ["id", *of_node])
    named = []
    if nodes is not None:
        node = nodes.where(F.col("code") == code).groupBy("board").agg(F.min("name").alias("taxonomy_name"))
        rows, named = rows.join(node, "board"), ["taxonomy_name"]
    total = rows.agg(F.count("*").alias("total"))
    some = page(rows, question_order(), limit, offset).crossJoin(F.broadcast(total))
    out = some.select("id", "year", "paper_id", "confidence", excerpt("stem_text").alias("excerpt"), "total")
    if nodes is not None or entries is not None:
        more = [c for c in ("number_path", "marks", "board", "subject_code", "session", "paper_code") if c in some.columns]
        out = some.select("id", "year", "paper_id", "confidence", excerpt("stem_text").alias("excerpt"), "total", *more, F.lit(code).alias("taxonomy_code"), *own, *named)
    if entries is not None:
        asked = out.select("id", "paper_id", "number_path")
        answers = resolve_answers(asked, entries.join(asked.select("paper_id").distinct(), "paper_id", "left_semi"), official)
        out = out.join(answers.select("id", F.col("mode").alias("answer_mode"), "answer"), "id", "left")
    return out


def _seeded(key: str, seed: int) -> Column:
    return F.sha1(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_questions(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of the key, over all rows."""
    return rows.orderBy(_seeded(key, seed), key).limit(n)


def sample_until_marks(rows: DataFrame, key: str, marks: str, target: int, seed: int) -> DataFrame:
    """Rows in the order of a seeded hash until their marks reach the target. Every row taken with positive marks brings at
    least one, so the first `target` such rows are enough and the running sum is over a bounded frame."""
    first = rows.where(F.col(marks) > 0).withColumn("_h", _seeded(key, seed)).orderBy("_h", key).limit(target)
    before = F.coalesce(F.sum(marks).over(Window.orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).where(F.col("_before") < target).drop("_before", "_h")


def count_by(rows: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """Counts by a column's values; listed values that do not occur count zero."""
    found = rows.groupBy(column).agg(F.count("*").alias("total"))
    if values is None:
        return found
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(listed).join(found, column, "left").select(column, F.coalesce("total", F.lit(0)).alias("total"))


def resolve_board(explicit: str, subject: str, aliases: dict[str, str], four_digits: str, other: str) -> tuple[Column, Column]:
    """(board, how): an alias of the given name, else inferred from the subject: four digits name one board, others the other."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    named = F.element_at(known, F.lower(F.trim(F.col(explicit))))
    guess = F.when(F.col(subject).isNull(), None).when(F.col(subject).rlike(r"^\d{4}$"), four_digits).otherwise(other)
    return F.coalesce(named, guess), F.when(named.isNotNull(), "explicit").when(guess.isNotNull(), "inferred")


def normalize_season(text: str, month: str, aliases: dict[str, str], months: dict[int, str]) -> Column:
    """The season that the first known word of a free text names, else the month's."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    by_month = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: F.array_contains(F.map_keys(known), w))
    return F.coalesce(F.element_at(known, F.get(words, 0)), F.element_at(by_month, F.col(month).cast("int")))


def paper_link(board: str, subject: str, year: str, season: str, prefix: str = "/papers") -> Column:
    """A retrieval link, null unless all four parts are known."""
    parts = [F.col(c) for c in (board, subject, year, season)]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat(F.lit(prefix), F.lit("/"), F.concat_ws("/", *[F.url_encode(p.cast("string")) for p in parts])))


def catalog_filter(entries: DataFrame, equal: dict[str, str], allowed: tuple[str, ...], query: str | None = None) -> DataFrame:
    """Entries (kind, identity_fields map, searchable map, aliases array) by allow-listed identity fields and a case-folded
    substring of their search, identity and alias texts. Unknown keys are refused."""
    for key, value in equal.items():
        if key not in allowed:
            raise ValueError(f"unknown filter: {key}")
        entries = entries.where(F.element_at("identity_fields", key) == value)
    if query:
        text = F.concat_ws(" ", F.map_values("searchable"), F.map_values("identity_fields"), "aliases")
        entries = entries.where(F.contains(F.lower(text), F.lit(query.lower())))
    return entries


def _flat(value: Column, kind: T.DataType) -> Column:
    """The texts of a value of any depth, blank between them; null is empty."""
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *[_flat(value.getField(f.name), f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda v: _flat(v, kind.elementType)), " ")
    if isinstance(kind, T.MapType):
        return F.array_join(F.transform(F.map_values(value), lambda v: _flat(v, kind.valueType)), " ")
    return F.coalesce(value.cast("string"), F.lit(""))


def row_filter(rows: DataFrame, wanted: dict[str, object], query: str | None = None) -> DataFrame:
    """Rows whose columns have all the wanted values, as text: a list by membership, any other column by equality.

    A column that the rows lack matches nothing, and neither does a null. The query is a literal part, without regard to case and with
    its blanks collapsed, of all values of a row at any depth; an empty one is no filter. Columns may have any names.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for name, value in wanted.items():
        text = F.lit(str(value).lower() if isinstance(value, bool) else str(value))
        if name not in kinds:
            return rows.where(F.lit(False))
        column = rows[f"`{name}`"]
        rows = rows.where(F.array_contains(F.transform(column, lambda v: v.cast("string")), text) if isinstance(kinds[name], T.ArrayType) else column.cast("string") == text)
    words = " ".join((query or "").split()).lower()
    if words:
        every = F.concat_ws(" ", *[_flat(rows[f"`{n}`"], k) for n, k in kinds.items()])
        rows = rows.where(F.contains(F.lower(every), F.lit(words)))
    return rows


def season_availability(asked: DataFrame, seasons: DataFrame, cancelled: DataFrame, unobtainable: DataFrame) -> DataFrame:
    """Asked seasons (key) with their state, reason and evidence.

    `available` if the index lists the key; else `cancelled` if the season is, whatever its paper set (a key without its `|R`);
    else `unobtainable` if the key is; else `not_listed`. Cancelled (key, reason), unobtainable (key, reason, evidence); of several
    lines for one key the least reason counts. A null key is not listed.
    """
    have = seasons.select("key").distinct().withColumn("_have", F.lit(True))
    off = cancelled.groupBy(F.col("key").alias("_base")).agg(F.min(F.struct("reason")).alias("_off"))
    lost = unobtainable.groupBy("key").agg(F.min(F.struct("reason", "evidence")).alias("_lost"))
    rows = asked.withColumn("_base", F.regexp_replace("key", r"\|R$", "")).join(have, "key", "left").join(off, "_base", "left").join(lost, "key", "left")
    state = F.when(F.col("_have"), "available").when(F.col("_off").isNotNull(), "cancelled").when(F.col("_lost").isNotNull(), "unobtainable").otherwise("not_listed")
    reason = F.when(state == "cancelled", F.col("_off.reason")).when(state == "unobtainable", F.col("_lost.reason"))
    return rows.select(*asked.columns, state.alias("state"), reason.alias("reason"), F.when(state == "unobtainable", F.col("_lost.evidence")).alias("evidence"))


def subject_search(subjects: DataFrame, query: str, aliases: dict[str, str]) -> DataFrame:
    """Subjects (code, title) whose code is the query, or in whose title all its words occur, after alias translation."""
    words = [w for w in aliases.get(query.lower(), query.lower()).split() if w]
    hit = F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.col("title")), w)) if words else F.lit(False)
    return subjects.where((F.lower(F.col("code")) == query.lower()) | hit)


def state_of(keys: DataFrame, lists: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Each key's state: the first of the named lists that holds it, else `unknown`."""
    out, state = keys, F.lit(None).cast("string")
    for name, df in lists.items():
        mark = f"_{name}"
        out = out.join(df.select(*on).distinct().withColumn(mark, F.lit(True)), on, "left")
        state = F.coalesce(state, F.when(F.col(mark), F.lit(name)))
    return out.withColumn("state", F.coalesce(state, F.lit("unknown"))).drop(*[f"_{n}" for n in lists])
