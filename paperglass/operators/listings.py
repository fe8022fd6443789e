"""Listings of materials, timetables, overrides and queues, groupings of files, and validation rules."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperglass.functions import papers as P
from paperglass.functions import text as X


def materials(items: DataFrame, board: str | None = None, subject: str | None = None, kind: str | None = None, candidate_facing: bool | None = None) -> DataFrame:
    """Materials (subjects array, versions array) by board, one of their subjects, kind and audience, with counts."""
    out = items
    for name, value in (("board", board), ("kind", kind), ("candidate_facing", candidate_facing)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if subject is not None:
        out = out.where(F.array_contains("subjects", subject))
    return out.withColumn("n_versions", F.size("versions")).withColumn("n_subjects", F.size("subjects"))


def timetable(events: DataFrame, subject: str | None = None, date: str | None = None, session: str | None = None, level: str | None = None) -> DataFrame:
    """Events whose subject is the code or begins with it, by date, session and level."""
    if subject is not None:
        events = events.where(F.startswith("subject_code", F.lit(subject)))
    for name, value in (("date", date), ("session", session), ("level", level)):
        if value is not None:
            events = events.where(F.col(name) == F.lit(value))
    return events


def timetable_page(events: DataFrame, limit: int, offset: int, **filters: str | None) -> DataFrame:
    """A page of timetable() in the order of date, session, code and event, each row with the total of all pages."""
    from paperglass.operators.search import page

    found = timetable(events, **filters)
    total = found.agg(F.count("*").alias("total"))  # one row
    return page(found, [F.asc("date"), F.asc("session"), F.asc("subject_code"), F.asc("event")], limit, offset).crossJoin(F.broadcast(total))


def date_windows(windows: DataFrame, board: str | None = None, season: str | None = None) -> DataFrame:
    """Date windows (board, season, component, start, end) of a board and season; a window may be open on either side and never ends before
    it starts."""
    for name, value in (("board", board), ("season", season)):
        if value is not None:
            windows = windows.where(F.col(name) == F.lit(value))
    return windows.where(F.col("start").isNull() | F.col("end").isNull() | (F.col("end") >= F.col("start")))


def explanation_queue(explanations: DataFrame, status: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the explanations (id, question_id, review_status) of a status, oldest first, each row with the total of the status."""
    from paperglass.operators.search import page

    found = explanations.where(F.col("review_status") == status)
    total = found.agg(F.count("*").alias("total"))  # one row
    return page(found, [F.asc("id")], limit, offset).crossJoin(F.broadcast(total))


def trace_sources(edges: DataFrame, subject_type: str, subject_id: int) -> DataFrame:
    """The provenance edges of one subject in the order of their ids."""
    return edges.where((F.col("subject_type") == subject_type) & (F.col("subject_id") == subject_id)).orderBy("id")


def practice_list(rows: DataFrame, limit: int, offset: int, section: str | None = None, batch: int | None = None, free: bool | None = None, locked: bool | None = None) -> DataFrame:
    """A page of practice items (id, section, batch, free, locked) in the order of their ids."""
    from paperglass.operators.search import page

    for name, value in (("section", section), ("batch", batch), ("free", free), ("locked", locked)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return page(rows, [F.asc("id")], limit, offset)


def set_counts(sources: dict[str, DataFrame], sections: list[str]) -> DataFrame:
    """(set, source, a count for each section, total) over sources of items (set, section); the total also counts sections off the list."""
    union = reduce(DataFrame.unionByName, [df.select("set", "section").withColumn("source", F.lit(name)) for name, df in sources.items()])
    return union.groupBy("set", "source").agg(*[F.count_if(F.col("section") == s).alias(s) for s in sections], F.count("*").alias("total"))


def regions_by_year(rows: DataFrame, regions: str, years: list[int]) -> DataFrame:
    """(region, a count for each year, total): rows with an array of regions count once for each of them; the total holds all years."""
    each = rows.select("year", F.explode(F.array_distinct(regions)).alias("region"))
    return each.groupBy("region").agg(*[F.count_if(F.col("year") == y).alias(str(y)) for y in years], F.count("*").alias("total"))


def seasons(lists: dict[str, DataFrame], family: str) -> DataFrame:
    """Counts of seasons by family and state, from a frame for each state."""
    union = reduce(DataFrame.unionByName, [df.select(family).withColumn("state", F.lit(s)) for s, df in lists.items()])
    return union.groupBy(family, "state").agg(F.count("*").alias("n"))


def list_overrides(overrides: DataFrame, target_type: str | None = None, target_id: int | None = None, only_conflicts: bool = False, only_active: bool = False) -> DataFrame:
    if target_type is not None:
        overrides = overrides.where(F.col("target_type") == target_type)
    if target_id is not None:
        overrides = overrides.where(F.col("target_id") == target_id)
    if only_conflicts:
        overrides = overrides.where("conflict_detected")
    return overrides.where("active") if only_active else overrides


def set_overrides(old: DataFrame, edits: DataFrame, current: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, refused) after edits (target_type, target_id, field, value, author): fields off the list (target_type,
    field) or without an author are refused; an override that is edited again keeps its first baseline."""
    key = ["target_type", "target_id", "field"]
    listed = edits.join(allowed.select("target_type", "field").distinct(), ["target_type", "field"], "left_semi").where(F.col("author").isNotNull() & (F.trim("author") != ""))
    refused = edits.select(*key).exceptAll(listed.select(*key))
    n = listed.join(current.select(*key, F.col("value").alias("_now")), key, "left").select(*key, F.col("value").alias("_v"), F.col("author").alias("_a"), "_now", F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    j = o.join(n, key, "full_outer")
    base = F.when(F.col("_old").isNotNull(), F.col("source_value")).otherwise(F.col("_now"))
    return j.select(*key, F.coalesce("_v", "value").alias("value"), base.alias("source_value"), F.coalesce("_a", "author").alias("author"), F.when(F.col("_new").isNotNull(), True).otherwise(F.col("active")).alias("active")), refused


def revert_overrides(overrides: DataFrame, reverted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, restored): reverted rows stay, inactive; restored holds the baselines to write back, which may be null."""
    key = ["target_type", "target_id", "field"]
    mark = reverted.select(*key).distinct().withColumn("_r", F.lit(True))
    j = overrides.join(mark, key, "left")
    return j.withColumn("active", F.col("active") & F.col("_r").isNull()).drop("_r"), j.where("_r and active").select(*key, F.col("source_value").alias("value"))


def classifications(rows: DataFrame, document_id: int | None = None, method: str | None = None, limit: int = 50) -> DataFrame:
    """The newest classifications (id, document_id, method, ...) of a document or method, if one is given; `conflicts` is how many of the
    page were made by the method `conflict`."""
    kept = rows if document_id is None else rows.where(F.col("document_id") == document_id)
    if method:
        kept = kept.where(F.col("method") == method)
    page = kept.orderBy(F.desc("id")).limit(limit)
    return page.withColumn("conflicts", F.count_if(F.coalesce(F.col("method") == "conflict", F.lit(False))).over(Window.partitionBy(F.lit(1))))  # one page is one task


def grouped_files(rows: DataFrame, key: list[str], url: str, title: str) -> DataFrame:
    """Files by their full key, urls once each; rows without a full key stay alone."""
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    name = F.when(full, F.concat_ws("|", *[F.col(k).cast("string") for k in key])).otherwise(F.col(url))
    return rows.groupBy(name.alias("paper_key")).agg(F.array_sort(F.collect_set(F.struct(url, title))).alias("files"))


def work_queue(items: DataFrame, stages: DataFrame, done: DataFrame, key: str, kinds: list[str], years: tuple[int, int], excluded: list[str]) -> DataFrame:
    """Items of the kinds and years, without excluded subjects and done keys, with their stage (new without one)."""
    out = items.where(F.col("kind").isin(kinds) & F.col("year").between(*years) & ~F.col("subject").isin(excluded))
    return out.join(done.select(key).distinct(), key, "left_anti").join(stages.select(key, "stage"), key, "left").withColumn("stage", F.coalesce("stage", F.lit("new")))


def facet_values(rows: DataFrame, tags: str) -> DataFrame:
    """Distinct values by the prefix of `prefix:value` tags."""
    tag = rows.select(F.explode(tags).alias("t")).where(F.contains("t", F.lit(":")))
    return tag.groupBy(F.substring_index("t", ":", 1).alias("facet")).agg(F.array_sort(F.collect_set(F.expr("substring(t, locate(':', t) + 1)"))).alias("values"))


def with_facet(rows: DataFrame, tags: str, values: list[str]) -> DataFrame:
    """Rows that have one of the exact tags."""
    wanted = F.array(*[F.lit(v) for v in values])
    return rows.where(F.arrays_overlap(F.col(tags), wanted))


def specification_pick(rows: DataFrame, key: str, title: str, url: str, site: str) -> DataFrame:
    """Links of each key without restricted ones: those titled as a specification if there are any, else all; absolute."""
    free = rows.where(~F.col(url).rlike("(?i)restricted|secure"))
    spec = F.col(title).rlike("(?i)specification")
    some = F.count_if(spec).over(Window.partitionBy(key))
    absolute = F.when(F.col(url).rlike("^https?://"), F.col(url)).otherwise(F.concat(F.lit(site.rstrip("/")), F.when(F.startswith(url, F.lit("/")), "").otherwise("/"), F.col(url)))
    return free.withColumn("_n", some).where((F.col("_n") == 0) | spec).withColumn(url, absolute).drop("_n")


def shared_kinds(rows: DataFrame, region: str, kind: str, marker: Column) -> DataFrame:
    """Each region's kinds of shared and of own files."""
    return rows.groupBy(region).agg(F.array_sort(F.collect_set(F.when(marker, F.col(kind)))).alias("shared"), F.array_sort(F.collect_set(F.when(~marker, F.col(kind)))).alias("own"))


def completion_rollup(rows: DataFrame, levels: list[str], dimensions: list[Column]) -> DataFrame:
    """Units and complete units at every level and in total; a unit is complete if all dimensions that apply are."""
    met = reduce(lambda a, b: a & b, [F.coalesce(d, F.lit(True)) for d in dimensions])
    return rows.withColumn("_c", met).rollup(*levels).agg(F.count("*").alias("units"), F.count_if("_c").alias("complete"))


def audio_summary(rows: DataFrame, key: list[str], parts: int = 4) -> DataFrame:
    """Whether all parts of a key are verified, and its counts by status."""
    verified = F.col("status") == "verified"
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(verified).alias("verified"), (F.count_distinct(F.when(verified, F.col("part"))) == parts).alias("complete"))


def findings(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule whose condition a row meets."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(key, F.explode(hits).alias("rule"))


def index_findings(rows: DataFrame) -> DataFrame:
    """(paper, rule) of question indexes (paper, number_path, parent_path, role): not one question paper, several mark
    schemes, repeated numbers, a parent that differs from the path's, and one that does not exist."""
    from paperglass.operators.relations import parent_path

    per = rows.groupBy("paper").agg(F.count_distinct(F.when(F.col("role") == "qp", F.col("file"))).alias("qp"), F.count_distinct(F.when(F.col("role") == "ms", F.col("file"))).alias("ms"))
    out = per.where("qp <> 1").select("paper", F.lit("not_one_question_paper").alias("rule")).unionByName(per.where("ms > 1").select("paper", F.lit("several_mark_schemes").alias("rule")))
    q = rows.where("role = 'qp'")
    twice = q.groupBy("paper", "number_path").agg(F.count("*").alias("n")).where("n > 1").select("paper", F.lit("repeated_number").alias("rule"))
    wrong = q.where(~F.col("parent_path").eqNullSafe(parent_path("number_path"))).select("paper", F.lit("wrong_parent").alias("rule"))
    paths = q.select("paper", F.col("number_path").alias("parent_path")).distinct()
    lost = q.where("parent_path is not null").join(paths, ["paper", "parent_path"], "left_anti").select("paper", F.lit("missing_parent").alias("rule"))
    return out.unionByName(twice).unionByName(wrong).unionByName(lost).distinct()


def uncovered_pages(papers: DataFrame, front: int = 1) -> DataFrame:
    """(id, pages): pages of 1..page_count that no question has and that are not front matter."""
    every = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    return papers.select("id", F.array_except(F.array_except(every, "assigned"), F.sequence(F.lit(1), F.lit(front))).alias("pages"))


def path_divergence(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(id, only_stored, only_computed, first_difference) of two path sequences (id, paths); the position counts from 0."""
    j = stored.withColumnRenamed("paths", "a").join(computed.withColumnRenamed("paths", "b"), "id", "full_outer")
    a, b = F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>"))
    most = F.greatest(F.size(a), F.size(b))
    places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    first = F.get(F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), 0)
    return j.select("id", F.array_except(a, b).alias("only_stored"), F.array_except(b, a).alias("only_computed"), first.alias("first_difference"))


def hash_reconciliation(cited: DataFrame, table: DataFrame) -> DataFrame:
    """Cited (document, role, sha256) against the table's: same, different, or a role that the table lacks."""
    j = cited.join(table.withColumnRenamed("sha256", "_s"), ["document", "role"], "left")
    return j.select("document", "role", F.when(F.col("_s").isNull(), "missing_role").when(F.col("_s") == F.col("sha256"), "same").otherwise("different").alias("verdict"))


def lineage(runs: DataFrame, revisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(run_id, document_id, revision_no, sha256): parse runs with their revision and its file."""
    rev = revisions.select(F.col("id").alias("document_revision_id"), "document_id", "artifact_id", "revision_no")
    art = artifacts.select(F.col("id").alias("artifact_id"), "sha256")
    return runs.select(F.col("id").alias("run_id"), "document_revision_id").join(rev, "document_revision_id").join(art, "artifact_id").select("run_id", "document_id", "revision_no", "sha256")


def labelled_pages(pages: DataFrame, by_hash: DataFrame, by_label: DataFrame) -> DataFrame:
    """Pages (page_hash, label) with the catalog item of their hash, else of their label."""
    return pages.join(by_hash.withColumnRenamed("item", "_h"), "page_hash", "left").join(by_label.withColumnRenamed("item", "_l"), "label", "left").withColumn("item", F.coalesce("_h", "_l")).drop("_h", "_l")


def assembled(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row for each key of several sources, each source's columns as a struct, null where it has none."""
    out = None
    for name, df in parts.items():
        packed = df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))
        out = packed if out is None else out.join(packed, key, "full_outer")
    return out


def _repaired(rows: pd.DataFrame) -> pd.DataFrame:
    rows, seen, out = rows.sort_values("position"), set(), []
    after: dict[int, int] = {}  # a number that is taken, and the least one after it that may be free

    def free(base: str, k: int) -> int:
        passed = []
        while f"{base}.{k}" in seen:
            passed.append(k)
            k = after.get(k, k + 1)
        after.update(dict.fromkeys(passed, k))
        return k

    for new, base in zip(rows["new"], rows["base"], strict=True):
        if new in seen:
            minor = new[len(base) + 1 :]
            new = f"{base}.{free(base, int(minor) + 1 if minor.isdigit() else 2)}"
        seen.add(new)
        out.append(new)
    return rows.assign(repaired=out)[["unit", "position", "code", "repaired"]]


def code_repairs(points: DataFrame) -> DataFrame:
    """(unit, position, code, repaired) of points (unit string, topic string, code string, position long), in reading order.

    A code whose major number is not its topic's takes that of the topic; one that an earlier code of the unit has moves to
    the next minor number that none has yet. What is free depends on all repairs before, but only on those of the same major
    number, so the points of a unit and major number are walked in order in one group; a taken number names the next that may be free.
    """
    # white space as str.split() has it
    new = F.replace(F.regexp_replace("code", r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", ""), F.lit("–"), F.lit("-"))
    major, minor = F.substring_index("new", ".", 1), F.when(F.instr("new", ".") > 0, F.expr("substring(new, instr(new, '.') + 1)")).otherwise("")
    moved = (F.col("topic") != "") & (minor != "") & (major != F.col("topic"))
    rows = points.select("unit", "topic", "code", "position").where("code is not null").withColumn("new", new)
    rows = rows.withColumn("new", F.when(moved, F.concat("topic", F.lit("."), minor)).otherwise(F.col("new")))
    rows = rows.select("unit", "code", "position", "new", F.substring_index("new", ".", 1).alias("base"))
    return rows.groupBy("unit", "base").applyInPandas(_repaired, "unit string, position long, code string, repaired string")


#: Fewer characters are no transcript; words a second of a recording that fit its transcript (fixed values).
MIN_CHARS, SPEED = 200, (1.0, 4.5)


def transcript_choice(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The transcript of each part, and how the others speak for or against it; and the transcripts that were refused.

    Rows are (key, source, text, identity_ok boolean, duration_sec double). Empty texts, pages of errors and advertisements,
    texts of another part and short ones are refused. Of the others the first is taken of those that do not break off, then of
    the longest. The part is ok, in review where a head or tail differs or another text goes on, partial where it breaks
    off, missing without any; an ok part whose speed does not fit its recording is reviewed.
    """
    q = X.text_quality(F.col("text"))
    refused = (
        F.when(q["chars"] == 0, "empty").when(q["html_like"], "html_error_page").when(q["ad_like"], "advertisement_scaffold")
        .when(~F.coalesce("identity_ok", F.lit(True)), "identity_mismatch").when(q["chars"] < MIN_CHARS, "too_short")
    )
    judged = rows.select(*key, "source", "text", "duration_sec", q["chars"].alias("chars"), q["words"].alias("n_words"), q["tail_ellipsis"].alias("cut"), refused.alias("rejected"))
    usable = judged.where("rejected is null").withColumn("words", P.transcript_words(F.col("text")))
    order = Window.partitionBy(*key).orderBy("cut", F.desc("chars"), "source")
    ranked = usable.withColumn("rank", F.row_number().over(order))
    chosen = ranked.where("rank = 1").select(*key, "source", "text", "cut", "n_words", "words")
    others = ranked.where("rank > 1").select(*key, F.col("words").alias("w"))
    a, b = F.col("words"), F.col("w")
    tail, head = P.tail_relation(a, b), P.head_relation(a, b)
    seen = chosen.join(others, key).groupBy(*key).agg(
        F.count("*").alias("others"), F.bool_or(tail.isin("differ", "extended_by") | (head == "differ")).alias("against"),
        F.bool_or(P.holds(b, P.tail_words(a), back=3)).alias("tails"), F.bool_or(P.holds(b, P.head_words(a), front=3, least=8)).alias("heads"),
    )
    length = judged.groupBy(*key).agg(F.max("duration_sec").alias("duration_sec"))
    j = length.join(chosen.drop("words"), key, "left").join(seen, key, "left")
    speed = F.round(F.col("n_words") / F.when(F.col("duration_sec") > 0, F.col("duration_sec")), 2)
    status = F.when(F.col("source").isNull(), "missing").when(F.coalesce("against", F.lit(False)), "review").when(F.col("cut"), "partial").otherwise("ok")
    slow = (status == "ok") & ~F.coalesce(speed.between(*SPEED), F.lit(True))
    basis = F.when(status == "ok", F.when(F.col("tails"), "cross_source_agreement").when(F.col("heads"), "cross_source_prefix_agreement").otherwise("single_source_signals"))
    parts = j.select(*key, "source", "text", F.coalesce("others", F.lit(0)).alias("others"), F.when(slow, "review").otherwise(status).alias("status"), basis.alias("complete_basis"), speed.alias("words_per_sec"))
    return parts, judged.where("rejected is not null").select(*key, "source", "rejected")


def audio_variants(probes: DataFrame) -> DataFrame:
    """Probes (identity, scope, part, sha256, seen_at, failed) with the variant number of their content, by first sight."""
    first = probes.where("not failed").groupBy("identity", "scope", "part", "sha256").agg(F.min("seen_at").alias("first_seen"), F.count("*").alias("probes"))
    w = Window.partitionBy("identity", "scope", "part").orderBy("first_seen", "sha256")
    return first.withColumn("variant", F.dense_rank().over(w))


def catalog(parts: dict[str, DataFrame]) -> DataFrame:
    """Entries (public_id, kind, identity_fields map) of several kinds of frames, whose first column is the id."""
    out = None
    for kind, df in parts.items():
        rest = df.columns[1:]
        identity = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))])
        part = df.select(F.concat(F.lit(f"{kind}:"), F.col(df.columns[0]).cast("string")).alias("public_id"), F.lit(kind).alias("kind"), identity.alias("identity_fields"))
        out = part if out is None else out.unionByName(part)
    return out
