"""Grouped reports: coverage, counts by state, duplicates, roll-ups and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperglass.operators.relations import ancestor_nodes, ancestors, code_key


def question_facts(questions: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, child_count, topic_count, has_asset) of every question."""
    children = questions.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("child_count"))
    topics = links.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("topic_count"))
    figures = assets.select(F.col("question_id").alias("id")).distinct().withColumn("has_asset", F.lit(True))
    out = questions.select("id").join(children, "id", "left").join(topics, "id", "left").join(figures, "id", "left")
    return out.select("id", F.coalesce("child_count", F.lit(0)).alias("child_count"), F.coalesce("topic_count", F.lit(0)).alias("topic_count"), F.coalesce("has_asset", F.lit(False)).alias("has_asset"))


def provenance_coverage(subjects: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject_type, total, linked, edges, ratio): distinct linked subjects over all, at most 1 and 0 without any."""
    total = subjects.groupBy("subject_type").agg(F.count("*").alias("total"))
    linked = edges.groupBy("subject_type").agg(F.count_distinct("subject_id").alias("linked"), F.count("*").alias("edges"))
    out = total.join(linked, "subject_type", "left").fillna(0, ["linked", "edges"])
    return out.withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("linked") / F.col("total")), 4)))


def counts_by_state(rows: DataFrame, key: list[str], states: dict[str, Column]) -> DataFrame:
    """Rows of each key and how many meet each named condition."""
    return rows.groupBy(*key).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in states.items()])


def board_status(boards: DataFrame, documents: DataFrame, papers: DataFrame, questions: DataFrame, findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row a board: documents, papers, questions, failed, open_errors, open_reviews, and the shares parsed_ratio,
    questions_per_paper and healthy.

    Documents: (id, board, status), failed where the status is `failed`, parsed where it is `parsed`. Papers (id, document_id),
    questions (paper_id), findings (document_id, severity, status): open errors are open ones of severity error or critical.
    Reviews (document_id, status). Each table is counted by document before it meets the next, so no count multiplies another. A
    board without documents has zeros; its shares, as all shares of nothing, are null, not zero. A board is healthy if it has
    documents, none failed and no open error; without documents that is unknown (null). A document of a board that is not listed
    is left out, as are rows that name no document.
    """
    per_paper = questions.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("questions"))
    per_doc = papers.join(per_paper, "id", "left").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("papers"), F.sum("questions").alias("questions"))
    bad = findings.where((F.col("status") == "open") & F.col("severity").isin("error", "critical")).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("open_errors"))
    waiting = reviews.where(F.col("status") == "open").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("open_reviews"))
    docs = documents.select("id", "board", F.coalesce("status", F.lit("")).alias("status")).join(per_doc, "id", "left").join(bad, "id", "left").join(waiting, "id", "left")
    counts = ["papers", "questions", "open_errors", "open_reviews"]
    by_board = docs.groupBy("board").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "parsed").alias("parsed"), *[F.sum(c).alias(c) for c in counts])
    out = boards.select("board").join(by_board, "board", "left").fillna(0, ["documents", "failed", "parsed", *counts])
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    healthy = F.when(F.col("documents") > 0, (F.col("failed") == 0) & (F.col("open_errors") == 0))
    return out.select("board", "documents", "papers", "questions", "failed", "open_errors", "open_reviews", share("parsed", "documents").alias("parsed_ratio"), share("questions", "papers").alias("questions_per_paper"), healthy.alias("healthy"))


def entry_findings(entries: DataFrame) -> DataFrame:
    """(paper_id, number_path, rule, n) of mark-scheme entries (paper_id, number_path, marks): ms_duplicate_numbers (n entries of one
    number), ms_parent_child_marks_ambiguous (n entries below it have marks beside its own), ms_marks_missing (n without marks)."""
    by_path = entries.groupBy("paper_id", "number_path").agg(F.count("*").alias("n"), F.count("marks").alias("marked"))
    marked = by_path.where("marked > 0")
    below = marked.select("paper_id", F.explode(ancestors("number_path")).alias("number_path"), "marked").groupBy("paper_id", "number_path").agg(F.sum("marked").alias("below"))
    both = marked.select("paper_id", "number_path").join(below, ["paper_id", "number_path"])
    out = by_path.where("n > 1").select("paper_id", "number_path", F.lit("ms_duplicate_numbers").alias("rule"), "n")
    out = out.unionByName(both.select("paper_id", "number_path", F.lit("ms_parent_child_marks_ambiguous").alias("rule"), F.col("below").alias("n")))
    return out.unionByName(by_path.where("n > marked").select("paper_id", "number_path", F.lit("ms_marks_missing").alias("rule"), (F.col("n") - F.col("marked")).alias("n")))


def pivot_counts(rows: DataFrame, key: str, column: str, values: list) -> DataFrame:
    return rows.groupBy(key).pivot(column, values).count().fillna(0)


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def shared_content(rows: DataFrame, content: str, owner: str) -> DataFrame:
    """Contents on more than one owner, with the owners in order."""
    found = rows.select(content, owner).distinct().groupBy(content).agg(F.array_sort(F.collect_set(owner)).alias("owners"))
    return found.where(F.size("owners") > 1)


def native_id_conflicts(rows: DataFrame, key: list[str], content: Column) -> DataFrame:
    """Repeated ids: `identical` if all hold one content, else `different`."""
    g = rows.withColumn("_c", content).groupBy(*key).agg(F.count("*").alias("n"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("n > 1")
    return g.withColumn("verdict", F.when(F.col("_lo") == F.col("_hi"), "identical").otherwise("different")).drop("_lo", "_hi")


def inconsistent_titles(rows: DataFrame, label: str, title: str, ruled: DataFrame) -> DataFrame:
    """Labels with several titles, unless a ruling lists them."""
    found = rows.groupBy(label).agg(F.count_distinct(title).alias("titles")).where("titles > 1")
    return found.join(ruled.select(label).distinct(), label, "left_anti")


def topic_tree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, code, parent_id, direct, subtree): distinct questions of each node and of its subtree."""
    direct = links.groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("question_id").alias("direct"))
    up = links.join(ancestor_nodes(nodes.select("id", "parent_id")).select(F.col("id").alias("node_id"), "ancestor_id"), "node_id")
    subtree = up.groupBy(F.col("ancestor_id").alias("id")).agg(F.count_distinct("question_id").alias("subtree"))
    out = nodes.join(direct, "id", "left").join(subtree, "id", "left")
    return out.select("id", "code", "parent_id", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("subtree", F.lit(0)).alias("subtree"))


def tag_overview(nodes: DataFrame, links: DataFrame, board: str, subject: str | None = None, include_zero: bool = True) -> DataFrame:
    """topic_tree() of one board's nodes (id, code, parent_id, board, subject), in the natural order of their codes.

    A node has the subject of its nearest ancestor that has one, itself first; with a subject only its nodes are left. Without zeros,
    nodes whose subtree has no question go. Nodes of other boards and of none are not part of any tree.
    """
    own = nodes.where(F.col("board") == board)
    above = ancestor_nodes(own.select("id", "parent_id")).join(own.select(F.col("id").alias("ancestor_id"), "subject"), "ancestor_id").where("subject is not null")
    inherited = above.groupBy("id").agg(F.min_by("subject", "distance").alias("subject"))
    out = topic_tree(own.select("id", "code", "parent_id"), links.join(own.select(F.col("id").alias("node_id")), "node_id", "left_semi")).join(inherited, "id", "left")
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    if not include_zero:
        out = out.where("subtree > 0")
    return out.withColumn("sort_code", code_key(F.col("code"))).orderBy("sort_code", "id")


def nested_topics(tree: DataFrame, levels: int = 8) -> DataFrame:
    """(id, tree): each root of a topic_tree() with its children and theirs, down `levels` levels, in the natural order of codes."""
    fields = ["sort_code", "id", "code", "direct", "subtree"]
    nodes, below = tree.withColumn("sort_code", code_key(F.col("code"))), None
    for _ in range(levels):
        held = nodes if below is None else nodes.join(below, "id", "left")
        own = fields if below is None else [*fields, "children"]
        below = held.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("children"))
    return nodes.where("parent_id is null").join(below, "id", "left").select("id", F.struct(*fields, "children").alias("tree"))


def marks_rollup(questions: DataFrame) -> DataFrame:
    """(id, declared, children, status): a parent's marks against its children's sum; ambiguous where a child has none."""
    sums = questions.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("marks").cast("long").alias("children"), F.count_if(F.col("marks").isNull()).alias("_open"))
    joined = questions.select("id", F.col("marks").alias("declared")).join(sums, "id")
    status = F.when((F.col("_open") > 0) | F.col("children").isNull(), "ambiguous").when(F.col("declared").isNull(), "undeclared").when(F.col("declared") == F.col("children"), "equal").otherwise("different")
    return joined.select("id", "declared", "children", status.alias("status"))


def paper_totals(questions: DataFrame, declared: DataFrame) -> DataFrame:
    """(paper_id, total, declared, status): the marks of a paper's questions (id, paper_id, parent_id, marks) against its declared total.

    A question counts its own marks, else those of its parts, level by level; it is ambiguous if it has neither, if only some of its parts have
    marks, or if its own marks differ from its parts' sum. A paper's total is known only without ambiguous questions.
    """
    nodes = questions.select("id", "paper_id", "parent_id", "marks")
    known = nodes.select("id", "paper_id", "parent_id", "marks", F.col("marks").cast("long").alias("value"), F.col("marks").isNull().alias("doubt"))
    for _ in range(3):
        parts = known.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("value").alias("_sum"), F.bool_or("doubt").alias("_doubt"))
        j = nodes.join(parts, "id", "left")
        has = F.col("_doubt").isNotNull()
        value = F.coalesce(F.col("marks").cast("long"), F.col("_sum"))
        doubt = F.when(has, F.col("_doubt") | (F.col("marks").isNotNull() & (F.col("marks") != F.col("_sum")))).otherwise(F.col("marks").isNull())
        known = j.select("id", "paper_id", "parent_id", "marks", value.alias("value"), doubt.alias("doubt"))
    total = known.where("parent_id is null").groupBy("paper_id").agg(F.sum("value").alias("_total"), F.bool_or("doubt").alias("_doubt"))
    out = total.withColumn("total", F.when(~F.col("_doubt"), F.col("_total"))).join(declared.select("paper_id", "declared"), "paper_id", "left")
    status = F.when(F.col("_doubt"), "ambiguous").when(F.col("declared").isNull(), "undeclared").when(F.col("declared") == F.col("total"), "equal").otherwise("different")
    return out.select("paper_id", "total", "declared", status.alias("status"))


def paper_tree(questions: DataFrame, levels: int = 4) -> DataFrame:
    """(paper_id, tree): the roots of each paper, each with its children and theirs, down `levels` levels below the roots, in
    display order. Questions deeper than that raise an error when the tree is read, so none is lost without a word."""
    own = ["display_order", "id", "number_path"]
    nodes = questions.select("paper_id", "parent_id", *own)
    below = None
    for _ in range(levels):
        held = nodes if below is None else nodes.join(below, "id", "left")
        fields = own if below is None else [*own, "children"]
        below = held.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    depth = F.length("number_path") - F.length(F.replace(F.col("number_path"), F.lit("("), F.lit("")))
    fits = F.when(F.max(depth) > levels, F.raise_error(F.lit(f"a question is more than {levels} levels deep"))).otherwise(F.lit(True))
    roots = nodes.where("parent_id is null").join(below, "id", "left")
    trees = roots.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(*own, "children"))).alias("tree"))
    checked = nodes.groupBy("paper_id").agg(fits.alias("fits"))
    return trees.join(checked, "paper_id").where("fits").select("paper_id", "tree")


def snapshot(questions: DataFrame, entries: DataFrame, assets: DataFrame) -> DataFrame:
    """Metrics of every document (paper_id): questions, roots, depth, root marks, assets, entries, linked, repeated paths."""
    q = questions.groupBy("paper_id").agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.max("depth").cast("long").alias("max_depth"),
        F.coalesce(F.sum(F.when(F.col("parent_id").isNull(), F.col("marks"))), F.lit(0)).cast("long").alias("marks_sum"),
        (F.count("number_path") - F.count_distinct("number_path")).alias("duplicate_paths"),
    )
    e = entries.groupBy("paper_id").agg(F.count("*").alias("mark_scheme_entries"), F.count("question_id").alias("entries_linked"))
    a = assets.join(questions.select(F.col("id").alias("question_id"), "paper_id"), "question_id").groupBy("paper_id").agg(F.count("*").alias("assets"))
    return q.join(e, "paper_id", "left").join(a, "paper_id", "left").fillna(0)


#: Falls beyond these shares are regressions (fixed values).
TOLERANCES = {"questions": 0.05, "roots": 0.05, "marks_sum": 0.05, "assets": 0.10, "mark_scheme_entries": 0.05, "entries_linked": 0.05}


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, field, before, after, delta, ratio, regression, reason): fields that differ between two snapshots of a document.

    A document that one side lacks has zeros there. It is a regression if a value falls beyond its tolerance, if links or
    questions fall to zero, or if repeated paths grow."""
    fields = [*TOLERANCES, "duplicate_paths"]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot([key], fields, "field", name)

    both = long(before, "before").join(long(after, "after"), [key, "field"], "full_outer").fillna(0, ["before", "after"]).where("before <> after")
    tolerance = F.element_at(F.create_map(*[F.lit(x) for kv in TOLERANCES.items() for x in kv]), F.col("field"))
    fell = (F.col("before") > 0) & (F.col("after") < F.col("before") * (1 - tolerance))
    gone = F.col("field").isin("entries_linked", "questions") & (F.col("before") > 0) & (F.col("after") == 0)
    grew = (F.col("field") == "duplicate_paths") & (F.col("after") > F.col("before"))
    reason = F.when(gone, F.concat(F.col("field"), F.lit("_to_zero"))).when(fell, "dropped").when(grew, "duplicates_up")
    base = F.greatest(F.abs("before"), F.lit(1))
    return both.select(key, "field", "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.round((F.col("after") - F.col("before")) / base, 4).alias("ratio"), reason.isNotNull().alias("regression"), reason.alias("reason"))


def agreement(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """How two rankings (id, group, code, rank) agree by group: questions, coverage, same first, any shared, first in top 3."""
    first_a = a.where("rank = 1").select("id", group, F.col("code").alias("code_a"))
    own = b.groupBy("id").agg(F.min(F.when(F.col("rank") == 1, F.col("code"))).alias("first_b"), F.collect_set("code").alias("codes_b"))
    codes_a = a.groupBy("id").agg(F.collect_set("code").alias("codes_a"))
    j = first_a.join(codes_a, "id").join(own, "id", "left")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return j.groupBy(group).agg(
        F.count("*").alias("questions"),
        share(F.col("first_b").isNotNull()).alias("coverage"),
        share(F.coalesce(F.col("first_b") == F.col("code_a"), F.lit(False))).alias("top1"),
        share(F.coalesce(F.arrays_overlap("codes_a", "codes_b"), F.lit(False))).alias("any"),
        share(F.coalesce(F.array_contains("codes_b", F.col("code_a")), F.lit(False))).alias("top3"),
    )


def distribution(rows: DataFrame, value: str, by: list[list[str]]) -> DataFrame:
    """Counts of a value over several groupings at once; columns outside a grouping are null."""
    columns = list(dict.fromkeys(c for g in by for c in g))
    sets = [[F.col(c) for c in (*g, value)] for g in by]
    return rows.groupingSets(sets, *[F.col(c) for c in (*columns, value)]).agg(F.count("*").alias("n"))


def all_of(rows: DataFrame, key: list[str], conditions: list[Column]) -> DataFrame:
    """Whether every row of a key meets all conditions that apply; a null condition does not apply."""
    met = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in conditions])
    return rows.withColumn("_m", met).groupBy(*key).agg(F.bool_and("_m").alias("complete"), F.count("*").alias("units"))
