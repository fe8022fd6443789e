"""Canonical tables from the nested files of four examination systems.

Files are read as Variant values: every member is asked for by path and type, and one of another type is as good as absent, so
no file can fail a job. A mapping says for each system where containers, questions and their members stand; the same
steps then give courses, containers, questions, answers, assets and regions, and every irregularity is a row of problems.
Nothing is made up: an absent answer, hash, date or page stays absent.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperglass.sources.tables import written

#: Levels of parts below a question that are read; deeper ones are a problem row of their question.
DEPTH = 8
SYSTEMS = ("cie", "edexcel", "ielts", "toefl")
PROBLEM = "array<struct<code:string,scope:string,native_ref:string,detail:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a system keeps the members of a question, and the members that its files may have at the top."""

    id: tuple[str, ...] = ("$.question",)
    parts: tuple[str, ...] = ()
    stem: tuple[str, ...] = ("$.text",)
    members: tuple[str, ...] = ()


_TOP = ("fixture_kind", "schema_version", "board", "dataset_revision", "coordinate_system", "pages")
MAPPINGS = {
    "cie": Mapping(parts=("$.parts",), members=(*_TOP, "identity", "documents", "questions", "answer_resolution")),
    "edexcel": Mapping(members=(*_TOP, "subjects")),
    "ielts": Mapping(("$.native_id", "$.question"), ("$.children", "$.parts"), ("$.prompt", "$.text"), (*_TOP, "book", "documents", "questions")),
    "toefl": Mapping(("$.native_id",), (), ("$.prompt",), (*_TOP, "sets")),
}


def _text(v: Column, path: str) -> Column:
    """A member as text, objects and lists as JSON; null for null and absent."""
    return F.try_variant_get(v, path, "string")


def _any_text(v: Column, paths: tuple[str, ...]) -> Column:
    """The first member that is there and not empty."""
    return F.coalesce(*(F.nullif(_text(v, p), F.lit("")) for p in paths), F.lit(None).cast("string"))


def _items(v: Column, *paths: str) -> Column:
    """The first non-empty list among the members, else an empty one."""
    lists = [F.try_variant_get(v, p, "array<variant>") for p in paths]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<variant>"))


def _whole(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "int")


def _problem(when: Column, code: str, scope: str, ref: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(scope).alias("scope"), (none if ref is None else ref).alias("native_ref"), (none if detail is None else detail).alias("detail")))


def _found(*problems: Column) -> Column:
    return F.filter(F.array(*problems), lambda p: p.isNotNull())


def files(raw: DataFrame) -> DataFrame:
    """(source_id, system, doc, problems) of raw files (source_id, system, payload); doc is null where a file cannot be used."""
    doc = F.try_parse_json("payload")
    version = _text(F.col("v"), "$.schema_version")
    strict = F.coalesce(F.col("system"), F.lit("")).isin("cie", "edexcel")
    keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    known = F.create_map(*(x for s in SYSTEMS for x in (F.lit(s), F.array(*map(F.lit, MAPPINGS[s].members)))))
    parsed = raw.select("source_id", "system", "payload", doc.alias("v")).select("*", keys.alias("keys"))
    odd_kind = _text(F.col("v"), "$.fixture_kind").isNull() | (_text(F.col("v"), "$.fixture_kind") != "synthetic")
    odd_version = ~F.coalesce(version, F.when(strict, F.lit("None")).otherwise("1")).eqNullSafe("1")
    fatal = (
        F.when(F.col("payload").isNull(), F.when(strict, F.lit("missing_index")).otherwise("missing_source"))
        .when(F.col("keys").isNull(), "invalid_json")
        .when(~F.coalesce(F.col("system"), F.lit("")).isin(*SYSTEMS), "unknown_system")
        .when(odd_kind, F.when(strict, F.lit("wrong_fixture_kind")).otherwise("wrong_source_kind"))
        .when(strict & odd_version, "unsupported_schema_version")
    )
    marked = parsed.withColumn("fatal", fatal)
    extra = F.transform(
        F.array_except("keys", F.coalesce(F.try_element_at(known, F.col("system")), F.array())), lambda k: F.struct(F.lit("unexpected_member").alias("code"), F.lit("system").alias("scope"), F.lit(None).cast("string").alias("native_ref"), k.alias("detail"))
    )
    own = F.when(F.col("fatal").isNotNull(), F.array(F.struct(F.col("fatal").alias("code"), F.lit("system").alias("scope"), F.lit(None).cast("string").alias("native_ref"), F.lit(None).cast("string").alias("detail")))).otherwise(
        F.concat(extra, _found(_problem(odd_version, "unsupported_schema_version", "system", detail=version)))
    )
    return marked.select("source_id", "system", F.when(F.col("fatal").isNull(), F.col("v")).alias("doc"), own.cast(PROBLEM).alias("problems"))


def _native(v: dict[str, Column]) -> Column:
    """A native identity as JSON, absent members as null."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in v.items())), {"ignoreNullFields": "false"})


def _has_role(documents: Column, role: str) -> Column:
    return F.exists(documents, lambda d: _text(d, "$.role").eqNullSafe(role))


def _containers(docs: DataFrame) -> DataFrame:
    """The containers of usable files with their raw members."""
    common = ["source_id", "system", _items(F.col("doc"), "$.pages").alias("pages"), _text(F.col("doc"), "$.coordinate_system").alias("coordinate_system")]
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<variant>")

    def lacking(documents: Column) -> Column:
        return _found(*(_problem(~_has_role(documents, role), code, "container", detail=F.lit(role)) for role, code in (("qp", "missing_document_role"), ("ms", "missing_ms"))))

    d = F.col("doc")
    cie = docs.where("system = 'cie' and doc is not null").select(
        *common, F.lit("paper").alias("kind"), _native({k: _text(d, f"$.identity.{k}") for k in ("subject", "year", "season", "paper", "date")}).alias("native"),
        _items(d, "$.documents").alias("documents"), _items(d, "$.questions").alias("questions"), empty.alias("regions"), none.alias("ref"), none.alias("revision"),
        F.lower(_text(d, "$.answer_resolution.default_mode")).alias("mode"),
        F.concat(lacking(_items(d, "$.documents")), _found(_problem(_text(d, "$.identity.date").isNull(), "unknown_date", "container", detail=_text(d, "$.identity.date_unknown_reason")))).alias("problems"),
    )
    unit, subject = F.col("unit"), F.col("subject")
    sessions = F.filter(_items(unit, "$.sessions"), lambda s: _text(s, "$.date").isNull())
    undated = F.transform(sessions, lambda s: F.struct(F.lit("unknown_date").alias("code"), F.lit("container").alias("scope"), none.alias("native_ref"), _text(s, "$.date_unknown_reason").alias("detail")))
    units = docs.where("system = 'edexcel' and doc is not null").select("*", F.explode(_items(d, "$.subjects")).alias("subject")).select("*", F.explode(_items(subject, "$.units")).alias("unit"))
    edexcel = units.select(
        *common, F.lit("paper").alias("kind"),
        _native({"qualification_level": _text(subject, "$.qualification_level"), "unit_code": _text(unit, "$.unit_code"), "paper_code": _text(unit, "$.paper_code")}).alias("native"),
        _items(unit, "$.documents").alias("documents"), empty.alias("questions"), _items(unit, "$.regions").alias("regions"), _text(unit, "$.native_id").alias("ref"), none.alias("revision"), none.alias("mode"),
        F.concat(lacking(_items(unit, "$.documents")), undated).alias("problems"),
    )
    book = _text(d, "$.book.native_id")
    uncertain = F.coalesce(F.try_variant_get(d, "$.book.edition_uncertain", "boolean"), F.lit(False)) | F.is_variant_null(F.try_variant_get(d, "$.book.edition", "variant"))
    unhashed = F.transform(
        F.filter(_items(d, "$.documents"), lambda x: _any_text(x, ("$.sha256",)).isNull()),
        lambda x: F.struct(F.lit("missing_document_hash").alias("code"), F.lit("container").alias("scope"), _text(x, "$.role").alias("native_ref"), none.alias("detail")),
    )
    ielts = docs.where("system = 'ielts' and doc is not null").select(
        *common, F.lit("book").alias("kind"), _native({"book": book, "revision": _text(d, "$.dataset_revision")}).alias("native"), _items(d, "$.documents").alias("documents"),
        _items(d, "$.questions").alias("questions"), empty.alias("regions"), book.alias("ref"), _text(d, "$.dataset_revision").alias("revision"), none.alias("mode"),
        F.concat(unhashed, _found(_problem(uncertain, "unresolved_edition", "container", book))).alias("problems"),
    )
    one = F.col("one")
    name, restricted = _text(one, "$.native_id"), F.coalesce(F.try_variant_get(one, "$.restricted", "boolean"), F.lit(False))
    link = F.trim(F.coalesce(_text(one, "$.kmf_url"), F.lit("")))
    # a detail page, perhaps with anchors
    valid = link.rlike(r"^https://[^/?#]+/+detail/+read/+[\p{L}\p{N}]+\.html(/+[\p{L}\p{N}]+)*/*([?#].*)?$")
    sets = docs.where("system = 'toefl' and doc is not null").select("*", F.explode(_items(d, "$.sets")).alias("one"))
    toefl = sets.select(
        *common, F.lit("set").alias("kind"), _native({"set": name, "source_kind": F.coalesce(_any_text(one, ("$.source_kind",)), F.lit("unknown"))}).alias("native"), empty.alias("documents"),
        F.when(restricted, empty).otherwise(_items(one, "$.questions")).alias("questions"), empty.alias("regions"), name.alias("ref"), _text(d, "$.dataset_revision").alias("revision"), none.alias("mode"),
        _found(
            _problem(~valid, "invalid_kmf_url", "container", name), _problem(restricted, "restricted_source", "container", name, _text(one, "$.restricted_reason")),
            _problem(_text(one, "$.exam_date").isNull(), "unknown_date", "container", name, _text(one, "$.exam_date_unknown_reason")),
        ).alias("problems"),
    )
    return reduce(DataFrame.unionByName, [x.withColumn("problems", F.col("problems").cast(PROBLEM)) for x in (cie, edexcel, ielts, toefl)])


def _stated(node: Column) -> Column:
    """Whether a question states an answer of its own, or candidates for one."""
    return _text(node, "$.answer").isNotNull() | (F.size(_items(node, "$.answer_conflicts")) > 0)


def _nodes(containers: DataFrame, system: str) -> DataFrame:
    """A row for each question of a system, with its path and the answer of its nearest ancestor that states one."""
    m = MAPPINGS[system]
    kind = "array<struct<path:array<string>,parent:string,node:variant,above:string,above_ref:string>>"
    none = F.lit(None).cast("string")
    # a question without an id is no question; its parts go with it
    roots = F.transform(F.col("questions"), lambda q: F.struct(F.array(_any_text(q, m.id)).alias("path"), none.alias("parent"), q.alias("node"), none.alias("above"), none.alias("above_ref"))).cast(kind)

    def below(n: Column) -> Column:
        own, number = _stated(n["node"]), F.element_at(n["path"], -1)
        above, ref = F.when(own, _text(n["node"], "$.answer")).otherwise(n["above"]), F.when(own, number).otherwise(n["above_ref"])
        made = F.transform(
            _items(n["node"], *m.parts),
            lambda c: F.struct(F.concat(n["path"], F.array(_any_text(c, m.id))).alias("path"), number.alias("parent"), c.alias("node"), above.alias("above"), ref.alias("above_ref")),
        )
        return F.when(number.isNotNull(), made).otherwise(F.array()).cast(kind)

    levels = F.array(roots).cast(f"array<{kind}>")
    if m.parts:
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), levels, lambda found, _: F.concat(found, F.array(F.flatten(F.transform(F.element_at(found, -1), below)))).cast(f"array<{kind}>"))
    found = containers.where(F.col("system") == system).select("source_id", "system", "native", "mode", F.explode(F.flatten(levels)).alias("q"))
    number = F.element_at("q.path", -1)
    return found.select("source_id", "system", "native", "mode", number.alias("native_id"), F.col("q.path").alias("number_path"), F.col("q.parent").alias("parent_ref"), F.col("q.node").alias("node"), "q.above", "q.above_ref").withColumn(
        "parts", _items(F.col("node"), *m.parts) if m.parts else F.array().cast("array<variant>")
    )


def _typed(system: str, node: Column) -> Column:
    kind = _text(node, "$.kind")
    if system == "cie":
        return F.when(F.coalesce(F.size(F.map_keys(F.try_variant_get(node, "$.table", "map<string,variant>"))), F.lit(0)) > 0, "table_choice").otherwise("short_answer")
    choices = F.when(kind == "table_choice", "table_choice")
    if system == "ielts":
        return choices.when(kind == "grouped_alternatives", "single_choice").when(kind == "missing_answer_slot", "unknown").when(kind.isin("multiple_choice", "multiple_selection"), "multiple_choice").otherwise("short_answer")
    return choices.when(kind == "single_choice", "single_choice").when(kind.isin("multiple_choice", "multiple_selection"), "multiple_choice").otherwise("fill_blank")


def _texts(items: Column) -> Column:
    return F.transform(items, lambda x: _text(x, "$"))


def _answer(system: str, q: DataFrame) -> DataFrame:
    """The rows of `q` with `answer`, null where none is reachable, and `missing`, whether that is a gap."""
    node, number = F.col("node"), F.col("native_id")
    value, stated = _text(node, "$.answer"), _stated(node)
    alternatives = _texts(_items(node, "$.alternative_answers"))
    none, nobody = F.lit(None).cast("string"), F.array().cast("array<string>")
    conflicts = F.size(_items(node, "$.answer_conflicts"))

    def answer(original, others, order, method, operation, refs):
        return F.struct(original.alias("original_value"), others.alias("alternatives"), order.alias("ordering_rule"), method.alias("matching_method"), F.lit(operation).alias("operation"), refs.alias("parent_refs"), conflicts.alias("conflicts"))

    own = F.array(number)
    if system == "cie":
        asked = F.lower(_text(node, "$.answer_mode"))
        known = ("exact", "ancestor", "descendants", "none")
        fallback = F.when(F.col("mode").isin(*known), F.col("mode")).otherwise("exact")
        mode = F.when(asked.isNull(), fallback).when(asked.isin(*known), asked).otherwise("none")
        told = F.filter("parts", lambda c: _text(c, "$.answer").isNotNull() & _text(c, "$.question").isNotNull())
        found = (
            F.when(stated, answer(value, alternatives, none, F.when(F.size(alternatives) > 0, "grouped").otherwise("exact"), "adapter_exact_answer", own))
            .when((mode == "ancestor") & F.col("above").isNotNull(), answer(F.col("above"), nobody, none, F.lit("ancestor"), "adapter_ancestor_answer", F.array("above_ref")))
            .when(
                (mode == "descendants") & (F.size(told) > 0),
                answer(none, F.transform(told, lambda c: _text(c, "$.answer")), F.lit("descendant_order"), F.lit("descendants"), "adapter_descendants_answer", F.transform(told, lambda c: _text(c, "$.question"))),
            )
        )
        return q.withColumn("answer", found).withColumn("missing", F.col("answer").isNull() & (mode != "none")).withColumn("odd_mode", asked.isNotNull() & ~asked.isin(*known))
    if system == "ielts":
        slot = F.coalesce(F.try_variant_get(node, "$.missing_answer", "boolean"), F.lit(False))
        found = F.when(~slot & stated, answer(value, alternatives, none, F.when(F.size(alternatives) > 0, "grouped").otherwise("unresolved"), "adapter_answer_map", own))
    else:
        selected = _texts(_items(node, "$.selected"))
        count = F.coalesce(_whole(node, "$.selection_count"), F.greatest(F.size(selected), F.lit(1)))
        found = F.when(value.isNotNull(), answer(value, F.filter(selected, lambda x: x != value), none, F.when(count > 1, "in_any_order").otherwise("exact"), "adapter_answer_map", own))
    return q.withColumn("answer", found).withColumn("missing", F.lit(False)).withColumn("odd_mode", F.lit(False))


def _question_problems(system: str) -> Column:
    node, ref, answer = F.col("node"), F.col("native_id"), F.col("answer")
    images, kind = _items(node, "$.required_images"), _text(node, "$.kind")

    def each_image(unhashed_only: bool) -> Column:
        held = F.filter(images, lambda i: _any_text(i, ("$.sha256",)).isNull()) if unhashed_only else images
        return F.transform(held, lambda i: F.struct(F.lit("missing_asset").alias("code"), F.lit("asset").alias("scope"), ref.alias("native_ref"), _text(i, "$.role").alias("detail")))

    found = [_problem(F.size("number_path") > DEPTH, "too_deep", "question", ref) if MAPPINGS[system].parts else F.lit(None)]
    if system == "cie":
        found += [_problem(F.col("odd_mode"), "unresolved_answer_mode", "answer", ref, _text(node, "$.answer_mode")), _problem(F.col("missing"), "missing_answer", "question", ref)]
        rest = F.array()
    elif system == "ielts":
        self_parent = F.col("parent_ref").isNull() & (_text(node, "$.parent_native_id") == ref)
        found += [
            _problem(self_parent, "unresolved_identity", "question", ref),
            _problem(F.coalesce(F.try_variant_get(node, "$.missing_answer", "boolean"), F.lit(False)), "missing_answer_slot", "question", ref),
            _problem(answer.isNotNull() & (answer["conflicts"] > 1) & _text(node, "$.manual_decision").isNull(), "answer_conflict", "answer", ref),
        ]
        rest = each_image(False)
    else:
        table = F.size(_items(node, "$.table.columns")) * F.size(_items(node, "$.table.rows")) == 0
        found += [_problem((kind == "table_choice") & table, "missing_table", "question", ref), _problem(kind.isin("multiple_choice", "single_choice", "multiple_selection") & (F.size(_items(node, "$.options")) == 0), "missing_options", "question", ref)]
        rest = each_image(True)
    named = F.concat(_found(*found), rest)
    return F.when(ref.isNull(), _found(_problem(F.lit(True), "missing_native_id", "question", F.col("parent_ref")))).otherwise(named).cast(PROBLEM)


def _questions(containers: DataFrame) -> DataFrame:
    parts = []
    for system in ("cie", "ielts", "toefl"):
        node = F.col("node")
        q = _answer(system, _nodes(containers, system)).withColumn("problems", _question_problems(system))
        options = _items(node, "$.options")
        keys = F.when(_text(node, "$.kind") == "grouped_alternatives", F.filter(F.concat(F.array(_text(node, "$.answer")), _texts(_items(node, "$.alternative_answers"))), lambda x: x.isNotNull())).otherwise(_texts(options))
        images = F.transform(_items(node, "$.required_images"), lambda i: F.struct(_text(i, "$.role").alias("role"), _text(i, "$.sha256").alias("sha256")))
        parts.append(
            q.select(
                "source_id", "system", "native", "native_id", "number_path", "parent_ref", _typed(system, node).alias("question_type"), _any_text(node, MAPPINGS[system].stem).alias("stem"), _whole(node, "$.marks").alias("marks"),
                (F.array().cast("array<string>") if system == "cie" else keys).alias("options"), _texts(_items(node, "$.table.columns")).alias("columns"), F.size(_items(node, "$.table.rows")).alias("table_rows"),
                images.alias("images"), "answer", "problems", (_items(node, "$.regions") if system == "cie" else F.array().cast("array<variant>")).alias("regions"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _regions(containers: DataFrame) -> DataFrame:
    """A row for each raw region: of whole questions, not their parts, or of a unit. Rows keep their container's members, so nothing is joined."""
    held = containers.select("source_id", "system", "native", "documents", "pages", "coordinate_system", "questions", F.col("ref").alias("unit_ref"), F.col("regions").alias("unit_regions"))
    common = held.columns[:6]
    of_units = held.where(F.size("unit_regions") > 0).select(*common, F.col("unit_ref").alias("native_ref"), F.posexplode("unit_regions").alias("place", "region"))
    roots = held.where("system = 'cie'").select(*common, F.explode("questions").alias("q")).select(*common, _any_text(F.col("q"), MAPPINGS["cie"].id).alias("native_ref"), _items(F.col("q"), "$.regions").alias("found"))
    of_questions = roots.where("native_ref is not null").select(*common, "native_ref", F.posexplode("found").alias("place", "region"))
    rows = of_units.unionByName(of_questions)
    region, none = F.col("region"), F.lit(None).cast("string")
    role = F.coalesce(_any_text(region, ("$.document_role",)), F.lit("qp"))
    cited = F.lower(F.trim(_any_text(region, ("$.document_sha256",))))
    first = F.get(F.filter("documents", lambda d: _text(d, "$.role").eqNullSafe(F.col("role"))), F.lit(0))
    rows = rows.select("*", role.alias("role"), cited.alias("cited"), _whole(region, "$.page").alias("page"))
    rows = rows.withColumn("known", F.lower(F.trim(_any_text(first, ("$.sha256",)))))
    bbox = F.try_variant_get(region, "$.bbox", "array<double>")
    bbox = F.when(F.coalesce(F.exists(bbox, lambda x: x.isNull()), F.lit(True)), F.array().cast("array<double>")).otherwise(bbox)
    described = F.filter("pages", lambda p: _whole(p, "$.page") == F.col("page"))
    turned = F.try_variant_get(F.element_at(described, -1), "$.rotation_transform", "array<double>")  # the last of a page counts
    rows = rows.withColumn("bbox", bbox).withColumn("described", F.when(F.col("page").isNotNull(), F.size(described) > 0)).withColumn("rotation_transform", F.when(F.col("described"), turned))
    hash_ = F.coalesce("cited", "known")
    place = F.col("place").cast("string")
    problems = _found(
        _problem(F.coalesce(F.col("cited") != F.col("known"), F.lit(False)), "hash_conflict", "region", F.col("native_ref"), F.col("role")),
        _problem(hash_.isNull(), "missing_document_role", "region", F.col("native_ref"), F.col("role")),
        _problem(F.size("bbox") != 4, "missing_region_bbox", "region", F.col("native_ref"), place),
        _problem(F.coalesce(~F.col("described"), F.lit(False)) & (F.size("pages") > 0), "unknown_rotation", "region", F.col("native_ref"), F.col("page").cast("string")),
    )
    return rows.select("source_id", "system", "native", "native_ref", "place", F.col("role").alias("document_role"), hash_.alias("document_sha256"), "page", "bbox", "coordinate_system", "rotation_transform", problems.cast(PROBLEM).alias("problems"))


def _courses(docs: DataFrame) -> DataFrame:
    d, s, none = F.col("doc"), F.col("s"), F.lit(None).cast("string")
    usable = docs.where("doc is not null")
    code = _text(d, "$.identity.subject")
    alias = _any_text(d, ("$.identity.subject_alias",))
    years = F.filter(F.array(_whole(d, "$.identity.year")), lambda y: y.isNotNull())
    of_book = _text(d, "$.book.native_id")

    def course(native, qualification, name, aliases, version, applicable):
        return native.alias("native_code"), qualification.alias("qualification"), F.coalesce(name, native).alias("name"), aliases.alias("aliases"), version.alias("specification_version"), applicable.alias("applicable_years")

    nobody, never = F.array().cast("array<string>"), F.array().cast("array<int>")
    key = ["source_id", "system"]
    cie = usable.where("system = 'cie'").select(*key, *course(code, none, alias, F.filter(F.array(alias), lambda a: a.isNotNull()), none, years))
    ielts = usable.where("system = 'ielts'").select(*key, *course(of_book, none, _any_text(d, ("$.book.title",)), _texts(_items(d, "$.book.alias_ids")), none, never))
    subjects = usable.where("system = 'edexcel'").select(*key, F.explode(_items(d, "$.subjects")).alias("s"))
    edexcel = subjects.select(*key, *course(_text(s, "$.native_id"), _text(s, "$.qualification_level"), _any_text(s, ("$.title",)), _texts(_items(s, "$.alias_ids")), _text(s, "$.specification_code"), never))
    sets = usable.where("system = 'toefl'").select(*key, F.explode(_items(d, "$.sets")).alias("s"))
    kinds = sets.select(*key, F.coalesce(_any_text(s, ("$.source_kind",)), F.lit("unknown")).alias("kind")).distinct()
    toefl = kinds.select(*key, *course(F.col("kind"), none, none, nobody, none, never))
    return reduce(DataFrame.unionByName, [cie, edexcel, ielts, toefl])


def normalised(raw: DataFrame, name: str) -> DataFrame:
    """A canonical table of raw files (source_id, system, payload), by its name: courses, containers, questions, answers, assets,
    regions or problems.

    A file that is null, no JSON object, of an unknown system, of another kind or of an unsupported version gives one problem row
    and nothing else. Members of another type than the mapping asks for count as absent; members at the top that the
    mapping does not name are a problem row each. A question without an id is a problem row and gives no question. `native` is the
    container's native identity as JSON. Answers of parts may be inherited from the nearest ancestor that states one, or derived
    from the parts, as the file's mode says, and are marked so. Regions and problems write the parsed files and the
    containers to the shared folder first, the others are lazy.
    """
    docs = files(raw.select("source_id", "system", "payload"))
    several = name in ("regions", "problems")  # several branches go on from the files and from the containers: each once computed, once planned
    if several:
        docs = written(docs)
    if name == "courses":
        return _courses(docs)
    containers = _containers(docs)
    key = ["source_id", "system", "native"]
    if name == "containers":
        return containers.select(*key, "kind", "revision", F.size("documents").alias("documents"))
    if several:
        containers = written(containers)
    every = _questions(containers)
    questions = every.where("native_id is not null")
    if name == "questions":
        return questions.drop("answer", "problems", "regions", "images")
    if name == "answers":
        return questions.where("answer is not null").select(*key, F.col("native_id").alias("question_ref"), "answer.*")
    if name == "assets":
        return _assets(containers, questions)
    regions = _regions(containers)
    if name == "regions":
        return regions.drop("problems")
    if name == "problems":
        found = ((docs, F.lit(None).cast("string")), *((x, F.col("native")) for x in (containers, every, regions)))
        return reduce(DataFrame.unionByName, [x.select("source_id", "system", native.alias("native"), F.inline("problems")) for x, native in found])
    raise ValueError(f"no canonical table is called {name}")


def _assets(containers: DataFrame, questions: DataFrame) -> DataFrame:
    key = ["source_id", "system", "native"]
    document = F.col("d")
    documents = containers.where("system in ('cie', 'edexcel')").select(*key, F.explode("documents").alias("d")).where(_text(document, "$.role").isNotNull())
    media = _any_text(document, ("$.media_type",))
    listed = documents.select(
        *key, _text(document, "$.role").alias("role"), F.lower(F.trim(_any_text(document, ("$.sha256",)))).alias("sha256"), F.when(F.col("system") == "edexcel", F.coalesce(media, F.lit("application/pdf"))).otherwise(media).alias("media_type")
    )
    pictures = questions.where("system in ('ielts', 'toefl')").select(*key, F.explode("images").alias("i")).select(*key, "i.role", "i.sha256", F.lit(None).cast("string").alias("media_type"))
    return listed.unionByName(pictures)
