"""Value-free shapes of JSON payloads of any nesting, and their differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels that are walked; a list or object below them is a path of the kind `deeper`.
DEPTH = 24
#: What may stand at a path, in order.
KINDS = ["bool", "deeper", "dict", "empty list", "float", "int", "list", "malformed", "none", "str"]
NODES = "array<struct<path:string,parent:string,v:variant>>"


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column) -> Column:
    """none, bool, int, float, str, dict, list or empty list. Whole numbers beyond 64 bits are int up to 38 digits, then float."""
    scalar = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "none")
        .when(_fields(v).isNotNull(), "dict")
        .when(_elements(v).isNotNull(), F.when(F.size(_elements(v)) == 0, "empty list").otherwise("list"))
        .when(scalar == "BOOLEAN", "bool")
        .when((scalar == "BIGINT") | scalar.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$"), "int")
        .when(scalar.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .otherwise("str")
    )


def _below(n: Column) -> Column:
    def child(path: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), n["path"].alias("parent"), v.alias("v"))

    # a key with a dot or brackets stands quoted, so that no two paths meet
    named = F.transform(F.map_entries(_fields(n["v"])), lambda e: child(F.concat(n["path"], F.lit("."), F.when(e["key"].rlike(r'[.\[\]"]|^$'), F.to_json(F.array(e["key"]))).otherwise(e["key"])), e["value"]))
    listed = F.transform(_elements(n["v"]), lambda x: child(F.concat(n["path"], F.lit("[]")), x))
    return F.coalesce(named.cast(NODES), listed.cast(NODES), F.array().cast(NODES))


def payload_paths(rows: DataFrame, key: str, payload: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, parent, kinds): every path of each payload with the distinct kinds of what stands there, sorted.

    The root is `$`, a member `.name`, all elements of a list `[]`. Values do not appear. A null payload gives no rows, one that is no
    JSON the kind `malformed` at `$`. Paths below `depth` levels are not walked: where something lies there, the path has
    the kind `deeper` besides its own. Rows of one key are merged.
    """
    root = F.array(F.struct(F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.col("v"))).cast(NODES)
    last = lambda found: F.element_at(found, -1)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(root).cast(f"array<{NODES}>"), lambda found, _: F.when(F.size(last(found)) == 0, found).otherwise(F.concat(found, F.array(F.flatten(F.transform(last(found), _below))))))
    held = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{payload}`").alias("text")).where("text is not null").withColumn("v", F.try_parse_json("text"))
    # what a node is, is told outside of the walk, where each row is compiled; a parent is a beginning of its path
    nodes = held.select("key", F.posexplode(walk).alias("at", "level")).select("key", "at", F.inline("level"))
    kind = F.when(F.col("v").isNull(), "malformed").otherwise(_kind(F.col("v")))
    found = nodes.select("key", "path", F.length("parent").alias("up"), "at", "v", kind.alias("kind"))
    bit = reduce(lambda out, k: out.when(F.col("kind") == k, 1 << KINDS.index(k)), KINDS, F.when(F.lit(False), 0))
    more = (F.col("at") == depth) & (F.size(_below(F.struct("path", "v"))) > 0)
    found = found.select("key", "path", "up", bit.bitwiseOR(F.when(more, 1 << KINDS.index("deeper")).otherwise(0)).alias("bits"))
    each = found.groupBy("key", "path").agg(F.max("up").alias("up"), F.bit_or("bits").alias("bits"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << n) > 0, k) for n, k in enumerate(KINDS)]))
    return each.select("key", "path", F.when(F.col("up").isNotNull(), F.substring("path", F.lit(1), F.col("up"))).alias("parent"), kinds.alias("kinds"))


def fingerprints(paths: DataFrame) -> DataFrame:
    """(key, fingerprint) of the payloads' paths and kinds: equal for equal shapes, whatever the values and the order of members.

    A payload has as many paths as its file has different ones, which its size bounds."""
    lines = F.array_sort(F.collect_list(F.concat(F.col("path"), F.lit(":"), F.array_join("kinds", "|"))))
    return paths.groupBy("key").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def shape_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, path, change, before, after) between two frames of payload_paths: the paths that are `removed`, `added` or of
    other kinds (`kind`). What lies below a removed or added path is not told again. A key on one side only is all removed or added."""
    both = before.select("key", "path", F.col("parent").alias("p1"), F.col("kinds").alias("before")).join(after.select("key", "path", F.col("parent").alias("p2"), F.col("kinds").alias("after")), ["key", "path"], "full")
    change = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "kind")
    found = both.select("key", "path", F.coalesce("p1", "p2").alias("parent"), change.alias("change"), "before", "after").where("change is not null")
    # at each removed or added path its own row meets those of its members, which then are not told; both are read once
    gone = F.col("change") != "kind"
    place = F.when(gone, F.array(F.struct(F.col("path").alias("at"), F.lit(True).alias("own")), F.struct(F.col("parent").alias("at"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("at"), F.lit(False).alias("own"))))
    met = found.withColumn("place", F.explode(place)).select("key", "path", "change", "before", "after", "place.*")
    told = met.withColumn("below", F.bool_or("own").over(Window.partitionBy("key", "change", "at"))).where("not own and (at is null or not below)")
    return told.select("key", "path", "change", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))
