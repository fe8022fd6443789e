"""Merkle manifest of a table by nested-interval labels.

Every row is a leaf with a rank in its group. A node is labelled by the interval of leaf ranks that it covers, so its
ancestors are the nodes whose intervals contain its own. Levels are handled in bands of eight: the nodes of a band come from one grouping of at
most 256 nodes of the level below it, ancestors are attached by containment joins bucketed by level, and the sibling of a node is what
is left of its parent's interval. The roots of the groups are the leaves of one more such tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperglass.llm.common import by_size, written

#: Levels of a band; a group of its building step has at most 2 ** BAND nodes.
BAND = 8
#: Paths above the first band up to which they are broadcast, at most about a kilobyte each.
BROADCAST_PATHS = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its count of UTF-8 bytes, a colon and the value, `-` for null, one behind another."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def folded(leaf: Column, proof: Column) -> Column:
    """The root, as hex text, that a leaf gives with its proof."""

    def up(below: Column, step: Column) -> Column:
        other = _hex(step["sibling"])
        return F.sha2(F.when(step["sibling"].isNull(), below).when(step["left"], F.concat(other, below)).otherwise(F.concat(below, other)), 256)

    return F.aggregate(proof, _hex(leaf), up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings' hex digests, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda s: s["sibling"].isNotNull()), lambda s: _hex(s["sibling"])), ""), 256)


def _ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """`leaves` (tree, ...) with their rank in the tree by `order` and the tree's height, without sorting a tree in one task."""
    keys = ["tree", *order, "_at"]  # rows equal in all else stand as they were read, so that none shares a task with all its copies
    ordered = leaves.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("_at")
    placed = written(placed, "ordered-leaves")
    runs = placed.groupBy("tree", "_part").agg(F.min("_pos").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(tree)
    height = F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)
    runs = written(runs.select("tree", "_part", (before - F.col("first")).alias("shift"), height.alias("top")), "leaf-runs")
    found = placed.join(by_size(runs), ["tree", "_part"])
    return found.withColumn("rank", F.col("_pos") + F.col("shift")).drop("_part", "_pos", "shift")


def _pairs(nodes: Column) -> Column:
    """The parents of a run of nodes: every two consecutive ones, the last perhaps alone."""

    def parent(i: Column) -> Column:
        a, b = F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), F.unhex(F.sha2(F.concat(_hex(a["digest"]), F.coalesce(_hex(b["digest"]), F.lit(""))), 256)).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), parent)


def _band(base: DataFrame, low: int) -> DataFrame:
    """All nodes (tree, top, level, lo, hi, digest) from level `low` to BAND above it or the tree's top, given those of `low`."""
    height = F.least(F.greatest(F.col("top") - low, F.lit(0)), F.lit(BAND))
    blocks = base.groupBy("tree", "top", F.shiftright("lo", low + BAND).alias("block")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("nodes"))
    steps = F.slice(F.sequence(F.lit(1), F.lit(BAND)), F.lit(1), height)
    levels = F.aggregate(steps, F.array("nodes"), lambda below, _: F.concat(below, F.array(_pairs(F.element_at(below, -1)))))
    labelled = F.transform(levels, lambda nodes, j: F.transform(nodes, lambda x: F.struct((j + low).alias("level"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))))
    return written(blocks.select("tree", "top", F.explode(F.flatten(labelled)).alias("node")).select("tree", "top", "node.*"), f"nodes-{low}")


def _bucket(lo: str, level: str) -> Column:
    """The place of a node among those of its level."""
    return F.expr(f"shiftright({lo}, {level})")


def _siblings(nodes: DataFrame, low: int) -> DataFrame:
    """(tree, level, bucket, lo, hi, left, sibling) of every node that has a parent in the band, sibling null where it is the only child."""
    inner = nodes.where(F.col("level") < F.least(F.col("top"), F.lit(low + BAND)))
    child = inner.select("tree", "level", "lo", "hi", (F.col("level") + 1).alias("above"), _bucket("lo", "level + 1").alias("place"))
    parent = nodes.where(F.col("level") > low).select(F.col("tree").alias("t"), F.col("level").alias("above_"), _bucket("lo", "level").alias("place_"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    inside = (F.col("tree") == F.col("t")) & (F.col("above") == F.col("above_")) & (F.col("place") == F.col("place_")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
    left = F.col("from") < F.col("lo")
    rest = child.join(parent, inside).select(
        "tree", "level", "lo", "hi", left.alias("left"), F.when(left, F.col("from")).otherwise(F.col("hi")).alias("rest_lo"), F.when(left, F.col("lo")).otherwise(F.col("to")).alias("rest_hi")
    )
    other = inner.select("tree", "level", F.col("lo").alias("rest_lo"), F.col("hi").alias("rest_hi"), F.col("digest").alias("sibling"))
    return rest.join(other, ["tree", "level", "rest_lo", "rest_hi"], "left").select("tree", "level", _bucket("lo", "level").alias("bucket"), "lo", "hi", "left", "sibling")


def _paths(nodes: DataFrame, low: int) -> DataFrame:
    """(tree, place, path) of the nodes of level `low`: the siblings that a proof needs inside the band, from below."""
    last = F.least(F.col("top"), F.lit(low + BAND)) - 1
    base = nodes.where((F.col("level") == low) & (last >= low)).select("tree", F.col("lo").alias("a"), F.col("hi").alias("b"), F.explode(F.sequence(F.lit(low), last)).alias("level"))
    base = base.withColumn("bucket", _bucket("a", "level"))
    held = base.join(_siblings(nodes, low), ["tree", "level", "bucket"]).where((F.col("lo") <= F.col("a")) & (F.col("b") <= F.col("hi")))
    return held.groupBy("tree", F.shiftright("a", low).alias("place")).agg(F.array_sort(F.collect_list(F.struct("level", "left", "sibling"))).alias("path"))


def _tree(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (tree, top, digest) of ranked leaves (tree, top, rank, digest), and the nodes of each band."""
    base = leaves.select("tree", "top", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    tallest = base.agg(F.max("top")).first()[0] or 0
    bands = []
    for low in range(0, max(1, tallest), BAND):
        bands.append(_band(base, low))
        base = bands[-1].where(F.col("level") == F.greatest(F.least(F.col("top"), F.lit(low + BAND)), F.lit(low)))
        # a tree that has ended goes on as its root
        base = base.select("tree", "top", "lo", "hi", "digest")
    return base.select("tree", "top", "digest"), bands


def _attached(leaves: DataFrame, roots: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """`leaves` with the columns of `roots` (tree, above, ...) and `proof`, the path to their root and the root's `above` behind it."""
    upper = roots.withColumn("place", F.lit(0).cast("long"))
    kept = [c for c in roots.columns if c not in ("tree", "above")]
    for k in range(len(bands) - 1, 0, -1):
        low = k * BAND
        nodes = bands[k].where(F.col("level") == low).select("tree", _bucket("lo", str(low)).alias("place"))
        own = nodes.join(_paths(bands[k], low), ["tree", "place"], "left").withColumn("block", F.shiftright("place", BAND))
        high = upper.withColumnRenamed("place", "block")
        upper = own.join(high, ["tree", "block"]).select("tree", "place", F.concat(F.coalesce("path", F.array()), "above").alias("above"), *kept)
    upper = written(upper.withColumnRenamed("place", "block"), "paths")
    if upper.count() <= BROADCAST_PATHS:
        upper = F.broadcast(upper)
    paths = _paths(bands[0], 0).withColumnRenamed("place", "rank")
    found = leaves.join(paths, ["tree", "rank"], "left").withColumn("block", F.shiftright("rank", BAND))
    return found.join(upper, ["tree", "block"]).withColumn("proof", F.concat(F.coalesce("path", F.array()), "above")).drop("path", "above", "block")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "lang", id_col: str = "doc_id", presented: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of `docs`: id, tree, rank, leaf, subroot, root (binary), presented (binary) and proof.

    Leaves of a group ascend by id, nulls first, and are paired level by level to the group's subroot; the subroots, by
    group, nulls first and bytewise, are paired to the root. `proof` lists (level, left, sibling) from the leaf to the
    root, sibling null for an only child. `presented` replaces columns by what somebody else holds; its digest goes with
    the row's proof and changes no tree. `tree` is the group as text behind `=`, empty for null. Rows of one id are ordered by
    their digest, equal rows among themselves anyhow, which changes no digest. Empty and very long texts are values like
    any other. Other columns of `docs` are not read, and their names do not matter. An empty table gives no rows.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    held = leaf_digest([(presented or {}).get(c, own[c]) for c in columns])
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = docs.select(F.col(f"`{id_col}`").alias("_id"), group.alias("tree"), leaf_digest(list(own.values())).alias("digest"), held.alias("presented"))
    ranked = _ranked(written(leaves, "leaves"), ["_id", "digest"])
    roots, bands = _tree(ranked)
    subroots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    tops = _ranked(subroots, ["group"])
    root, top_bands = _tree(tops)
    held_by = _attached(tops, root.select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<level:int,left:boolean,sibling:binary>>").alias("above")), top_bands)
    lifted = held_by.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("above"))
    found = _attached(ranked, lifted, bands)
    return found.select(F.col("_id").alias(id_col), "tree", "rank", F.col("digest").alias("leaf"), "subroot", "root", "presented", "proof")


def audit(docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "lang", id_col: str = "doc_id", presented: dict[str, Column] | None = None) -> DataFrame:
    """The manifest as hex text, each row's proof digested, and whether the presented row folds to the root with it."""
    rows = manifest(docs, columns, group_col, id_col, presented).withColumn("folded_root", folded(F.col("presented"), F.col("proof")))
    return rows.select(
        id_col, *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == _hex(F.col("root"))).alias("verified")
    )
