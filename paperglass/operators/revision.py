"""The revision of a table: one hash of its rows as a multiset, over a tree of bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.functions.text import sorted_json

#: Digits of a row's hash that name its group, level by level up to the root.
LEVELS = (6, 3, 0)


def revision_nodes(rows: DataFrame, digits: int = LEVELS[0]) -> DataFrame:
    """(place, node, rows): a hash for each group of rows whose hashes begin alike; `place` are those first digits.

    Equal rows are counted before they meet, so copies cost no memory. Hashes are even, so a group of the first level holds a
    16.7-millionth of the different rows and one above it at most 4,096 nodes, whatever the data.
    """
    leaf = rows.select(F.sha2(sorted_json({c: rows[f"`{c}`"] for c in rows.columns}, rows.schema), 256).alias("place"))
    nodes = leaf.groupBy("place").agg(F.count("*").alias("rows")).select("place", F.sha2(F.concat_ws(":", "place", F.col("rows").cast("string")), 256).alias("node"), "rows")
    for n in (n for n in LEVELS if n >= digits):
        inside = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("place", "node"))), ""), 256)
        place = F.substring("place", 1, n)
        up = nodes.groupBy(place.alias("_p")) if n else nodes
        nodes = up.agg(inside.alias("node"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        nodes = nodes.select(F.col("_p").alias("place") if n else F.lit("").alias("place"), "node", "rows")
    return nodes


def dataset_revision(rows: DataFrame) -> DataFrame:
    """(revision, rows) of a table: the same for any order of rows and columns and any partitioning, another if any value of any
    row, or how often a row comes, changes. An empty table has a revision too. Nulls are values; a column of nulls counts."""
    return revision_nodes(rows, 0).select(F.concat(F.lit("rev-"), F.substring("node", 1, 32)).alias("revision"), "rows")


def revision_changes(before: DataFrame, after: DataFrame, digits: int = LEVELS[1]) -> DataFrame:
    """(place, change, rows_before, rows_after) of the groups of rows that differ: added, removed or changed."""
    both = revision_nodes(before, digits).join(revision_nodes(after, digits).select("place", F.col("node").alias("node_after"), F.col("rows").alias("rows_after")), "place", "full_outer")
    change = F.when(F.col("node").isNull(), "added").when(F.col("node_after").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("node").eqNullSafe(F.col("node_after"))).select("place", change.alias("change"), F.col("rows").alias("rows_before"), "rows_after")
