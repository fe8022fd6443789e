"""Near-duplicate documents: SimHash finds candidates under covering masks, exact shingle similarity confirms them.

Copies of one normalised text are collapsed to a kind. Kinds have several fingerprints of their distinct words; those that
agree under a covering mask and differ in few bits are candidates, and candidates form groups. Each kind of a group is
compared with the one in the group's middle, which settles copies of one text without comparing them with each other; what
is left has a second middle. Kinds that differ too much from the first middle are compared with those that differ in the same
shingles from the set m of what over half of the group hold: with D(x) the shingles that only one of x and m holds, u and x differ in
|D(u)| + |D(x)| - 2|D(u) & D(x)| shingles, which for a similar pair bounds the overlap of D(u) and D(x) from below, so a
prefix of each of them, the rarest first, must meet.
Links of enough similarity make components. Only narrow rows are shuffled, besides the shingle hashes of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperglass.llm.common import by_size, checkpointed, free_name, text_slices, written
from paperglass.llm.simhash import BITS, components, fingerprints, near_pairs, shingle_hashes, signed

#: Pairs of one partner that one task compares.
SHARE = 1_000


def _kinds(features: int, salts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                f = fingerprints(texts, features, salts, distinct=True).view(np.int64)
                digest = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in texts]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(f.reshape(-1)), len(salts)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(digest, pa.binary()), lists], names=["_id", "_h", "digest", "prints"])

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                nodes = batch.column(0).slice(lo, hi - lo).to_pylist()
                own = []
                for k, n in enumerate(nodes):
                    if n not in seen:  # a row that repeats is hashed once in a task
                        seen.add(n)
                        own.append(k)
                sets = [np.unique(shingle_hashes(texts[k], words)).view(np.int64) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in own], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def middles(members: DataFrame) -> DataFrame:
    """(root, centre): of each group, the node whose fingerprints are nearest to the group's majority of bits."""
    points = members.select("root", F.posexplode("prints").alias("salt", "fp"))
    ones = points.groupBy("root", "salt").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)))
    value = F.lit(0).cast("long")
    for b, v in enumerate(signed(np.uint64(1) << np.arange(BITS, dtype=np.uint64))):
        value = value.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(v)).otherwise(F.lit(0)))
    typical = ones.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("salt", value.alias("fp")))).alias("typical"))  # one for each salt
    far = F.aggregate(F.zip_with("prints", "typical", lambda a, b: F.bit_count(a.bitwiseXOR(b["fp"]))), F.lit(0), lambda acc, x: acc + x)
    return members.join(typical, "root").groupBy("root").agg(F.min(F.struct(far.alias("far"), "node")).getField("node").alias("centre"))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, near, m, n, plus, minus) of pairs (a, b): whether the Jaccard similarity is enough, the sizes of both sets and
    what only a and only b holds. A partner b of many pairs is dealt over as many parts as its pairs need."""
    parts = by_size(checkpointed(pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))))
    asked = by_size(checkpointed(pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))))
    left = asked.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    right = parts.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "y")
    both = left.join(right, ["b", "part"]).select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.array_except("x", "y").alias("plus"), F.array_except("y", "x").alias("minus"))
    return both.withColumn("near", F.col("m") - F.size("plus") >= similarity * (F.col("n") + F.size("plus")))


def typical(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, centre, label, m, plus, minus) with plus and minus against what over half of the centre's nodes hold, in place of
    the centre's own set, and with `t`: size less what a pair may differ in for each of its shingles.

    An element that many nodes add or lack is so no longer one that they have in common against the reference."""
    c = (1 - similarity) / (1 + similarity)
    sizes = by_size(checkpointed(rows.groupBy("centre").agg(F.count("*").alias("of"))))
    held = lambda side: rows.select("centre", F.explode(side).alias("e")).groupBy("centre", "e").agg(F.count("*").alias("df")).join(sizes, "centre").where("2 * df > of").groupBy("centre").agg(F.collect_list("e").alias(f"most_{side}"))
    most = by_size(checkpointed(held("plus").join(held("minus"), "centre", "full")))
    none = F.array().cast("array<long>")
    added, gone = F.coalesce("most_plus", none), F.coalesce("most_minus", none)
    plus = F.concat(F.array_except("plus", added), F.array_except(gone, "minus"))
    minus = F.concat(F.array_except("minus", gone), F.array_except(added, "plus"))
    moved = rows.join(most, "centre", "left").select("a", "centre", "near", "label", "m", plus.alias("plus"), minus.alias("minus"))
    return written(moved.withColumn("t", F.size("plus") + F.size("minus") - c * F.col("m")), "typical")


def left_over(first: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of one centre and other labels that may be similar. `first` is compared() with the centres.

    Nodes are described by what they add to and lack of a typical set of their group. With c = (1 - similarity) / (1 + similarity),
    u and x are similar if they have (t(u) + t(x)) / 2 differences in common, t = size - c * m. Where that is not above zero
    they are similar without any, and so are both with the node of least t, which stands for them all. Every other similar
    pair has a first common difference, additions before lacks and each by falling rarity, in a prefix of both. Of common
    additions there are (w(u) + w(x)) / 2 at least, w = adds - c * m, so the node of lesser w needs only a short prefix. Pairs
    without a common addition meet in what they lack, which bounds their similarity by sizes alone.
    """
    c, eps = (1 - similarity) / (1 + similarity), 1e-9
    rows = first.join(label, F.col("a") == F.col("node")).select("a", F.col("b").alias("centre"), "near", "label", "m", "plus", "minus")
    open_ = by_size(checkpointed(rows.where("not near").select("centre").distinct()))
    rows = typical(written(rows.join(open_, "centre", "left_semi"), "open"), similarity)
    least = by_size(checkpointed(rows.groupBy("centre").agg(F.min(F.struct("t", "a")).alias("l")).where("l.t <= 0").select("centre", F.col("l.t").alias("least_t"), F.col("l.a").alias("star"))))
    surely = F.coalesce(F.col("t") + F.col("least_t") <= -1e-6, F.lit(False))
    starred = rows.drop("plus", "minus").join(least, "centre").where(F.col("t") + F.col("least_t") <= eps)
    to_star = starred.where("a <> star").select(F.greatest("a", "star").alias("a"), F.least("a", "star").alias("b"))
    one = by_size(checkpointed(starred.where(surely).groupBy("centre").agg(F.min(F.when(F.col("near"), F.col("label"))).alias("near_label"), F.min("label").alias("any_label")).select("centre", F.coalesce("near_label", "any_label").alias("one"))))
    named = rows.join(least, "centre", "left").join(one, "centre", "left").withColumn("label", F.when(surely, F.col("one")).otherwise(F.col("label")))
    narrow = ["a", "centre", "label", "m", F.size("plus").alias("adds"), F.size("minus").alias("lacks"), "t"]
    each = named.select(*narrow, "plus", F.posexplode(F.concat("plus", "minus")).alias("at", "e")).withColumn("lack", F.col("at") >= F.col("adds")).drop("at", "plus")
    mixed = each.groupBy("centre", "e").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("centre", "e", "df")
    shared = each.join(mixed, ["centre", "e"])
    # what no two labels share stands first in every order, so places are counted from the end
    left = F.row_number().over(Window.partitionBy("a", "lack").orderBy(F.desc("df"), "e")) - 1
    size, w, others = F.when(F.col("lack"), F.col("lacks")).otherwise(F.col("adds")), F.col("adds") - c * F.col("m"), c / similarity * F.col("m")
    weight = F.when(F.col("lack"), F.col("t")).otherwise(w)
    placed = shared.withColumn("left", left).withColumn("weight", weight).where(~F.col("lack") | (w <= others + eps))
    x = placed.where(F.col("left") >= F.greatest(F.lit(1), F.ceil(F.col("weight") - eps)) - 1)
    u = placed.where(F.col("left") >= F.greatest(F.lit(1), F.ceil((F.col("weight") - others) / 2 - eps)) - 1)
    u = u.select("centre", "lack", "e", *(F.col(k).alias(f"u_{k}") for k in ("a", "label", "m", "adds", "lacks", "t", "left", "weight")))
    more = F.least("u_left", "left") + 1
    enough = (F.col("u_t") + F.col("t")) / 2 - eps
    by_sizes = F.col("u_adds") + F.col("adds") + F.abs(F.col("u_lacks") - F.col("lacks")) <= c * (F.col("u_m") + F.col("m")) + eps
    may = F.when(F.col("lack"), by_sizes & (more >= enough)).otherwise(more + F.least("u_lacks", "lacks") >= enough)
    alike = F.least("u_m", "m") >= similarity * F.greatest("u_m", "m") - eps
    met = u.join(x, ["centre", "lack", "e"]).where((F.col("u_label") != F.col("label")) & (F.struct("u_weight", "u_a") > F.struct("weight", "a")) & alike & may)
    return met.select(F.greatest("u_a", "a").alias("a"), F.least("u_a", "a").alias("b")).unionByName(to_star).distinct()


def _to_middle(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All members but the middles, compared with the middle of their group."""
    pairs = members.join(middles(members), "root").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    return written(compared(checkpointed(pairs), sets, similarity), "compared")


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, distance: int = 6, salts: tuple[int, ...] = tuple(range(5)), features: int = 1) -> tuple[DataFrame, DataFrame]:
    """Of docs (_id, text): rows (_id, _h, digest), and of each digest the least (_id, _h) of its group, `first`.

    Kinds are candidates if a mask keeps equal bits of fingerprints of one salt and these differ in at most `distance` bits.
    Of kinds that candidates connect, all pairs link whose sets of word shingles have the similarity. A text with fewer
    words is one shingle.
    """
    narrow = docs.select("_id", F.xxhash64("text").alias("_h"), "text")
    prints = written(narrow.mapInArrow(_kinds(features, np.array(salts, np.uint64)), f"_id {docs.schema['_id'].dataType.simpleString()}, _h long, digest binary, prints array<long>"), "prints")
    kinds = prints.groupBy("digest").agg(F.min(F.struct("_id", "_h")).alias("first"), F.first("prints").alias("prints"))
    kinds = written(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    points = kinds.select("node", F.posexplode("prints").alias("salt", "fp"))
    reps = points.groupBy("salt", "fp").agg(F.min("node").alias("rep"), F.count("*").alias("n"))
    same = points.join(reps.where("n > 1"), ["salt", "fp"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    loose = checkpointed(components(near_pairs(reps.select(F.col("rep").alias("node"), "salt", "fp"), radius, distance).unionByName(same)))
    members = written(kinds.join(loose, "node").select("node", "root", "first", "prints"), "members")
    rows = by_size(members.select(F.col("first._id").alias("_id"), F.col("first._h").alias("_h"), "node"))
    texts = narrow.join(rows, ["_id", "_h"]).select("node", "text")
    sets = written(texts.mapInArrow(_shingles(words), "node long, set array<long>"), "sets")
    if sets.groupBy("node").count().where("count > 1").take(1):  # rows that repeat in several tasks
        sets = written(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
    first = _to_middle(members, sets, similarity)
    free = written(members.join(first.where("not near").select(F.col("a").alias("node")), "node", "left_semi"), "free")
    second = _to_middle(free, sets, similarity).where("near").select("a", "b")
    links = first.where("near").select("a", "b").unionByName(second)
    of_second = second.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(second.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    of_first = first.join(of_second, F.col("a") == F.col("node"), "left").select(F.col("a").alias("node"), F.when(F.col("near"), F.col("b")).otherwise(F.coalesce("label", "a")).alias("label"))
    others = checkpointed(left_over(first, of_first, similarity))
    links = links.unionByName(compared(others, sets, similarity).where("near").select("a", "b"))
    found = checkpointed(components(links))
    named = kinds.select("node", "first").join(found, "node")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_node = found.join(least, "root").select("node", "least")
    of_digest = kinds.join(of_node, "node", "left").select("digest", F.coalesce("least", "first").alias("first"))
    return prints.drop("prints"), of_digest


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, distance: int = 6, salts: tuple[int, ...] = tuple(range(5)), features: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with one row of each group of near-duplicates: of the least id, and of equal ids the
    least hash of the text.

    Copies up to white space and the case of A-Z are near-duplicates; so are null and empty texts of each other. Rows of one
    id with different texts are different documents. Of rows that repeat id and text one stays. Rows with a null id cannot
    be named and stay. Texts are read whole. An empty table gives no rows; columns of any name are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, of_digest = groups(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), text.alias("text")), words, similarity, radius, distance, salts, features)
    named = rows.join(of_digest, "digest").withColumn("stays", (F.col("_id") == F.col("first._id")) & (F.col("_h") == F.col("first._h")))
    marks = written(named.groupBy("_id", "_h").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "marks")
    h, id_name = free_name(docs, "_h"), free_name(docs, "_key")
    goes = by_size(marks.where("not stays").select(F.col("_id").alias(id_name), F.col("_h").alias(h)))
    repeats = marks.where("stays").select(F.col("_id").alias(id_name), F.col("_h").alias(h))
    keyed = docs.withColumn(h, F.xxhash64(text)).withColumn(id_name, F.col(id_col))
    kept = keyed.join(goes, [id_name, h], "left_anti")
    if repeats.take(1):
        repeats = by_size(repeats)
        kept = kept.join(repeats, [id_name, h], "left_anti").unionByName(kept.join(repeats, [id_name, h], "left_semi").dropDuplicates([id_name, h]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
