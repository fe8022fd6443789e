"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are compared under 2^(radius+1) - 1 masks: bit i carries a non-zero vector m(i) of radius+1 bits,
and mask v keeps the bits with an odd product <m(i), v>. Any `radius` vectors leave a v orthogonal to all of them, so each
pair within the radius agrees under some mask (Pagh, CoveringLSH). Equal fingerprints are collapsed first. Equal keys of one mask are
a bucket, and a bucket too large for one pass is covered anew on the bits that its mask drops, which leaves so few free
bits that its size has a bound. Links become components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import checkpointed, text_slices, written

BITS = 64
SEED = 42
#: Distinct fingerprints of a bucket beyond which it is covered a second time.
LARGE = 2048
#: Near pairs of a batch that a worker holds before it joins their parts.
PAIRS = 1 << 20


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, A-Z lower-cased, repeats included; the whole sequence if it is shorter."""
    parts = text.encode().lower().split()  # bytes: white space is \\x20 and \\x09-\\x0D, and only A-Z has lower case
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[: len(parts) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)), np.uint64, len(parts) - words + 1)


def fingerprints(texts: list[str], words: int, salts: np.ndarray, distinct: bool = False) -> np.ndarray:
    """A row of fingerprints for each text, one for each salt; salt 0 takes the hashes as they are. No words give zero.
    Repeats count, unless only `distinct` shingles do."""
    out = np.zeros((len(texts), len(salts)), np.uint64)
    for i, t in enumerate(texts):
        h = np.unique(shingle_hashes(t, words)) if distinct else shingle_hashes(t, words)
        if not len(h):
            continue
        for k, salt in enumerate(salts):
            x = h
            if salt:
                x = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = bits.sum(0, dtype=np.int32) if len(x) < 2**31 else bits.sum(0)
            out[i, k] = np.packbits(ones * 2 > len(x), bitorder="little").view("<u8")[0]
    return out


def masks(radius: int, bits: np.ndarray | None = None) -> np.ndarray:
    """The covering masks of a radius over the given bit positions."""
    bits = np.arange(BITS) if bits is None else bits
    rows = (1 << (radius + 1)) - 1
    vectors = np.arange(len(bits)) % rows + 1  # non-zero vectors, each as often as any other
    if len(bits) < rows:  # the first few vectors span too little, and some mask would keep no bit: of 64 fixed draws, that of the heaviest least mask
        draws = [np.random.default_rng(k).permutation(rows)[: len(bits)] + 1 for k in range(64)]
        vectors = max(draws, key=lambda d: (np.bitwise_count(d[None] & np.arange(1, rows + 1)[:, None]) & 1).sum(1).min())
    out = np.zeros(rows, np.uint64)
    for v in range(1, rows + 1):
        odd = np.bitwise_count((vectors & v).astype(np.uint64)) & 1
        for i in bits[odd.astype(bool)]:
            out[v - 1] |= np.uint64(1) << np.uint64(i)
    return out


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _fingerprinted(words: int, salts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_slices(batch, "text"):
                f = fingerprints(texts, words, salts).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(f.reshape(-1)), len(salts)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["_id", "prints"])

    return run


def simhash(docs: DataFrame, words: int = 3, salts: tuple[int, ...] = (0,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prints array<long>): the fingerprints of every whole text; null and empty texts have zeros."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_fingerprinted(words, np.array(salts, np.uint64)), "_id long, prints array<long>").withColumnRenamed("_id", id_col)


def _links(distance: int):
    """Links within runs of equal key in sorted rows: from the least of each connected part of a run to the others."""

    def within(fp: np.ndarray, node: np.ndarray, run_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(fp)
        label = np.arange(n)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            a, b = label[a], label[b]  # what earlier pairs have joined stays joined
            while len(a):  # least label of each connected part
                low = np.minimum(label[a], label[b])
                before = label.copy()
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                label[:] = label[label]
                if (label == before).all():
                    break

        live, lag, size = np.flatnonzero(run_end > np.arange(n) + 1), 1, 0
        while len(live):
            near = live[np.bitwise_count(fp[live] ^ fp[live + lag]) <= distance]
            held.append((near, near + lag))
            size += len(near)
            if size >= PAIRS:
                merge()
                size = 0
            lag += 1
            live = live[run_end[live] > live + lag]
        if held:
            merge()
        other = np.flatnonzero(label != np.arange(n))
        return node[label[other]], node[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, node = columns
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.repeat(np.append(edge[1:], len(key)), np.diff(np.append(edge, len(key))))
            a, b = within(fp.view(np.uint64), node, ends)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            new = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in range(3)]
            columns = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last run may go on in the next batch
            if cut:
                yield done([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held and len(held[0]):
            yield done(held)

    return run


def near_pairs(points: DataFrame, radius: int = 3, distance: int | None = None) -> DataFrame:
    """Links (a > b) between rows of (node long, fp long) that connect all fingerprints within `radius` bits.

    With a column `salt`, fingerprints meet only those of their own salt. Links stand for connected parts of buckets: each is a chain of fingerprints at most `distance` bits apart (the radius
    if not given). A bucket of over LARGE rows is covered again on its free bits, for `distance`, so it keeps each link.
    """
    distance = radius if distance is None else distance
    first = masks(radius)
    salt = F.col("salt") if "salt" in points.columns else F.lit(0)
    keyed = points.select(F.posexplode(F.array(*[F.lit(m) for m in signed(first)])).alias("t", "mask"), salt.alias("salt"), "fp", "node").select(
        "t", F.xxhash64("salt", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "node"
    )
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = checkpointed(sizes.where(F.col("n") > LARGE).select("key"))
    small, large = keyed, None
    if crowded.take(1):
        small = keyed.join(crowded, "key", "left_anti")
        kept = F.array(*[F.array(*[F.lit(m) for m in signed(masks(max(radius, distance), np.array([i for i in range(BITS) if not int(f) >> i & 1])))]) for f in first])
        hot = keyed.join(crowded, "key", "left_semi")
        large = hot.select("key", "fp", "node", F.posexplode(kept[F.col("t")]).alias("u", "mask")).select(F.xxhash64("key", "u", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "node")
    rows = small.select("key", "fp", "node")
    rows = rows.unionByName(large) if large is not None else rows
    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(_links(distance), "a long, b long").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, about one for each node: every node points to the least of its neighbours and
    itself, and an edge of two nodes becomes one of what they point to, which inside a dense group is mostly the same."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    moved = edges.join(least, "a").select("b", F.col("m").alias("x")).join(least.withColumnRenamed("a", "b"), "b").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
    pointers = least.select("a", F.col("m").alias("b"))
    return checkpointed(moved.unionByName(pointers).where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node it is connected to.

    The links are contracted once, then alternate large-star and small-star steps; frames are cut by reliable checkpoints and compared by count and hash
    sum, until nothing changes. No links give no rows.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = contracted(checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()))
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpointed(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id) of every row; component_id is the least id reachable over links.

    Two rows link if their fingerprints differ in at most `radius` bits. Null and empty texts have fingerprint zero and
    link like any other. Rows with a null id take part, but only ids that are there can name a component; one with none has
    a null component. Repeated rows and further columns: a row each, and other columns are ignored. Texts are hashed whole,
    whatever their length. An empty table gives no rows.
    """
    prints = written(simhash(docs, words, (0,), id_col, text_col).select(F.col(id_col).alias("_id"), F.col("prints")[0].alias("fingerprint")), "prints")
    nodes = prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("_id").alias("least_id"))
    found = components(near_pairs(nodes.select("node", F.col("node").alias("fp")), radius))
    least = nodes.join(found, "node").groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = found.join(least, "root").select("node", "component_id")
    named = nodes.join(groups, "node", "left").select(F.col("node").alias("fingerprint"), F.coalesce("component_id", "least_id").alias("component_id"))
    return prints.join(named, "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "component_id")


def hex_print(column) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
