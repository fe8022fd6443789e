"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into full sequences and one remainder. The remainders' histogram, at most `capacity` counts, goes to
the driver, which opens as few packs as the tokens need and places lengths longest first into the emptiest packs; a
length that fits nowhere is cut. Packs with one history form a run, so the plan holds runs of ranks, not documents.
Remainders have a rank among those of their length and find their packs by it.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperglass.llm.bpe import TextEncoder, vocabulary
from paperglass.llm.common import text_slices, written

#: Rows of (task, length) counts up to which they are broadcast; beyond, they join by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sequence ids of full sequences: the task's number plus one, above this many bits.
TASK_BITS = 40
PIECE_SCHEMA = "_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long, tail binary"


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, start in the remainder, part length, first pack, offset in the pack).

    Packs are as few as the tokens allow. The longest length goes to the emptiest packs; where even those have less room,
    it is cut there and the rest counts as a shorter length.
    """
    total = sum(n * c for n, c in histogram.items())
    packs = -(-total // capacity)
    free = [(0, 0, packs)] if packs else []  # fill, first pack, packs
    bins = defaultdict(list)
    for n, c in histogram.items():
        if n and c:
            bins[n].append((n, 0, c, 0))
    lengths = [-n for n in bins]
    heapq.heapify(lengths)
    rows = []
    while lengths:
        n = -heapq.heappop(lengths)
        for length, rank, count, start in bins.pop(n):
            while count:
                fill, base, open_ = heapq.heappop(free)
                k, part = min(count, open_), min(n, capacity - fill)
                rows.append((length, rank, k, start, part, base, fill))
                if open_ > k:
                    heapq.heappush(free, (fill, base + k, open_ - k))
                if fill + part < capacity:
                    heapq.heappush(free, (fill + part, base, k))
                if part < n:
                    if n - part not in bins:
                        heapq.heappush(lengths, part - n)
                    bins[n - part].append((length, rank, k, start + part))
                rank, count = rank + k, count - k
    return np.array(rows, dtype=np.int64).reshape(-1, 7)


def _cut(path: str, pattern: str, end_id: int, special: tuple[str, int] | None, capacity: int):
    def encode(encoder: TextEncoder, texts: list[str]) -> list[np.ndarray]:
        end = np.array([end_id], np.int32)
        parts, owner = [], []
        for i, t in enumerate(texts):
            for s in t.split(special[0]) if special else [t]:
                parts.append(s)
                owner.append(i)
        flat, bounds = encoder(parts)
        lists = [flat[a:b] for a, b in pairwise(bounds.tolist())]
        if len(parts) == len(texts):
            return [np.concatenate([x, end]) for x in lists]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, x in zip(owner, lists, strict=True):
            out[i] += [np.array([special[1]], np.int32), x] if out[i] else [x]
        return [np.concatenate([*x, end]) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = TextEncoder(vocabulary(path), pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, _, texts in text_slices(batch, "text"):
                rows: list[tuple] = []
                at = []
                for i, ids in enumerate(encode(encoder, texts)):
                    raw, n = ids.astype("<u4").tobytes(), len(ids)
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        own = raw[4 * start : 4 * (start + size)]
                        rows.append((start, size, zlib.crc32(own), n, int(seen[size]), own if size < capacity else None))
                        seen[size] += 1
                        at.append(lo + i)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array([task] * len(rows), pa.int64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.binary())],
                    names=["_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", "tail"],
                )

    return run


def _place(rows: np.ndarray):
    """Parts of remainders by (length, rank): the ranks of a length are split where any of the plan's runs begins or ends."""
    by_length = {}
    for length in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == length]
        edges = np.unique(np.concatenate([own[:, 1], own[:, 1] + own[:, 2]]))
        first, last = np.searchsorted(edges, own[:, 1]), np.searchsorted(edges, own[:, 1] + own[:, 2])
        parts: list[list[int]] = [[] for _ in edges]
        for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            for e in range(a, b):
                parts[e].append(k)
        by_length[int(length)] = (edges, own, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, crc, rank, offset, tails = (batch.column(k).to_pylist() for k in range(1, 7))
            out, at = [], []
            for i, n in enumerate(length):
                edges, own, parts = by_length[n]
                r = offset[i] + rank[i]
                for k in parts[int(np.searchsorted(edges, r, side="right")) - 1]:
                    _, lo, _, inside, size, base, fill = own[k].tolist()
                    sum_ = crc[i] if size == n else zlib.crc32(tails[i][4 * inside : 4 * (inside + size)])
                    out.append((start[i] + inside, size, sum_, base + r - lo, fill))
                    at.append(i)
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), *(pa.array(c, pa.int64()) for c in columns[:3]), batch.column(7).take(where), *(pa.array(c, pa.int64()) for c in columns[3:])],
                names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 0, special: tuple[str, int] | None = None, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, a row for each piece of a document.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `special` is a string that the vocabulary's
    library reads as one token. A null text counts as empty and has only the end id. Repeated rows and null ids are
    packed row by row. An empty table gives no rows. Padding is less than one sequence in all.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    pieces = written(narrow.mapInArrow(_cut(path, pattern, end_id, special, capacity), PIECE_SCHEMA), "pieces")
    rest = pieces.where(F.col("length") < capacity)
    counts = written(rest.groupBy("length", "task").count(), "lengths")
    # at most capacity - 1 rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = rest.join(offsets, ["length", "task"]).select("_id", "start", "length", "ids_crc32", "rank", "before", "tail", "doc_tokens")
    columns = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = placed.mapInArrow(_place(plan(histogram, capacity)), ", ".join(f"{c} long" for c in columns))
    full = pieces.where(F.col("length") == capacity).select(
        *columns[:5], (F.shiftleft(F.col("task") + 1, TASK_BITS) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(packed).withColumnRenamed("_id", id_col)
