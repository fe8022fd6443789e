"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into a grid of blocks. In a cell, each term's postings of the candidates are scattered,
weighted by the sparse query rows, into a dense array of scores; partition selection keeps k of each query, and the
cells' results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import written
from paperglass.llm.vectors import best, matrix, one_query, top

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 16_384, 4_096
#: Queries whose dense score arrays a task holds at once.
AT_ONCE = 64


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (candidates x queries): term by term, postings times query weights are added to the dense array."""
    scores = np.zeros((len(candidates), len(queries)), candidates.dtype)
    for t in range(min(queries.shape[1], candidates.shape[1])):
        posting = np.flatnonzero(candidates[:, t])
        weighted = np.flatnonzero(queries[:, t])
        if not len(posting) or not len(weighted):
            continue
        weights, values = queries[weighted, t], candidates[posting, t]
        if len(posting) == len(candidates) and len(weighted) == len(queries):
            scores += values[:, None] * weights
        elif len(weighted) == len(queries):
            scores[posting] += values[:, None] * weights
        else:
            scores[np.ix_(posting, weighted)] += values[:, None] * weights
    return scores


def cell(k: int, dtype):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [[], [], []]
        if queries.num_rows and candidates.num_rows:
            ids = candidates.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], matrix(candidates.column("v"), dtype)[order]
            own, weights = queries.column("id").to_numpy(), matrix(queries.column("v"), dtype)
            for lo in range(0, len(own), AT_ONCE):
                scores = accumulate(weights[lo : lo + AT_ONCE], rows)
                r, c = top(scores, ids, own[lo : lo + AT_ONCE], k)
                for into, x in zip(found, (own[lo + c], ids[r], scores[r, c]), strict=True):
                    into.append(x)
        kinds = (pa.int64(), pa.int64(), pa.from_numpy_dtype(dtype))
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in zip(found, kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, integers: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query, ties to the smaller vec_id.

    Both frames have (id long, v array<long or double>). Candidates with the query's own id are left out; a query id that
    repeats counts once, with its least vector; candidates that repeat are each ranked. Shorter vectors end in zeros.
    With no queries or no candidates there are no rows. Integer sums wrap at 64 bits.
    """
    cells = queries.sparkSession.conf.get("spark.sql.shuffle.partitions")
    candidates = written(candidates.select("id", "v", F.monotonically_increasing_id().alias("n")), "candidates")  # repeated rows are dealt like others
    n_c = max(1, -(-candidates.count() // CANDIDATES), int(cells) // 4)
    queries = one_query(queries)
    n_q = max(1, -(-queries.count() // QUERIES))
    all_c, all_q = F.sequence(F.lit(0), F.lit(n_c - 1)), F.sequence(F.lit(0), F.lit(n_q - 1))
    q = queries.select(F.explode(all_c).alias("c"), F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("q"), "id", "v")
    c = candidates.select(F.pmod(F.xxhash64("n"), F.lit(n_c)).cast("int").alias("c"), F.explode(all_q).alias("q"), "id", "v")
    dtype = np.int64 if integers else np.float64
    out = q.groupBy("c", "q").cogroup(c.groupBy("c", "q")).applyInArrow(cell(k, dtype), f"query_id long, vec_id long, score {'long' if integers else 'double'}")
    return best(out, k)


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """Integer vectors floor(scale * x) of (id, v array<double>)."""
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
