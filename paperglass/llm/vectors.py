"""What the vector searches share: valid vectors, padded matrices and the merge of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(id long, v array<double>) of the vectors that are not null and hold only finite components, and rows with an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = narrow.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return finite.where(F.exists("v", lambda x: x != 0)) if nonzero else finite


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column as rows of a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(size.max(initial=0))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


def one_query(queries: DataFrame) -> DataFrame:
    """One vector for each id: the least, where an id repeats."""
    return queries.groupBy("id").agg(F.min("v").alias("v"))


def best(partial: DataFrame, k: int) -> DataFrame:
    """The k highest of (query_id, vec_id, score) for each query, ties to the smaller vec_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each column. Rows are in the order of their ids, `own` are the columns'
    ids, which are no candidates; ties go to the smaller id."""
    rows, columns = [], []
    low = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    for c in range(scores.shape[1]):
        s = scores[:, c]
        a, b = np.searchsorted(ids, own[c]), np.searchsorted(ids, own[c], side="right")
        if b > a:
            s = s.copy()
            s[a:b] = low
        n = min(k, len(s) - (b - a))
        if n <= 0:
            continue
        bar = np.partition(s, len(s) - n)[len(s) - n]
        over = np.flatnonzero(s > bar)
        level = np.flatnonzero(s == bar)
        level = level[(level < a) | (level >= b)][: n - len(over)]
        rows.append(np.concatenate([over, level]))
        columns.append(np.full(len(over) + len(level), c))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)
