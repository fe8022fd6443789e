"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample. Every row is filed under a leaf, once, in a written table. A query walks the tree through a
priority queue, best bin first: a bin's priority is the inner product with its centre and a margin for how far its rows spread. It
widens over as many leaves as the sample's own neighbours needed for the target recall. Leaves are grouped to cells of a bounded
number of rows; a query goes to a cell once, with the list of its leaves there, and scores the rows of these leaves only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperglass.llm.common import written
from paperglass.llm.topk import QUERIES
from paperglass.llm.vectors import best, matrix, one_query, top

#: Rows of the sample that the tree is fitted on, at most; also of its calibration queries.
SAMPLE, CALIBRATION = 32_768, 256
#: Children of a node; nodes are split while they hold more sample rows than this.
BRANCHES, LEAF_ROWS = 8, 8
#: Recall on the sample that the number of visited leaves is chosen for.
TARGET = 0.94
#: Spreads (standard deviation of a component) that a bin's priority adds to its centre's inner product, for nodes and leaves.
NODE_MARGIN, LEAF_MARGIN = 3.0, 2.0
#: Rows of one cell, and the least number of cells for rows that would need fewer.
CELL, CELLS = 16_384, 16


class Tree:
    """Nodes in arrays: centres, and the children of node i as a range, empty for leaves."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        centres, first, count, leaf_of = [sample.mean(0)], [0], [0], [-1]
        queue, self.leaves, spread = [(0, np.arange(len(sample)))], 0, []
        while queue:
            node, rows = queue.pop(0)
            spread.append(np.sqrt(((sample[rows] - centres[node]) ** 2).mean()) if len(rows) else 0.0)
            groups = split(sample[rows], BRANCHES, rng) if len(rows) > LEAF_ROWS else []
            if len(groups) < 2:
                leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            first[node], count[node] = len(centres), len(groups)
            for g in groups:
                queue.append((len(centres), rows[g]))
                centres.append(sample[rows[g]].mean(0))
                first.append(0)
                count.append(0)
                leaf_of.append(-1)
        self.centres, self.first, self.count, self.leaf_of = np.array(centres), first, count, leaf_of
        self.margin = np.array(spread) * np.where(np.array(count) > 0, NODE_MARGIN, LEAF_MARGIN)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at each level."""
        x = fit_width(x, self.centres.shape[1])
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        count, first = np.array(self.count), np.array(self.first)
        while len(live := live[count[node[live]] > 0]):
            for at in np.unique(node[live]):
                rows = live[node[live] == at]
                c = self.centres[first[at] : first[at] + count[at]]
                node[rows] = first[at] + (2 * x[rows] @ c.T - (c * c).sum(1)).argmax(1)
        return np.array(self.leaf_of)[node]

    def leaves_of(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-bin-first walk: nodes leave the queue by their priority for the query, its length times the
        margin added to the centre's inner product."""
        q = fit_width(query[None], self.centres.shape[1])[0]
        near = (self.centres @ q + self.margin * np.sqrt(q @ q)).tolist()
        heap, out = [(-near[0], 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if not self.count[node]:
                out.append(self.leaf_of[node])
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(heap, (-near[child], child))
        return out


def fit_width(x: np.ndarray, width: int) -> np.ndarray:
    if x.shape[1] >= width:
        return x[:, :width]
    return np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    """Row groups of k-means; fewer than k where rows coincide."""
    kinds = np.unique(x, axis=0)
    centres = kinds[rng.choice(len(kinds), min(k, len(kinds)), replace=False)]
    for _ in range(rounds):
        label = (2 * x @ centres.T - (centres * centres).sum(1)).argmax(1)
        used = np.unique(label)
        centres = np.array([x[label == c].mean(0) for c in used])
    label = (2 * x @ centres.T - (centres * centres).sum(1)).argmax(1)
    return [np.flatnonzero(label == c) for c in np.unique(label)]


def calibrate(tree: Tree, sample: np.ndarray, k: int, target: float) -> int:
    """The least number of leaf visits by which the sample's queries find `target` of their k best other rows of the sample."""
    leaf = tree.file(sample)
    step = max(1, len(sample) // CALIBRATION)
    where = []
    for i in range(0, len(sample), step)[:CALIBRATION]:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        n = min(k, len(sample) - 1)
        if n:
            place = np.empty(tree.leaves, np.int64)
            place[tree.leaves_of(sample[i], tree.leaves)] = np.arange(tree.leaves)
            where += place[leaf[np.argpartition(-scores, n - 1)[:n]]].tolist()
    return int(np.quantile(where, target, method="higher")) + 1 if where else tree.leaves


def _filed(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.file(matrix(batch.column(1), np.float64)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column(0), batch.column(1)], names=["leaf", "id", "v"])

    return run


def cells_of(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each leaf: neighbours in the tree share a cell, large leaves have several."""
    size = max(1, min(CELL, -(-int(rows.sum()) // least)))
    first, parts, cell, held = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for leaf, n in enumerate(rows.tolist()):
        if held and held + n > size:
            cell, held = cell + 1, 0
        first[leaf], parts[leaf] = cell, max(1, -(-n // size))
        held += n
        if parts[leaf] > 1:
            cell, held = cell + int(parts[leaf]), 0
    return first, parts


def _walked(tree: Tree, visits: int, first: np.ndarray, parts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells, lists = [], [], []
            for i, q in enumerate(matrix(batch.column(1), np.float64) if batch.num_rows else []):
                leaves = np.sort(np.array(tree.leaves_of(q, visits)))
                of = np.repeat(first[leaves], parts[leaves]) + np.concatenate([np.arange(p) for p in parts[leaves]])
                leaves = np.repeat(leaves, parts[leaves])
                order = np.argsort(of, kind="stable")
                cut = np.flatnonzero(np.diff(of[order])) + 1
                for own in np.split(order, cut):
                    at.append(i)
                    cells.append(of[own[0]])
                    lists.append(leaves[own])
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(lists, pa.list_(pa.int32())), batch.column(0).take(where), batch.column(1).take(where)], names=["cell", "leaves", "id", "v"])

    return run


def _scored(k: int):
    """Scores of each query of a cell with the rows of its leaves there: matrix products choose, sums in the order of the components score."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            leaf, ids = rows.column("leaf").to_numpy(), rows.column("id").to_numpy()
            order = np.lexsort((ids, leaf))
            leaf, ids, x = leaf[order], ids[order], matrix(rows.column("v"), np.float64)[order]
            weights, width = matrix(queries.column("v"), np.float64), None
            width = min(weights.shape[1], x.shape[1])
            lists = queries.column("leaves").to_pylist()
            for q, own in enumerate(queries.column("id").to_pylist()):
                a, b = np.searchsorted(leaf, lists[q]), np.searchsorted(leaf, lists[q], side="right")
                size = b - a
                end = np.cumsum(size)
                at = np.repeat(a - (end - size), size) + np.arange(end[-1])
                at = at[ids[at] != own]
                if not len(at):
                    continue
                rough = x[at, :width] @ weights[q, :width]
                if len(at) > k:
                    bar = np.partition(rough, len(at) - k)[len(at) - k]
                    at = at[rough >= bar - 1e-9 * (1 + abs(bar) + np.abs(weights[q]).sum() * np.abs(x[at]).max())]
                exact = np.zeros(len(at))
                for t in range(width):
                    exact += x[at, t] * weights[q, t]
                by_id = np.argsort(ids[at], kind="stable")
                at, exact = at[by_id], exact[by_id]
                r, _ = top(exact[:, None], ids[at], np.array([own]), k)
                for into, values in zip(found, (np.full(len(r), own), ids[at[r]], exact[r]), strict=True):
                    into.append(values)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(f) if f else np.zeros(0), t) for f, t in zip(found, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, target: float = TARGET, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query, ties to the smaller vec_id.

    Both frames have (id long, v array<double>), without zero vectors. Scores are sums in double precision in the order of
    the components. The query's own id is no candidate; a query id that repeats counts once, with its least vector;
    repeated rows are each ranked. Shorter vectors end in zeros. If the visited leaves may hold fewer than k candidates, more are
    visited, up to all. With no rows or no queries the result is empty. The tree is fitted on at most `sample_rows` rows,
    those with the least hash; every row is filed.
    """
    sample = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(sample_rows).toArrow()
    x = matrix(sample.column("v"), np.float64) if sample.num_rows else np.zeros((1, 1))
    tree = Tree(x)
    visits = calibrate(tree, x, k, target)
    filed = rows.select("id", "v").mapInArrow(_filed(tree), "leaf int, id long, v array<double>")
    filed = written(filed.withColumn("n", F.monotonically_increasing_id()), "filed")
    held = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():  # a row for each leaf of the tree
        held[r["leaf"]] = r["count"]
    # the rows of an id that is asked for are no candidates for it
    own = filed.groupBy("id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    few = np.cumsum(np.sort(held))
    while visits < tree.leaves and few[visits - 1] < k + own:
        visits = min(tree.leaves, visits * 2)
    first, parts = cells_of(held, CELLS)
    places = F.broadcast(rows.sparkSession.createDataFrame([(f, int(first[f]), int(parts[f])) for f in range(tree.leaves)], "leaf int, first long, parts long"))
    queries = one_query(queries)
    n_q = max(1, -(-queries.count() // QUERIES))
    files = filed.join(places, "leaf").select((F.col("first") + F.pmod(F.xxhash64("n"), F.col("parts"))).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), "leaf", "id", "v")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given is kept, however small the frame
    asked = queries.repartition(tasks, "id").mapInArrow(_walked(tree, visits, first, parts), "cell long, leaves array<int>, id long, v array<double>")
    asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int"))
    found = asked.groupBy("cell", "q").cogroup(files.groupBy("cell", "q")).applyInArrow(_scored(k), "query_id long, vec_id long, score double")
    return best(found, k)
