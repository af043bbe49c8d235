"""Nearest neighbours by incremental search in a low-dimensional stable projection.

A Gaussian projection to m dimensions turns a distance d into d times the root of a chi-square
variable with m degrees of freedom. Rows come in the order of their projected distance out of a
kd-tree and are verified on their whole vectors; once the projected distance is so far out that a row
nearer than the k-th best would have come by now with probability `sure`, the search stops.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 8            # of the projection; even
SURE = 0.98
LEAF = 64
BLOCK_VALUES = 1_000_000  # vector components in one block of rows (and 1/16 of it in one of queries)
RESULT = "query_id long, vec_id long, score double"


def chi_square_cdf(x: np.ndarray | float, m: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, m // 2):
        term *= x / 2 / k
        total += term
    return 1 - exp(-min(x / 2, 700)) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


class KdTree:
    """Median splits along the widest side; the rows of a leaf lie together in `order`."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.span, self.child = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[self.order[a:b]]
            node = len(self.span)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.span.append((a, b))
            self.child.append([])
            if parent >= 0:
                self.child[parent].append(node)
            width = self.high[-1] - self.low[-1]
            if b - a > leaf and width.max() > 0:
                axis, middle = int(np.argmax(width)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                stack += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance to the box, rows) of the leaves, nearest box first."""
        near = (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(axis=1)
        heap = [(near[0], 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            if self.child[node]:
                for c in self.child[node]:
                    heapq.heappush(heap, (near[c], c))
            else:
                a, b = self.span[node]
                yield distance, self.order[a:b]


def search(vectors: np.ndarray, ids: np.ndarray, tree: KdTree, query: np.ndarray, query_id: int,
           projected: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and distances of the k nearest verified rows other than the query's own, ties to smaller ids."""
    best_id, best = np.empty(0, np.int64), np.empty(0)
    for near, rows in tree.leaves(projected):
        if len(best) == k and near > limit * best[-1] ** 2:
            break                                    # the chi-square stopping test
        distance = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
        keep = ids[rows] != query_id
        best_id = np.concatenate((best_id, ids[rows][keep]))
        best = np.concatenate((best, distance[keep]))
        order = np.lexsort((best_id, best))[:k]
        best_id, best = best_id[order], best[order]
    return best_id, best


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and doubles of the vectors that take part; NULL, empty, zero or not finite ones do not."""
    values = F.col(vector_column).cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_column).cast("long").alias("vec_id"), values.alias("vector"))
            .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
            .where(good & F.exists("vector", lambda x: x != 0)))


def _blocks(rows: DataFrame, values: int, salt: str) -> DataFrame:
    """Rows with their dimension and an even, hashed block number among as many as the size asks for."""
    rows = rows.withColumn("dim", F.size("vector"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") * F.col("dim") / values).cast("int"))
    return rows.join(F.broadcast(sizes.select("dim", "blocks")), "dim").withColumn(
        f"{salt}_block", F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col("blocks")).cast("int"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
            vector_column: str = "embedding", dimensions: int = DIMENSIONS, sure: float = SURE,
            block_values: int = BLOCK_VALUES, seed: int = 20) -> DataFrame:
    """The k nearest rows of each query by Euclidean distance: query_id, rank (from 1), vec_id, score.

    Rows and queries are cut into blocks of bounded size by a hash of their id, so copies and hot labels
    spread evenly; each block of queries meets each block of rows once, against a kd-tree built there, and
    the k best of all blocks are kept. Distances are taken in double precision on the original vectors;
    rows with the query's own id are no candidates; ties go to the smaller id.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components take no part; vectors of another
    dimension than the query's are no candidates; a repeated id counts once per row among candidates and
    once as a query; other columns are ignored; fewer than k candidates are all returned; an empty table
    gives an empty result.
    """
    limit = chi_square_quantile(sure, dimensions)
    rows = _blocks(usable(vectors, id_column, vector_column), block_values, "row")
    asked = _blocks(usable(queries, id_column, vector_column).dropDuplicates(["vec_id"]), block_values // 16, "query")
    pairs = (rows.select("dim", F.col("blocks").alias("row_blocks")).distinct()
             .join(asked.select("dim", F.col("blocks").alias("query_blocks")).distinct(), "dim"))
    # Every block goes to its meetings with the other side's blocks: one copy of it for each.
    rows = (rows.join(F.broadcast(pairs.select("dim", "query_blocks")), "dim")
            .withColumn("query_block", F.explode(F.expr("sequence(0, query_blocks - 1)"))))
    asked = (asked.join(F.broadcast(pairs.select("dim", "row_blocks")), "dim")
             .withColumn("row_block", F.explode(F.expr("sequence(0, row_blocks - 1)"))))
    keys = ["dim", "row_block", "query_block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found_query, found_id, found_score = [], [], []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            order = np.argsort(left.column("vec_id").to_numpy(), kind="stable")
            ids = left.column("vec_id").to_numpy()[order]
            values = left.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False)
            own = values.reshape(-1, dim)[order]
            base = np.random.default_rng(seed).normal(size=(dim, dimensions))
            tree = KdTree(own @ base)
            query_ids = right.column("vec_id").to_numpy()
            asked_for = right.column("vector").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            for query_id, query, projected in zip(query_ids, asked_for, asked_for @ base):
                near_ids, near = search(own, ids, tree, query, query_id, projected, k, limit)
                found_query.append(np.full(len(near), query_id))
                found_id.append(near_ids)
                found_score.append(near)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": join(found_query, pa.int64()), "vec_id": join(found_id, pa.int64()),
                         "score": join(found_score, pa.float64())})

    met = (rows.select(*keys, "vec_id", "vector").groupBy(*keys)
           .cogroup(asked.select(*keys, "vec_id", "vector").groupBy(*keys)).applyInArrow(meet, RESULT))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
