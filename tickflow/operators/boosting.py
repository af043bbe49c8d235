"""Second-order boosted trees on Spark: every level of a tree is one pass over binned rows.

Features are cut into bins by exact quantiles and packed once into written blocks of codes. A pass walks the rows
down the tree as far as it is grown and sums gradient and curvature of the logistic loss by (feature, node, bin)
within each task; the sums of a feature meet in one place, where its best split of every node is found. What
reaches the driver is one candidate split per feature and node.

A split's gain is T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda), where T moves a sum
towards 0 by alpha; a leaf has the value -rate T(G) / (H + lambda). Trees grow level by level; then splits of
leaves that gain less than gamma go, from below.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.quantiles import quantiles
from tickflow.runtime import written

BLOCK_ROWS = 4096
MISSING = 255
KEPT_TREES = 16           # trees after which the scores so far are written with the rows
FAN_IN = 32

# the functions travel with the job, so the workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Boosting:
    """Settings of the trees, all with their usual meaning."""

    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    row_share: float = 1.0        # rows that a tree is grown on
    column_share: float = 1.0     # columns that a tree may use
    gamma: float = 0.0            # least gain of a split
    alpha: float = 0.0            # L1 penalty on leaf values
    penalty: float = 1.0          # lambda, L2 penalty on leaf values
    min_child_weight: float = 1.0
    positive_weight: float = 1.0
    max_step: float = 0.0         # largest leaf value before the rate; 0: any
    bins: int = 64
    seed: int = 0


@dataclass
class Tree:
    """Nodes in arrays; a node without `feature` (-1) is a leaf. Rows go left where their code is at most `code`."""

    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray

    @staticmethod
    def stump() -> "Tree":
        whole, real = (lambda v: np.array([v], np.int64)), (lambda v: np.array([v], float))
        return Tree(whole(-1), whole(0), np.array([False]), whole(-1), whole(-1), real(0), real(0), real(0), real(0))

    def split(self, node: int, feature: int, code: int, missing_left: bool, gain: float,
              sums: tuple[tuple[float, float], tuple[float, float]]) -> None:
        n = len(self.feature)
        self.feature[node], self.code[node], self.missing_left[node] = feature, code, missing_left
        self.left[node], self.right[node], self.gain[node] = n, n + 1, gain
        fresh = {"feature": [-1, -1], "code": [0, 0], "missing_left": [False, False], "left": [-1, -1], "right": [-1, -1],
                 "value": [0.0, 0.0], "gain": [0.0, 0.0], "gradient": [s[0] for s in sums], "curvature": [s[1] for s in sums]}
        for name, values in fresh.items():
            old = getattr(self, name)
            setattr(self, name, np.append(old, np.array(values, old.dtype)))

    def arrays(self) -> tuple:
        return self.feature, self.code, self.missing_left, self.left, self.right, self.value


def descend(tree: tuple, codes: np.ndarray) -> np.ndarray:
    """Node at which each row of codes ends."""
    feature, code, missing_left, left, right, _ = tree
    node = np.zeros(len(codes), np.int64)
    moving = np.flatnonzero(feature[node] >= 0)
    while len(moving):
        at = node[moving]
        own = codes[moving, feature[at]]
        goes_left = np.where(own == MISSING, missing_left[at], own <= code[at])
        node[moving] = np.where(goes_left, left[at], right[at])
        moving = moving[feature[node[moving]] >= 0]
    return node


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value; MISSING for values that are not numbers."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isfinite(x[:, j]), np.searchsorted(e, x[:, j], "left"), MISSING)
    return out


def _towards_zero(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _quality(g: np.ndarray, h: np.ndarray, alpha: float, penalty: float) -> np.ndarray:
    bottom = h + penalty
    return np.divide(_towards_zero(g, alpha) ** 2, bottom, out=np.zeros_like(g), where=bottom > 0)


def best_splits(sums: np.ndarray, p: Boosting) -> np.ndarray:
    """For sums of one feature (node, bin or missing, gradient and curvature): per node the best gain, its bin,
    whether missing values go left, and the sums of the left side and of the node.

    Gains are compared by their first twelve digits; of equal ones the lowest bin wins, with missing values on the
    right. A gain of -1 means that nothing can be split.
    """
    whole = sums.sum(axis=1)
    upto = np.cumsum(sums[:, :-1], axis=1)                         # behind the last bin only missing values are left
    out = np.zeros((len(sums), 7))
    out[:, 5:7] = whole
    lost = sums[:, -1:]
    sides = np.stack([upto, upto + lost], 2)                       # missing right, missing left
    left_g, left_h = sides[..., 0], sides[..., 1]
    right_g, right_h = whole[:, None, None, 0] - left_g, whole[:, None, None, 1] - left_h
    gain = (_quality(left_g, left_h, p.alpha, p.penalty) + _quality(right_g, right_h, p.alpha, p.penalty)
            - _quality(whole[:, 0], whole[:, 1], p.alpha, p.penalty)[:, None, None])
    able = (left_h >= p.min_child_weight) & (right_h >= p.min_child_weight) & (left_h > 0) & (right_h > 0)
    flat = np.where(able, np.round(gain, 12), -1.0).reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    own = np.arange(len(sums))
    out[:, 0], out[:, 1], out[:, 2] = flat[own, at], at // 2, at % 2
    out[:, 3], out[:, 4] = left_g.reshape(len(sums), -1)[own, at], left_h.reshape(len(sums), -1)[own, at]
    return out


def _unit(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree, the same whenever it is asked."""
    x = keys.astype(np.uint64) + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _block_rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for codes, y, keys, score in zip(*(batch.column(c).to_pylist() for c in ("codes", "y", "keys", "score"))):
        yield (np.frombuffer(codes, np.uint8).reshape(-1, width), np.frombuffer(y, "<f8"), np.frombuffer(keys, "<i8"),
               np.frombuffer(score, "<f8"))


def _scored(codes: np.ndarray, score: np.ndarray, trees: list[tuple]) -> np.ndarray:
    out = score.copy()
    for t in trees:
        out += t[5][descend(t, codes)]
    return out


def _summer(shared):
    """Sums of one pass: one row per feature."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, width, done, tree, active, columns, number, bins = shared.value
        local = np.full(len(tree[0]), -1)
        local[active] = np.arange(len(active))
        total = np.zeros((len(columns), len(active), bins + 1, 2))
        for batch in batches:
            for codes, y, keys, score in _block_rows(batch, width):
                if p.row_share < 1:
                    chosen = _unit(keys, number, p.seed) < p.row_share
                    codes, y, score = codes[chosen], y[chosen], score[chosen]
                where = local[descend(tree, codes)]
                if (where < 0).any():
                    codes, y, score, where = (v[where >= 0] for v in (codes, y, score, where))
                if not len(y):
                    continue
                prob = 1 / (1 + np.exp(-_scored(codes, score, done)))
                weight = np.where(y > 0, p.positive_weight, 1.0)
                g, h = weight * (prob - y), weight * prob * (1 - prob)
                for k, c in enumerate(columns):
                    cell = where * (bins + 1) + np.minimum(codes[:, c], bins)
                    for side, v in enumerate((g, h)):
                        total[k, :, :, side] += np.bincount(cell, v, len(active) * (bins + 1)).reshape(len(active), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns), dtype=np.int32)),
                                          pa.array([t.tobytes() for t in total], pa.binary())], ["column", "sums"])
    return add


def _together(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), "<f8") for v in table.column("sums"))
    return pa.table({"column": table.column("column").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _finder(p: Boosting, nodes: int, bins: int):
    def find(table: pa.Table) -> pa.Table:
        total = np.frombuffer(_together(table).column("sums")[0].as_py(), "<f8").reshape(nodes, bins + 1, 2)
        return pa.table({"column": table.column("column").slice(0, 1),
                         "splits": pa.array([best_splits(total, p).astype("<f8").tobytes()], pa.binary())})
    return find


def _rescored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, done = shared.value
        for batch in batches:
            fresh = [_scored(codes, score, done).astype("<f8").tobytes() for codes, _, _, score in _block_rows(batch, width)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("codes", "y", "keys")), pa.array(fresh, pa.binary())],
                                             ["codes", "y", "keys", "score"])
    return run


BLOCKS = "codes binary, y binary, keys binary, score binary"


def packed(df: DataFrame, columns: Sequence[str], edges: list[np.ndarray], y: str, key: Sequence[str]) -> DataFrame:
    """Written blocks of bin codes, targets, row hashes and scores (0). Rows without a target are left out."""
    width = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                values = (coded(x, edges), part.column("y").to_numpy().astype("<f8"), part.column("k").to_numpy().astype("<i8"),
                          np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values],
                                                 ["codes", "y", "keys", "score"])

    rows = df.where(F.col(y).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
                                                 F.col(y).cast("double").alias("y"), F.xxhash64(*key).alias("k"))
    return written(rows.mapInArrow(pack, BLOCKS), "binned")


def _leaf_values(tree: Tree, p: Boosting) -> None:
    bottom = tree.curvature + p.penalty
    step = np.divide(-_towards_zero(tree.gradient, p.alpha), bottom, out=np.zeros_like(bottom), where=bottom > 0)
    if p.max_step:
        step = np.clip(step, -p.max_step, p.max_step)
    tree.value = np.where(tree.feature < 0, p.rate * step, 0.0)


def _prune(tree: Tree, gamma: float) -> None:
    """Take back splits of two leaves that gain less than gamma, until none is left."""
    changed = True
    while changed:
        inner = np.flatnonzero(tree.feature >= 0)
        weak = [n for n in inner if tree.feature[tree.left[n]] < 0 and tree.feature[tree.right[n]] < 0 and tree.gain[n] < gamma]
        tree.feature[weak] = -1
        changed = bool(weak)


@dataclass
class Boosted:
    """A fitted model over named columns; `score` adds `prob`."""

    columns: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    params: Boosting

    def score(self, df: DataFrame) -> DataFrame:
        """Rows whose features are missing go the way that was learned for missing values."""
        of, names = self.plain(), self.columns

        @F.pandas_udf("double")
        def prob(x: pd.DataFrame) -> pd.Series:
            return pd.Series(of(x.to_numpy(dtype=float, na_value=np.nan)))

        return df.select("*", prob(F.struct(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])).alias("prob"))

    def plain(self):
        """Function from an array of feature rows to probabilities."""
        edges, trees = self.edges, [t.arrays() for t in self.trees]

        def prob(x: np.ndarray) -> np.ndarray:
            codes = coded(x, edges)
            return 1 / (1 + np.exp(-_scored(codes, np.zeros(len(codes)), trees)))
        return prob

    def importances(self) -> dict[str, float]:
        """Mean gain of the splits by each column, as shares."""
        total, count = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(count, t.feature[inner], 1)
        mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
        return dict(zip(self.columns, (mean / (mean.sum() or 1.0)).tolist()))

    def nodes(self) -> list[tuple]:
        """(tree, node, column, threshold, missing_left, left, right, gain, gradient, curvature, value) of all reachable nodes."""
        out = []
        for k, t in enumerate(self.trees):
            waiting = [0]
            while waiting:
                n = waiting.pop(0)
                f = int(t.feature[n])
                inner = f >= 0
                if inner:
                    waiting += [int(t.left[n]), int(t.right[n])]
                out.append((k, n, self.columns[f] if inner else None, self.threshold(f, int(t.code[n])) if inner else None,
                            bool(t.missing_left[n]) if inner else None, int(t.left[n]) if inner else None,
                            int(t.right[n]) if inner else None, float(t.gain[n]) if inner else None, float(t.gradient[n]),
                            float(t.curvature[n]), float(t.value[n])))
        return out

    def threshold(self, column: int, code: int) -> float:
        """Largest value that goes left; infinite where only missing values go right."""
        edges = self.edges[column]
        return float(edges[code]) if code < len(edges) else float("inf")

    def note(self) -> dict:
        """All that `of_note` needs to build the model again."""
        return {"columns": self.columns, "edges": [e.tolist() for e in self.edges], "params": vars(self.params),
                "trees": [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]}

    @staticmethod
    def of_note(note: dict) -> "Boosted":
        kinds = {"missing_left": bool} | dict.fromkeys(("feature", "code", "left", "right"), np.int64)
        trees = [Tree(**{k: np.array(v, kinds.get(k, float)) for k, v in t.items()}) for t in note["trees"]]
        return Boosted(note["columns"], [np.array(e, float) for e in note["edges"]], trees, Boosting(**note["params"]))


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Inner edges of each column: distinct quantiles between its smallest and largest value."""
    if not 2 <= bins < MISSING:
        raise ValueError(f"bins must lie in 2..{MISSING - 1}")
    found = quantiles(df, {c: [k / bins for k in range(bins + 1)] for c in columns})
    return [np.array(sorted(set(found[c]))[1:-1], float) if found[c][0] is not None else np.empty(0) for c in columns]


def fit_boosted(df: DataFrame, columns: Sequence[str], y: str = "y", params: Boosting = Boosting(),
                key: Sequence[str] = ("date_trd", "trd_id")) -> Boosted:
    """Grow the trees. Rows without a target are left out; missing features and those that are not numbers go the
    way that gains more. `key` names the columns by which rows are drawn for a tree."""
    columns, p = list(columns), params
    edges = bin_edges(df, columns, p.bins)
    rows = packed(df, columns, edges, y, key)
    spark, width = df.sparkSession, len(columns)
    bins = max((len(e) for e in edges), default=0) + 1
    rng = np.random.default_rng(p.seed)
    model, pending = Boosted(columns, edges, [], p), []
    for number in range(p.trees):
        chosen = np.sort(rng.permutation(width)[:max(1, round(p.column_share * width))])
        tree = _grow(spark, rows, p, width, pending, chosen, number, bins)
        model.trees.append(tree)
        pending.append(tree.arrays())
        if len(pending) == KEPT_TREES and number + 1 < p.trees:
            shared = spark.sparkContext.broadcast((width, pending))
            rows, pending = written(rows.mapInArrow(_rescored(shared), BLOCKS), "binned"), []
    return model


def _grow(spark, rows: DataFrame, p: Boosting, width: int, done: list[tuple], columns: np.ndarray, number: int, bins: int) -> Tree:
    tree, active = Tree.stump(), np.array([0])
    fan = -(-len(rows.inputFiles()) // FAN_IN)
    for _ in range(max(p.depth, 1)):
        shared = spark.sparkContext.broadcast((p, width, done, tree.arrays(), active, columns, number, bins))
        parts = rows.mapInArrow(_summer(shared), "column int, sums binary")
        if fan > 1:
            parts = (parts.withColumn("part", F.expr(f"spark_partition_id() div {FAN_IN}")).groupBy("column", "part")
                     .applyInArrow(_together, "column int, sums binary"))
        found = parts.groupBy("column").applyInArrow(_finder(p, len(active), bins), "column int, splits binary").collect()
        shared.unpersist()
        if not found:
            break
        # (column, node, 7 numbers): bounded by columns and nodes
        splits = np.stack([np.frombuffer(r["splits"], "<f8").reshape(-1, 7) for r in sorted(found, key=lambda r: r["column"])])
        if len(tree.feature) == 1:
            tree.gradient[0], tree.curvature[0] = splits[0, 0, 5:7]
        before = len(tree.feature)
        for k, node in enumerate(active):
            best = int(splits[:, k, 0].argmax())          # of equal gains the first column
            gain, code, missing, left_g, left_h, g, h = splits[best, k]
            if gain > 1e-6:
                tree.split(int(node), int(columns[best]), int(code), bool(missing), float(gain),
                           ((left_g, left_h), (g - left_g, h - left_h)))
        active = np.arange(before, len(tree.feature))
        if not len(active):
            break
    _prune(tree, p.gamma)
    _leaf_values(tree, p)
    return tree
