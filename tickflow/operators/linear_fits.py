"""Many penalised linear classifiers at once: every pass over the rows serves all fits that are under way.

Rows are packed once into written blocks of numbers. A pass sends the coefficients of all fits to the tasks and
brings back, per fit, the loss, its gradient, where asked the weighted cross-product of the columns, and counts of
scores by class. From there a fit is algebra on the driver over as many numbers as it has columns: Newton steps,
coordinate descent where there is an L1 penalty, and the removal or addition of a column by a block inverse, which
starts a smaller or larger fit next to its solution. Near a solution steps reuse the last cross-products and a pass
brings back gradients only; whether a fit is done is always judged by its gradient over all rows. Where all rows are
few and fits many, rows are broadcast and fits are dealt to the tasks instead: the same steps without a pass for each.

The objective is the summed weighted loss + l1 |b|_1 + l2 / 2 |b|^2; the intercept is free. Scores are counted in
steps of 1 / RESOLUTION, so areas under the curve are those of rounded scores.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.runtime import written

BLOCK_BYTES = 1 << 18     # features of a stored block (files are written and read by hundreds of blocks)
BLOCK_ROWS = 4096         # rows that a task scores at once, of however many stored blocks
CELLS = 1 << 19           # scores that it computes at once
RESOLUTION = 512          # steps of a unit of score (log-odds or margin)
REACH = 16                # scores beyond are counted as this
FITS = 96                 # fits with cross-products in one pass
MORE_FITS = 640           # fits without them
SIDE_BY_SIDE = 8          # of these, whose sums travel as one row
FAN_IN = 32               # files whose sums meet in one task
CODE_COUNT = 8 * REACH * RESOLUTION          # score steps by side of the split and class
CODES = 1 << 23           # score codes that a task counts at once
AHEAD = 16                # columns whose removal is tried ahead, each from the one before
AT_HAND, MANY = 8 << 20, 64                  # bytes of features up to which a task gets all rows and solves whole fits, if so many
EXTRA = 4                 # columns of a fit beyond those of all fits, up to which they are taken one by one

# the functions travel with the job, so the workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Fit:
    """One classifier: positions of its columns, the fold it does not see or the only one that it sees, its
    penalties and its loss."""

    columns: tuple[int, ...]
    held: int | None = None
    only: int | None = None
    l1: float = 0.0
    l2: float = 0.0
    balanced: bool = False
    loss: str = "logistic"


@dataclass
class State:
    """Where a fit stands: coefficients over all columns and the intercept, and what the last pass found there."""

    fit: Fit
    beta: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    hessian: np.ndarray | None = None        # over its own columns and the intercept
    auc: float = np.nan                      # of the rows that the fit does not see
    train_auc: float = np.nan
    steps: int = 0
    done: bool = False
    previous: tuple | None = field(default=None, repr=False)
    missed: float = np.inf                   # violation at the last point that was taken
    reuse: bool = False                      # the next pass brings no cross-products, the last ones serve
    stale: bool = False                      # they served for the last step already
    curved: int = 0                          # passes with cross-products so far


def _area(positive: np.ndarray, negative: np.ndarray) -> float:
    """ROC AUC from counts by rising score, ties half; NaN without both classes."""
    p, n = positive.sum(), negative.sum()
    if not p or not n:
        return float("nan")
    below = np.cumsum(negative) - negative
    return float((positive * (below + negative / 2)).sum() / (p * n))


def _losses(loss: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its slope and its curvature in the score."""
    if loss == "logistic":
        e = np.exp(-np.abs(z))
        p = np.where(z >= 0, 1.0, e) / (1 + e)
        return np.maximum(z, 0) + np.log1p(e) - y * z, p - y, p * (1 - p)
    side = 2 * y - 1
    gap = np.maximum(1 - side * z, 0)
    return gap ** 2, -2 * side * gap, 2.0 * (gap > 0)


def sees(fit: Fit, fold: int) -> bool:
    return fold != fit.held if fit.only is None else fold == fit.only


class Blocks:
    """Rows of a frame as written blocks: features, target (0 or 1) and fold.

    Rows without a target or with a feature that is missing or not a number are left out. Folds are small
    whole numbers; without a fold column all rows are in fold 0.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], y: str = "y", fold: str | None = None):
        self.columns = list(columns)
        own = df.select(F.array(*[F.col(c).cast("double") for c in self.columns]).alias("x"),
                        F.col(y).cast("double").alias("y"),
                        (F.col(fold).cast("long") if fold else F.lit(0).cast("long")).alias("f"))
        width = len(self.columns)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(width, 1))))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    y, f = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "f"))
                    good = np.isfinite(x).all(axis=1)
                    if good.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v[good].astype(t).tobytes()], pa.binary()) for v, t in ((x, "<f8"), (y, "<f8"), (f, "<i8"))],
                            ["x", "y", "f"])

        rows = own.where("y is not null and f is not null")
        self.table = written(rows.mapInArrow(pack, "x binary, y binary, f binary"), "blocks")
        # from the blocks, whose features are not read for it
        self.counts = {(r["f"], r["y"]): r["n"] for r in self.table.select("y", "f").mapInArrow(_tally, "f long, y int, n long")
                       .groupBy("f", "y").agg(F.sum("n").alias("n")).collect()}
        self.fan = -(-len(self.table.inputFiles()) // FAN_IN)
        self._at_hand = None

    def weights(self, fit: Fit) -> tuple[float, float]:
        """Weight of either class among the rows that the fit sees."""
        if not fit.balanced:
            return 1.0, 1.0
        seen = [sum(n for (f, c), n in self.counts.items() if c == y and sees(fit, f)) for y in (0, 1)]
        return tuple(sum(seen) / (2 * n) if n else 1.0 for n in seen)

    def rows(self, fit: Fit) -> int:
        return sum(n for (f, _), n in self.counts.items() if sees(fit, f))

    @property
    def small(self) -> bool:
        return 8 * sum(self.counts.values()) * len(self.columns) <= AT_HAND

    def solved(self, fits: Sequence[Fit], starts: Sequence[np.ndarray] | None, tolerance: float, most: int) -> list[State]:
        """What `fit_all` finds but for the cross-products, each fit in one task that has all rows; for few rows only."""
        spark = self.table.sparkSession
        if self._at_hand is None:
            own = self.table.toArrow()                       # at most AT_HAND bytes of features
            self._at_hand = spark.sparkContext.broadcast((own, self.columns, self.counts))
        dealt = spark.sparkContext.broadcast((list(fits), None if starts is None else list(starts), tolerance, most))
        tasks = min(len(fits), max(1, spark.sparkContext.defaultParallelism))
        rows = spark.range(0, len(fits), 1, tasks).mapInArrow(_solving(self._at_hand, dealt), "id long, state binary").collect()
        dealt.unpersist()
        return [State(fits[r["id"]], **pickle.loads(r["state"])) for r in sorted(rows, key=lambda r: r["id"])]

    def look(self, states: list[State], hessians: bool) -> None:
        """One pass: loss, gradient, areas and where asked the curvature of every state."""
        per_pass = FITS if hessians else MORE_FITS
        for a in range(0, len(states), per_pass):
            self._look(states[a:a + per_pass], hessians)

    def _look(self, states: list[State], hessians: bool) -> None:
        spark, width = self.table.sparkSession, len(self.columns)
        weights = np.array([self.weights(s.fit) for s in states])
        none = np.iinfo(np.int64).min
        held, only = (np.array([none if v is None else v for v in own]) for own in zip(*((s.fit.held, s.fit.only) for s in states)))
        plan = (np.stack([s.beta for s in states], 1), weights, held, only, [s.fit.loss for s in states],
                [np.array([*s.fit.columns, width]) for s in states], hessians, width)
        shared, each = spark.sparkContext.broadcast(plan), 1 if hessians else SIDE_BY_SIDE
        parts = self.table.mapInArrow(_scan(shared, each), "task int, dense binary, bins binary")
        if self.fan > 1:
            parts = (parts.withColumn("part", F.expr(f"spark_partition_id() div {FAN_IN}")).groupBy("task", "part")
                     .applyInArrow(_added, "task int, dense binary, bins binary"))
        rows = parts.groupBy("task").applyInArrow(
            _finished, "task int, dense binary, auc array<double>, train_auc array<double>").collect()
        shared.unpersist()
        for s in states:                      # where no block has rows
            own = len(s.fit.columns) + 1
            s.loss, s.gradient, s.auc, s.train_auc = 0.0, np.zeros(width + 1), np.nan, np.nan
            if hessians:
                s.hessian = np.zeros((own, own))
        for r in rows:
            own = states[r["task"] * each:(r["task"] + 1) * each]
            for s, dense, auc, train_auc in zip(own, np.frombuffer(r["dense"], "<f8").reshape(len(own), -1), r["auc"], r["train_auc"]):
                s.auc, s.train_auc = auc, train_auc
                s.loss, s.gradient = float(dense[0]), dense[1:width + 2].copy()
                if hessians:
                    size = len(s.fit.columns) + 1
                    s.hessian = dense[width + 2:].reshape(size, size).copy()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by fold and class."""
    for batch in batches:
        own = [(np.frombuffer(f.as_buffer(), "<i8"), np.nan_to_num(np.frombuffer(y.as_buffer(), "<f8")).astype(np.int64))
               for y, f in zip(batch.column("y"), batch.column("f"))]
        if own:
            pairs, n = np.unique(np.concatenate([np.stack(v) for v in own], axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))],
                                             ["f", "y", "n"])


class AtHand:
    """All rows in one process: looks at one fit after the other."""

    weights, rows, small = Blocks.weights, Blocks.rows, False

    def __init__(self, stored: pa.Table, columns: Sequence[str], counts: dict):
        self.columns, self.counts = columns, counts
        parts = list(_pieces(stored.to_batches(), len(columns), sum(counts.values()) or 1))
        self.x, self.y, self.f = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (
            np.empty((0, len(columns) + 1)), np.empty(0), np.empty(0, np.int64))

    def look(self, states: list[State], hessians: bool) -> None:
        for s in states:
            fit, at = s.fit, _own(s)
            z = self.x @ s.beta
            seen = self.f == fit.only if fit.only is not None else self.f != (np.iinfo(np.int64).min if fit.held is None else fit.held)
            weight = self.weights(fit)
            w = np.where(self.y > 0, weight[1], weight[0]) * seen
            value, pull, curve = _losses(fit.loss, z, self.y)
            s.loss, s.gradient = float(w @ value), self.x.T @ (w * pull)
            if hessians:
                part = self.x[:, at] * np.sqrt(w * curve)[:, None]
                s.hessian = part.T @ part
            half = REACH * RESOLUTION
            step = np.clip(np.floor(z * RESOLUTION).astype(np.int64) + half, 0, 2 * half - 1)
            s.auc, s.train_auc = (_area(*(np.bincount(step[side & (self.y == c)], minlength=2 * half) for c in (1, 0)))
                                  for side in (~seen, seen))


def _solving(stored, dealt):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        fits, starts, tolerance, most = dealt.value
        for batch in batches:
            rows = rows or AtHand(*stored.value)
            for i in batch.column("id").to_pylist():
                state = fit_all(rows, [fits[i]], None if starts is None else [starts[i]], tolerance, most)[0]
                kept = {k: v for k, v in vars(state).items() if k not in ("fit", "previous", "hessian")}
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(kept)], pa.binary())], ["id", "state"])
    return solve


def _pieces(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features with a column of ones, target and fold of stored blocks, put together up to about `most` rows."""
    held: list[tuple[np.ndarray, ...]] = []

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, f = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        x = np.ones((len(y), width + 1))
        np.concatenate([h[0].reshape(-1, width) for h in held], out=x[:, :width])
        held.clear()
        return x, y, f

    for batch in batches:
        for raw in zip(*(batch.column(c) for c in ("x", "y", "f"))):
            whole = [np.frombuffer(v.as_buffer(), t) for v, t in zip(raw, ("<f8", "<f8", "<i8"))]
            for a in range(0, len(whole[1]), most):
                own = whole[0][a * width:(a + most) * width], whole[1][a:a + most], whole[2][a:a + most]
                if held and sum(len(h[1]) for h in held) + len(own[1]) > most:
                    yield together()
                held.append(own)
    if held:
        yield together()


def _scan(shared, each: int):
    """Sums of one pass; a row holds those of `each` fits, one after the other.

    Scores are counted in one table of all codes of all fits, so a task's memory does not grow with its rows.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, weights, held, only, losses, own, hessians, width = shared.value
        fits = beta.shape[1]
        dense = [None] * fits
        bins = None
        cells = 2 * REACH * RESOLUTION
        waiting: list[np.ndarray] = []
        total = np.zeros(fits)
        slope = np.zeros((width + 1, fits))
        common, extra = _shared_columns(own, width)

        def count() -> None:
            nonlocal bins
            codes = np.concatenate(waiting, axis=1)
            waiting.clear()
            if bins is None:
                bins = np.zeros((fits, CODE_COUNT), np.int32)
            for t in range(fits):
                bins[t] += np.bincount(codes[t], minlength=CODE_COUNT).astype(np.int32)

        for x, y, f in _pieces(batches, width, min(BLOCK_ROWS, max(1, CELLS // fits))):
            if extra is None:
                z = x @ beta
            else:
                few = np.ascontiguousarray(x[:, common])
                z = few @ beta[common]
                for e in extra:
                    z += x[:, e] * beta[e, np.arange(fits)]
            seen = np.where(only == np.iinfo(np.int64).min, f[:, None] != held, f[:, None] == only)
            w = np.where(y[:, None] > 0, weights[:, 1], weights[:, 0]) * seen
            if len(set(losses)) == 1:
                value, pull, curve = _losses(losses[0], z, y[:, None])
                total += np.einsum("ij,ij->j", w, value)
            else:
                curve = np.empty_like(z)
                pull = np.empty_like(z)
                for kind in sorted(set(losses)):
                    at = [t for t in range(fits) if losses[t] == kind]
                    value, pull[:, at], curve[:, at] = _losses(kind, z[:, at], y[:, None])
                    total[at] += (w[:, at] * value).sum(axis=0)
            pull *= w
            if extra is None:
                slope += x.T @ pull
            else:
                slope[common] += few.T @ pull
                for e in extra:
                    slope[e, np.arange(fits)] += np.einsum("ij,ij->j", x[:, e], pull)
            step = np.clip(np.floor(z * RESOLUTION).astype(np.int64) + cells // 2, 0, cells - 1)
            # one number for each side of the split, class and score step
            code = (step * 2 + (y > 0)[:, None]) * 2 + seen
            waiting.append(np.ascontiguousarray(code.T.astype(np.min_scalar_type(CODE_COUNT - 1))))
            if sum(v.size for v in waiting) >= CODES:
                count()
            for t in range(fits) if hessians else ():
                # a matrix times its own transpose: half the work of a product
                root = np.sqrt(w[:, t] * curve[:, t])
                at = np.flatnonzero(root)
                part = x[at] if len(own[t]) == width + 1 else x[np.ix_(at, own[t])]
                part *= root[at, None]
                h = part.T @ part
                dense[t] = h if dense[t] is None else dense[t] + h
        if waiting:
            count()
        for first in range(0, fits, each) if bins is not None else ():
            mine = range(first, min(first + each, fits))
            numbers = [np.concatenate([[total[t]], slope[:, t]] + ([dense[t].ravel()] if hessians else [])) for t in mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first // each], pa.int32()), pa.array([np.concatenate(numbers).astype("<f8").tobytes()], pa.binary()),
                 pa.array([_packed(bins[first:first + each])], pa.binary())], ["task", "dense", "bins"])
    return scan


def _shared_columns(own: list[np.ndarray], width: int) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Columns that all fits have, and lists of one further column of each fit; no lists where that saves little.

    Slopes of other columns are left at 0 then; no fit moves along them.
    """
    common = own[0]
    for o in own[1:]:
        common = np.intersect1d(common, o)
    rest = [np.setdiff1d(o, common) for o in own]
    most = max(map(len, rest))
    if most > EXTRA or len(common) + 4 * most > width // 2 or min(map(len, rest)) < most:
        return common, None
    return common, [np.array([r[j] for r in rest]) for j in range(most)]


def _packed(counts: np.ndarray) -> bytes:
    """Number of fits, how many codes each has, and the codes and counts that are there; counts come as (fit, code)."""
    fit, code = np.nonzero(counts)
    return b"".join([np.append(len(counts), np.bincount(fit, minlength=len(counts))).astype("<i8").tobytes(),
                     code.astype("<i4").tobytes(), counts[fit, code].astype("<i8").tobytes()])


def _add_packed(raw: pa.Buffer, to: np.ndarray | None) -> np.ndarray:
    """Add packed counts to a table (fit, code), a new one at first."""
    fits = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", fits, 8)
    n = int(sizes.sum())
    codes = np.frombuffer(raw, "<i4", n, 8 * (fits + 1))
    counts = np.frombuffer(raw, "<i8", n, 8 * (fits + 1) + 4 * n)
    out = np.zeros((fits, CODE_COUNT), np.int64) if to is None else to
    out[np.repeat(np.arange(fits), sizes), codes] += counts            # a code of a fit is there once
    return out


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    dense, bins = None, None
    for d, b in zip(table.column("dense"), table.column("bins")):
        own = np.frombuffer(d.as_buffer(), "<f8")
        dense, bins = own.copy() if dense is None else dense + own, _add_packed(b.as_buffer(), bins)
    return dense, bins


def _added(table: pa.Table) -> pa.Table:
    dense, bins = _sums(table)
    return pa.table({"task": table.column("task").slice(0, 1), "dense": pa.array([dense.tobytes()], pa.binary()),
                     "bins": pa.array([_packed(bins)], pa.binary())})


def _finished(table: pa.Table) -> pa.Table:
    dense, bins = _sums(table)
    areas: tuple[list, list] = ([], [])
    for own in bins.reshape(len(bins), -1, 2, 2):           # score step, class, side
        for side in (0, 1):
            areas[side].append(_area(own[:, 1, side], own[:, 0, side]))
    return pa.table({"task": table.column("task").slice(0, 1), "dense": pa.array([dense.tobytes()], pa.binary()),
                     "auc": pa.array([areas[0]], pa.list_(pa.float64())), "train_auc": pa.array([areas[1]], pa.list_(pa.float64()))})


# --- algebra on the driver -----------------------------------------------------------------

def _own(state: State) -> np.ndarray:
    return np.array([*state.fit.columns, len(state.beta) - 1])


def _penalty(state: State) -> float:
    b = state.beta[:-1]
    return state.fit.l1 * np.abs(b).sum() + state.fit.l2 / 2 * (b ** 2).sum()


def _curved(state: State) -> np.ndarray:
    """Curvature with the L2 penalty; a trace of it keeps empty columns solvable."""
    h = state.hessian.copy()
    n = len(h) - 1
    h[np.arange(n), np.arange(n)] += state.fit.l2
    h[np.arange(n + 1), np.arange(n + 1)] += 1e-9 * max(np.trace(h) / (n + 1), 1e-12)
    return h


def _pull(state: State) -> np.ndarray:
    """Gradient over the own columns with the L2 penalty."""
    at = _own(state)
    g = state.gradient[at].copy()
    g[:-1] += state.fit.l2 * state.beta[at[:-1]]
    return g


def minimiser(h: np.ndarray, g: np.ndarray, b: np.ndarray, l1: float, sweeps: int = 500) -> np.ndarray:
    """Minimum of g (x - b) + (x - b) h (x - b) / 2 + l1 |x|_1, the last coordinate without penalty."""
    if l1 == 0:
        return b - np.linalg.solve(h, g)
    found = _by_signs(h, g, b, l1)
    if found is not None:
        return found
    x, r = b.copy(), g.copy()                 # r: gradient of the smooth part at x
    weight = np.full(len(b), l1)
    weight[-1] = 0
    scale = max(np.abs(b).max(), 1e-3)
    for sweep in range(sweeps):
        most = 0.0
        for j in range(len(x)):
            target = x[j] - r[j] / h[j, j]
            new = np.sign(target) * max(abs(target) - weight[j] / h[j, j], 0.0)
            move = new - x[j]
            if move:
                r += h[:, j] * move
                x[j] = new
                most = max(most, abs(move))
        if most <= 1e-10 * scale:
            break
        if sweep % 4 == 3:
            # where the signs are found already, the rest is one solution of equations
            at = np.flatnonzero((x != 0) | (weight == 0))
            side = np.sign(x[at]) * weight[at]
            exact = np.zeros(len(x))
            exact[at] = np.linalg.solve(h[np.ix_(at, at)], h[at] @ b - g[at] - side)
            slope = g + h @ (exact - b)
            if (np.sign(exact[at]) * weight[at] == side).all() and (np.abs(slope) <= weight + 1e-9 * (1 + np.abs(g).max())).all(
                    where=x == 0):
                return exact
    return x


def _by_signs(h: np.ndarray, g: np.ndarray, b: np.ndarray, l1: float, most: int = 400) -> np.ndarray | None:
    """The same minimum by solutions of equations, each for given signs; None where that does not end.

    Between two solutions the best point is taken at which a coordinate meets 0; a coordinate at 0 joins where its
    slope breaks its optimality condition most.
    """
    weight = np.full(len(b), l1)
    weight[-1] = 0
    x, side = b.copy(), np.sign(b)
    near = 1e-9 * (1 + np.abs(g).max())
    fixed = h @ b - g

    def value(v: np.ndarray) -> float:
        return float(v @ (h @ v) / 2 - fixed @ v + weight @ np.abs(v))

    for _ in range(most):
        at = np.flatnonzero((side != 0) | (weight == 0))
        exact = np.zeros(len(x))
        try:
            exact[at] = np.linalg.solve(h[np.ix_(at, at)], fixed[at] - side[at] * weight[at])
        except np.linalg.LinAlgError:
            return None
        crossed = np.flatnonzero((weight > 0) & (x != 0) & (np.sign(exact) != np.sign(x)))
        fits = (np.sign(exact[at]) == side[at])[weight[at] > 0].all()
        if fits and not len(crossed):
            x = exact
        else:
            shares = np.unique(np.append(x[crossed] / (x[crossed] - exact[crossed]), 1.0))
            points = [x + s * (exact - x) for s in shares]
            for p in points:
                p[crossed[np.abs(p[crossed]) <= 1e-12 * np.abs(x[crossed])]] = 0.0
            best = min(points, key=value)
            if value(best) >= value(x) and not np.array_equal(best == 0, x == 0):
                best = points[0]
            if np.array_equal(best, x):
                return None
            x = best
            side = np.sign(x)
            continue
        slope = h @ x - fixed
        broken = np.where((x == 0) & (weight > 0), np.abs(slope) - weight, -np.inf)
        j = int(broken.argmax())
        if broken[j] <= near:
            return x
        side = np.sign(x)
        side[j] = -np.sign(slope[j])
    return None


def violation(state: State) -> float:
    """How far the state is from the optimality conditions, as a share of the rows' scale."""
    g, b = _pull(state), state.beta[_own(state)]
    weight = np.full(len(g), state.fit.l1)
    weight[-1] = 0
    miss = np.where(b != 0, np.abs(g + weight * np.sign(b)), np.maximum(np.abs(g) - weight, 0))
    return float(miss.max())


def fit_all(blocks: Blocks, fits: Sequence[Fit], starts: Sequence[np.ndarray] | None = None, tolerance: float = 1e-7,
            most: int = 60) -> list[State]:
    """Solutions of all fits by Newton steps with step halving; a pass serves all that are not done.

    Done means that no coordinate breaks its optimality condition by more than `tolerance` times the rows.
    """
    if blocks.small and len(fits) >= MANY:
        return blocks.solved(fits, starts, tolerance, most)
    width = len(blocks.columns)
    states = [State(f, np.zeros(width + 1) if starts is None else starts[i].copy()) for i, f in enumerate(fits)]
    for _ in range(4 * most):
        open_ = [s for s in states if not s.done and s.curved < most]
        if not open_:
            break
        for reuse in (False, True):
            own = [s for s in open_ if s.reuse is reuse]
            if own:
                blocks.look(own, hessians=not reuse)
        for s in open_:
            _step(blocks, s, tolerance)
    return states


def _step(blocks: Blocks, s: State, tolerance: float) -> None:
    """Judge the last pass and move on: the next Newton point, or half the way back.

    While the violation falls tenfold a step, the next pass goes without cross-products; where steps by old ones stop
    helping, it brings new ones, if need be at the point before.
    """
    at, rows = _own(s), max(blocks.rows(s.fit), 1)
    value = s.loss + _penalty(s)
    fresh, s.stale = not s.reuse, s.reuse
    s.curved += fresh
    if s.previous is not None and value > s.previous[0] + 1e-10 * abs(s.previous[0]) and s.steps < 30:
        if s.previous[2]:
            s.beta, s.previous, s.reuse, s.missed = s.previous[1], None, False, np.inf
            return
        s.steps += 1
        s.beta = (s.beta + s.previous[1]) / 2
        s.reuse = False
        return
    s.steps = 0
    missed = violation(s)
    if missed <= tolerance * rows:
        s.done = True
        return
    s.previous = (value, s.beta.copy(), s.stale)
    s.beta = s.beta.copy()
    s.beta[at] = minimiser(_curved(s), _pull(s), s.beta[at], s.fit.l1)
    s.reuse = missed < 0.1 * s.missed < np.inf
    s.missed = missed


def _inverse(h: np.ndarray) -> np.ndarray:
    """The inverse, a few columns at a time: for a hundred at once the threads of the linear algebra library can wait for
    each other without end on the driver."""
    unit = np.eye(len(h))
    return np.concatenate([np.linalg.solve(h, unit[:, a:a + 4]) for a in range(0, len(h), 4)], axis=1)


def _inverse_without(inverse: np.ndarray, k: int) -> np.ndarray:
    """Inverse of the matrix without its k-th row and column, from the inverse of the whole."""
    rest = np.delete(np.arange(len(inverse)), k)
    return inverse[np.ix_(rest, rest)] - np.outer(inverse[rest, k], inverse[k, rest]) / inverse[k, k]


@dataclass
class Lessened:
    """An inverse without its k-th row and column, applied without being formed."""

    inverse: np.ndarray
    k: int

    def __call__(self, g: np.ndarray) -> np.ndarray:
        wide = np.insert(g, self.k, 0.0)
        out = self.inverse @ wide
        out -= self.inverse[:, self.k] * (out[self.k] / self.inverse[self.k, self.k])
        return np.delete(out, self.k)

    def formed(self) -> np.ndarray:
        return _inverse_without(self.inverse, self.k)


def _polished(blocks: Blocks, states: list[State], solvers: list, tolerance: float, most: int) -> bool:
    """Newton steps with given inverses until all states are done; False where that does not get there.

    The inverses come from a nearby solution, so a step or two are enough and a pass needs gradients only.
    """
    for _ in range(most):
        open_ = [i for i, s in enumerate(states) if not s.done]
        if not open_:
            return True
        blocks.look([states[i] for i in open_], hessians=False)
        for i in open_:
            s = states[i]
            if violation(s) <= tolerance * max(blocks.rows(s.fit), 1):
                s.done = True
            else:
                at = _own(s)
                s.beta = s.beta.copy()
                s.beta[at] -= solvers[i](_pull(s))
    return all(s.done for s in states)


def _neighbours(blocks: Blocks, family: list[tuple], tolerance: float) -> list[State]:
    """Solutions of fits (fit, start, inverse as a function) that differ little from a solved one."""
    if blocks.small and len(family) >= MANY:
        return fit_all(blocks, [f for f, _, _ in family], [b for _, b, _ in family], tolerance)
    states = [State(f, b.copy()) for f, b, _ in family]
    if not _polished(blocks, states, [k for _, _, k in family], tolerance, 4):
        left = [i for i, s in enumerate(states) if not s.done]
        for i, s in zip(left, fit_all(blocks, [states[i].fit for i in left], [family[i][1] for i in left], tolerance)):
            states[i] = s
    return states


def without_each(blocks: Blocks, parents: list[State], inverses: list[np.ndarray], tolerance: float = 1e-5
                 ) -> dict[int, list[tuple[State, Lessened]]]:
    """For each column of the parents (which share their columns, one parent a fold): the fits without it, with the
    inverses that they were found by.

    A fit starts where the parent's quadratic has its minimum without the column.
    """
    columns = parents[0].fit.columns
    family, names = [], []
    for k, c in enumerate(columns):
        for parent, inverse in zip(parents, inverses):
            at = _own(parent)
            start = parent.beta.copy()
            start[at] -= inverse[:, k] * parent.beta[c] / inverse[k, k]
            start[c] = 0.0
            fit = replace(parent.fit, columns=tuple(o for o in columns if o != c))
            family.append((fit, start, Lessened(inverse, k)))
            names.append(c)
    states = _neighbours(blocks, family, tolerance)
    out: dict[int, list] = {}
    for c, s, (_, _, inverse) in zip(names, states, family):
        out.setdefault(c, []).append((s, inverse))
    return out


def backward(blocks: Blocks, folds: int, keep: int, l2: float = 1.0, balanced: bool = False, refresh: int = 8,
             tolerance: float = 1e-5) -> list[tuple[str, float]]:
    """(dropped column, mean area of the held folds without it) in order, until `keep` columns are left.

    Every step fits all subsets that lack one more column, for all folds, from the same passes. A fit counts as found
    when no slope is above `tolerance` times the rows.
    """
    columns = tuple(range(len(blocks.columns)))
    parents = fit_all(blocks, [Fit(columns, f, l2=l2, balanced=balanced) for f in range(folds)], tolerance=1e-6)
    inverses = [_inverse(_curved(p)) for p in parents]
    log: list[tuple[str, float]] = []
    while len(parents[0].fit.columns) > max(keep, 1):
        if log and len(log) % refresh == 0:
            blocks.look(parents, hessians=True)
            inverses = [_inverse(_curved(p)) for p in parents]
        found = without_each(blocks, parents, inverses, tolerance)
        scores = {c: float(np.mean([s.auc for s, _ in own])) for c, own in found.items()}
        worst = max(found, key=lambda c: (round(scores[c], 12), -c))
        parents, inverses = [s for s, _ in found[worst]], [k.formed() for _, k in found[worst]]
        log.append((blocks.columns[worst], scores[worst]))
    return log


def addition(blocks: Blocks, ordered: Sequence[str], folds: int, threshold: float = 0.002, l2: float = 1.0,
             balanced: bool = False) -> list[tuple[str, float, bool]]:
    """(column, gain, kept): columns in the given order, each kept where it adds more than `threshold` to the mean
    area of the held folds.

    All columns that are still to come are tried on the kept ones at once; the first that gains enough is kept,
    and those before it are what they would have been one by one.
    """
    place = {c: i for i, c in enumerate(blocks.columns)}
    waiting = [place[c] for c in ordered]
    kept = (waiting.pop(0),)
    parents = fit_all(blocks, [Fit(kept, f, l2=l2, balanced=balanced) for f in range(folds)], tolerance=1e-6)
    best = float(np.mean([p.auc for p in parents]))
    log = [(blocks.columns[kept[0]], best, True)]
    everything = tuple(range(len(blocks.columns)))
    while waiting:
        # the parents' curvature and slope over all columns, from which every larger fit takes its start
        wide = [State(replace(p.fit, columns=everything), p.beta) for p in parents]
        blocks.look(wide, hessians=True)
        curved = [_curved(w) for w in wide]
        family = []
        for c in waiting:
            own = tuple(sorted((*kept, c)))
            at = np.array([*own, len(blocks.columns)])
            for w, h in zip(wide, curved):
                inverse = _inverse(h[np.ix_(at, at)])
                start = w.beta.copy()
                start[at] -= inverse @ _pull(w)[at]
                family.append((replace(w.fit, columns=own), start, inverse.__matmul__))
        states = _neighbours(blocks, family, 1e-5)
        for i, c in enumerate(list(waiting)):
            own = states[i * folds:(i + 1) * folds]
            gain = float(np.mean([s.auc for s in own])) - best
            waiting.pop(0)
            log.append((blocks.columns[c], gain, gain > threshold))
            if gain > threshold:
                kept, best, parents = own[0].fit.columns, best + gain, own
                break
    return log


def elimination(blocks: Blocks, folds: int, keep: int = 5, l1: float = 1.0, l2: float = 0.0, balanced: bool = False
                ) -> tuple[list[str], list[float]]:
    """Columns that are left when the one with the smallest coefficient goes each time, on all rows, and the area of
    each held fold under the same elimination without its rows.

    All paths (one per fold and one over all rows) take their steps together, and each tries up to AHEAD removals in the
    same passes: the quadratic at its last fit foretells the next ones, each is brought to its own solution over all
    rows, and they count as far as every solution leaves the column smallest that was removed next. A column with
    coefficient 0 goes without a new fit, as the solution stays what it is.
    """
    everything = tuple(range(len(blocks.columns)))
    paths = fit_all(blocks, [Fit(everything, f, l1=l1, l2=l2, balanced=balanced) for f in [*range(folds), None]], tolerance=1e-6)
    while any(len(p.fit.columns) > keep for p in paths):
        open_ = [i for i, p in enumerate(paths) if len(p.fit.columns) > keep]
        able = [i for i in open_ if _lessened(paths[i], keep)[1] is not None]
        if able:
            blocks.look([paths[i] for i in able], hessians=True)
        chains = {i: _chain(paths[i], keep) if i in able else [] for i in open_}
        _settled(blocks, [link for chain in chains.values() for link in chain], 1e-6)
        alone = []
        for i, chain in chains.items():
            for own, (s, _) in enumerate(chain):
                # the one that the fit before leaves smallest has to be the one that was tried
                if set(_lessened(paths[i], keep)[0]) != set(s.fit.columns):
                    break
                if not s.done:
                    if not own:
                        alone.append((i, s))
                    break
                paths[i] = s
            if _lessened(paths[i], keep)[1] is None:
                paths[i].fit = replace(paths[i].fit, columns=_lessened(paths[i], keep)[0])
        if alone:
            for (i, _), s in zip(alone, fit_all(blocks, [s.fit for _, s in alone], [s.beta for _, s in alone], 1e-6)):
                paths[i] = s
    return [blocks.columns[c] for c in paths[-1].fit.columns], [p.auc for p in paths[:-1]]


def _lessened(s: State, keep: int) -> tuple[tuple[int, ...], int | None]:
    """The columns without those of coefficient 0 and then without the smallest, and which that is; None where `keep`
    columns are left before."""
    columns = list(s.fit.columns)
    while len(columns) > keep:
        least = min(columns, key=lambda c: (abs(s.beta[c]), c))
        columns.remove(least)
        if s.beta[least] != 0:
            return tuple(columns), least
    return tuple(columns), None


def _chain(parent: State, keep: int) -> list[tuple[State, np.ndarray]]:
    """The fits that lack one more column each time, as the parent's quadratic foretells them, with their curvature."""
    curved, pull, at, chain, last = _curved(parent), _pull(parent), _own(parent), [], parent
    for _ in range(AHEAD):
        columns, least = _lessened(last, keep)
        if least is None:
            break
        inside = np.isin(at, [*columns, len(parent.beta) - 1])
        h = curved[np.ix_(inside, inside)]
        base = parent.beta[at]
        g = pull[inside] - curved[np.ix_(inside, ~inside)] @ base[~inside]
        last = State(replace(parent.fit, columns=columns), np.zeros(len(parent.beta)))
        last.beta[at[inside]] = minimiser(h, g, base[inside], parent.fit.l1)
        chain.append((last, h))
    return chain


def _settled(blocks: Blocks, chain: list[tuple[State, np.ndarray]], tolerance: float, most: int = 5) -> None:
    """Steps by the given curvature, all fits in the same passes, which bring gradients only."""
    for k in range(most):
        open_ = [(s, h) for s, h in chain if not s.done]
        if not open_:
            return
        blocks.look([s for s, _ in open_], hessians=False)
        for s, h in open_:
            s.done = violation(s) <= tolerance * max(blocks.rows(s.fit), 1)
            if not s.done and k + 1 < most:
                at = _own(s)
                s.beta = s.beta.copy()
                s.beta[at] = minimiser(h, _pull(s), s.beta[at], s.fit.l1)
