"""Exact k nearest neighbours: pivot blocks, bounds by the triangle inequality, rounds with shrinking radii.

Training rows go to their nearest pivot and, where a pivot has many, to rings by distance from it. What is known of
a block (its pivot and ring) bounds from below how near its rows can be to a query. Queries go to batches the same
way. In the first round a batch meets the block it is nearest to, which gives each query a radius; in every further
round it meets the next few blocks that can still hold a row within the radius of one of its queries. Nothing is
left out for certain reasons only, so the result is exact.

For the Bray-Curtis distance sum |a - b| / sum |a + b| the numerator obeys the triangle inequality in the L1 norm,
and the denominator is at most the sum of both L1 norms, which gives the bound there.

A meeting is one grouped task with a fixed amount of work space: pieces of at most `block_rows` training rows and as
many queries. Pivots and rings are bounded in number, whatever the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tickflow.runtime import written

BLOCK_ROWS = 8192
PIVOTS, RINGS = 4096, 16  # at most; blocks are pivots times rings
MEETINGS = 240            # tasks of a round, where there are no more shuffle partitions
FOLDS = 100               # folds that blocks count apart, at most
# distances of one step of a meeting (8 bytes each, up to four such arrays)
WORK_CELLS = 1 << 20
# vectors up to this length are compared in full, as are those of a step with more candidates than one in so many
SHORT, FEW = 8, 16
# cells of a tile of rough sums, and its columns at most
TILE, ACROSS = 1 << 16, 4096
# queries of a step along one coordinate
NEXT = 32
# bounds are taken this much lower, so that rounding never hides a row
SLACK = 1e-9

# the grouped functions travel with the job, so the workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of few vectors to each other, in place by coordinate: (len(a), len(b))."""
    apart, total = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)) if metric == "braycurtis" else (0, 0))
    for k in range(a.shape[1]):
        if metric == "braycurtis":
            total += np.abs(a[:, k, None] + b[:, k])
            apart += np.abs(a[:, k, None] - b[:, k])
        else:
            apart += (a[:, k, None] - b[:, k]) ** 2
    if metric != "braycurtis":
        return np.sqrt(apart)
    return np.divide(apart, total, out=np.zeros_like(apart), where=total != 0)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared Euclidean distances by one matrix product, and how far they may be off at most; None for numbers that
    do not square."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = float(np.square(a).sum(axis=1).max(initial=0)) + float(np.square(b).sum(axis=1).max(initial=0))
        if not 1e-250 < most < 1e250:
            return None
        off = 16 * (a.shape[1] + 8) * np.finfo(float).eps * most
        return np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1) - 2 * (a @ b.T), off


def _candidates(a: np.ndarray, b: np.ndarray, k: int, radius: np.ndarray, barred: np.ndarray | None) -> np.ndarray | None:
    """Which of the vectors `b` can be among the k nearest within the radius of each of `a`: none that is, is left out.

    None where distances in full cost less: for short vectors, and where rounding leaves many candidates.
    """
    found = _squares(a, b) if a.shape[1] > SHORT else None
    if found is None:
        return None
    square, off = found
    if barred is not None:
        square[barred] = np.inf
    with np.errstate(over="ignore"):
        limit = radius * radius * (1 + 1e-9) + off
    near = square <= limit[:, None]
    many = np.flatnonzero(near.sum(axis=1) > 2 * k) if square.shape[1] > k else []
    if len(many):
        nearest = np.partition(square[many], k - 1, axis=1)[:, k - 1]
        near[many] = square[many] <= np.minimum(limit[many], nearest + 2 * off)[:, None]
    near &= square < np.inf
    return near if near.sum() <= near.size / FEW else None


def _rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Sums of |a - b| and of |a + b| in single precision, tile by tile, and how far each may be off at most; None for
    numbers out of its range."""
    sizes = np.abs(a).sum(axis=1), np.abs(b).sum(axis=1)
    if not sizes[0].max(initial=0) + sizes[1].max(initial=0) < 1e30:
        return None
    left, right = a.astype(np.float32), np.ascontiguousarray(b.T, np.float32)
    apart, total = (np.zeros((len(a), len(b)), np.float32) for _ in range(2))
    high = TILE // max(1, min(len(b), ACROSS))
    term = np.empty((min(high, len(a)), min(ACROSS, len(b))), np.float32)
    for i in range(0, len(a), high):
        for j in range(0, len(b), ACROSS):
            gap, whole = (x[i:i + high, j:j + ACROSS] for x in (apart, total))
            own = term[:gap.shape[0], :gap.shape[1]]
            for c in range(a.shape[1]):
                x, y = left[i:i + high, c, None], right[c, j:j + ACROSS]
                gap += np.abs(np.subtract(x, y, out=own), out=own)
                whole += np.abs(np.add(x, y, out=own), out=own)
    off = ((a.shape[1] + 8) * float(np.finfo(np.float32).eps) * (sizes[0][:, None] + sizes[1]) + 1e-36).astype(np.float32)
    return apart, total, off


def _braycurtis_candidates(a: np.ndarray, b: np.ndarray, k: int, radius: np.ndarray, barred: np.ndarray | None) -> np.ndarray | None:
    """The same for the Bray-Curtis distance, from rough sums and their bounds."""
    found = _rough(a, b) if a.shape[1] > SHORT else None
    if found is None:
        return None
    apart, total, off = found
    if barred is not None:
        apart[barred] = np.inf
    limit = radius.copy()
    if len(b) > k:
        bottom = total - off
        with np.errstate(divide="ignore", invalid="ignore"):
            most = np.where(bottom > 0, (apart + off) / bottom, np.inf).astype(np.float32)
        limit = np.minimum(limit, np.partition(most, k - 1, axis=1)[:, k - 1].astype(float) * (1 + 1e-5))
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = apart - off, total + off
        near = low <= (limit[:, None] * (1 + 1e-5)).astype(np.float32) * high
    near |= np.isinf(limit)[:, None]
    near &= apart < np.inf
    return near if near.sum() <= near.size / FEW else None


def _exactly(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (a[i], b[j]), by the same sums as `_distances`."""
    apart, total = np.zeros(len(i)), np.zeros(len(i) if metric == "braycurtis" else 0)
    for c in range(a.shape[1]):
        x, y = a[i, c], b[j, c]
        if metric == "braycurtis":
            total += np.abs(x + y)
            apart += np.abs(x - y)
        else:
            apart += (x - y) ** 2
    if metric != "braycurtis":
        return np.sqrt(apart)
    return np.divide(apart, total, out=np.zeros_like(apart), where=total != 0)


def _full(d: np.ndarray, k: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, d) of the distances that are within the radius and no further than the k-th of their line."""
    limit = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.inf, radius)
    i, j = np.nonzero((d <= np.broadcast_to(limit, len(d))[:, None]) & (d < np.inf))
    return i, j, d[i, j]


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k pairs of each i by distance and number of the row."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def _within(asked: np.ndarray, t: np.ndarray, k: int, metric: str, radius: np.ndarray,
            folds: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows within the radius of each query, ties by the number of the row."""
    found = []
    for s in _steps(len(asked), len(t)):
        barred = folds[0][s][:, None] == folds[1][None, :] if folds else None
        near = (_candidates if metric == "euclidean" else _braycurtis_candidates)(asked[s], t, k, radius[s], barred)
        if near is not None:
            i, j = np.nonzero(near)
            d = _exactly(asked[s], t, i, j, metric)
            own = d <= radius[s][i]
            i, j, d = i[own], j[own], d[own]
        else:
            d = _distances(asked[s], t, metric)
            if barred is not None:
                d[barred] = np.inf
            i, j, d = _full(d, k, radius[s])
        i, j, d = _first(i, j, d, k)
        found.append((s.start + i, j, d))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.empty(0, (int, int, float)[c]) for c in range(3))


def _along(asked: np.ndarray, t: np.ndarray, k: int, radius: np.ndarray,
           folds: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for short vectors under the Euclidean distance: queries and rows are sorted by the coordinate that varies
    most, and a few queries at a time meet the rows within their radius along it. Rows next to a query give it a radius."""
    axis = int(np.argmax(t.max(axis=0) - t.min(axis=0)))
    order, turn = np.argsort(t[:, axis], kind="stable"), np.argsort(asked[:, axis], kind="stable")
    rows, line = t[order], t[order, axis]
    found = []
    for a in range(0, len(asked), NEXT):
        own = turn[a:a + NEXT]
        x, limit = asked[own], radius[own]

        def apart(low: int, high: int) -> np.ndarray:
            d = _distances(x, rows[low:high], "euclidean")
            if folds:
                d[folds[0][own][:, None] == folds[1][order[low:high]][None, :]] = np.inf
            return d

        low, high = np.searchsorted(line, x[[0, -1], axis])
        low, high = max(0, low - 2 * k), min(len(t), high + 2 * k)
        if high - low >= k:
            for b in range(low, high, WORK_CELLS // NEXT):
                part = apart(b, min(high, b + WORK_CELLS // NEXT))
                if part.shape[1] >= k:
                    limit = np.minimum(limit, np.partition(part, k - 1, axis=1)[:, k - 1])
        reach = limit * (1 + SLACK) + SLACK * np.abs(x[:, axis])
        low = np.searchsorted(line, (x[:, axis] - reach).min(), "left")
        high = np.searchsorted(line, (x[:, axis] + reach).max(), "right")
        parts = []
        for b in range(low, high, WORK_CELLS // NEXT):
            i, j, d = _full(apart(b, min(high, b + WORK_CELLS // NEXT)), k, limit)
            parts.append((i, order[b + j], d))
        if parts:
            i, j, d = _first(*(np.concatenate([p[c] for p in parts]) for c in range(3)), k)
            found.append((own[i], j, d))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.empty(0, (int, int, float)[c]) for c in range(3))


def _steps(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, WORK_CELLS // max(columns, 1))
    return (slice(a, a + step) for a in range(0, rows, step))


class Space:
    """Pivots, and the blocks of training rows around them: distance from the pivot and L1 norm, least and most.

    `known` has the arrays pivots and rings and, once there are blocks, block, near, far, low, high and n.
    """

    def __init__(self, metric: str, known: dict[str, np.ndarray]):
        self.metric, self.known = metric, known
        self.pivots, self.rings = known["pivots"], known["rings"]

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distance from every pivot, in the norm that the bounds use."""
        out = np.empty((len(x), len(self.pivots)))
        for s in _steps(len(x), len(self.pivots)):
            if self.metric == "braycurtis":
                out[s] = sum(np.abs(x[s, k, None] - self.pivots[:, k]) for k in range(x.shape[1]))
            else:
                out[s] = _distances(x[s], self.pivots, "euclidean")
        return out

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each row by its nearest pivot and ring, and its distance from that pivot."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0)
        away = self.away(x)
        pivot = away.argmin(axis=1)
        far = away[np.arange(len(x)), pivot]
        ring = (far[:, None] > self.rings[pivot]).sum(axis=1)
        return pivot * (self.rings.shape[1] + 1) + ring, far

    def bounds(self, x: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """How near a row of each of the blocks (by number of their line) can be to each query, at the least."""
        own = {c: self.known[c][blocks] for c in ("block", "near", "far", "low", "high")}
        pivots = own["block"] // (self.rings.shape[1] + 1)
        used, place = np.unique(pivots, return_inverse=True)
        away = Space(self.metric, {"pivots": self.pivots[used], "rings": self.rings}).away(x)[:, place]
        gap = np.maximum(np.maximum(away - own["far"], own["near"] - away), 0) - SLACK * (away + own["far"])
        if self.metric == "braycurtis":
            size = np.abs(x).sum(axis=1)[:, None]
            most = size + own["high"]
            gap = np.maximum(gap, np.maximum(size - own["high"], own["low"] - size) - SLACK * most)
            gap = np.divide(gap, most, out=np.zeros_like(gap), where=most > 0)
        return np.maximum(gap, 0)


def _vectors(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["_v"].to_numpy()).astype(float)


def _placer(known, metric: str, out: str):
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = _vectors(frame)
                block, far = Space(metric, known.value).place(x)
                yield frame.assign(**{out: block, "_far": far, "_size": np.abs(x).sum(axis=1)})
    return place


def _planner(known, metric: str, start: int, stop: int, k: int):
    """Grouped by batch: the blocks at places start to stop of the batch's order that one of its queries needs, and
    whether any further ones may be needed later.

    The order goes by the middle of the batch, which is the same in every round. Under the Euclidean distance blocks that
    are too far from all of the batch are left out at once; where a query has no radius yet, the numbers of rows in blocks
    that lie within one give it.
    """
    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        x, radius = _vectors(frame), frame["_radius"].fillna(np.inf).to_numpy()
        space = Space(metric, known.value)
        blocks = space.known["block"]
        count, batch = len(blocks), int(frame["_batch"].iloc[0])
        near, needed = np.arange(count), np.zeros(count, bool)
        if metric == "euclidean" and np.isfinite(x).all():
            middle = (x.min(axis=0) + x.max(axis=0))[None, :] / 2
            spread = float(_distances(x, middle, metric).max()) * (1 + SLACK)
            least = space.bounds(middle, near)[0]
            most = (_distances(middle, space.pivots, metric)[0][blocks // (space.rings.shape[1] + 1)]
                    + space.known["far"] + spread) * (1 + SLACK)
            order = np.argsort(most, kind="stable")
            enough = np.searchsorted(np.cumsum(space.known["other"][order]), k)
            if enough < count:
                radius = np.minimum(radius, most[order[enough]])
            near = np.flatnonzero(least - spread <= radius.max())
            for s in _steps(len(x), max(len(near), 1)):
                needed[near] |= (space.bounds(x[s], near) <= radius[s, None]).any(axis=0)
        else:
            least = np.full(count, np.inf)
            for s in _steps(len(x), count):
                bound = space.bounds(x[s], near)
                least = np.minimum(least, bound.min(axis=0))
                needed |= (bound <= radius[s, None]).any(axis=0)
        order = np.lexsort((blocks, -space.known["n"], least, blocks != batch >> 20))
        own = order[start:stop][needed[order[start:stop]]]
        more = int(needed[order[stop:]].sum())
        return pd.DataFrame({"_batch": np.full(len(own) + 1, batch, np.int64), "_block": [*blocks[own].tolist(), -1],
                             "more": [0] * len(own) + [more]})
    return plan


def _nearest(space: Space, block: int, asked: np.ndarray, t: np.ndarray, k: int, radius: np.ndarray,
             folds: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): the k nearest rows of a piece of a block, for the queries that can have one there."""
    near = np.flatnonzero(space.bounds(asked, np.flatnonzero(space.known["block"] == block))[:, 0] <= radius)
    if folds:
        folds = folds[0][near], folds[1]
    if space.metric == "euclidean" and t.shape[1] <= SHORT and np.isfinite(t).all() and np.isfinite(asked).all():
        i, j, d = _along(asked[near], t, k, radius[near], folds)
    else:
        i, j, d = _within(asked[near], t, k, space.metric, radius[near], folds)
    return near[i], j, d


def _meeting(known, k: int, metric: str, ids: Sequence[str], apart: bool):
    """Grouped function: the k nearest rows of a piece of a block for the queries that can have one there."""
    def run(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        names = [*[f"q_{c}" for c in ids], *[f"t_{c}" for c in ids], "d", "y"]
        if queries.empty or train.empty:
            return pd.DataFrame({c: [] for c in names})
        train = train.sort_values([f"t_{c}" for c in ids], kind="stable")     # ties go by id
        folds = (queries["_fold"].to_numpy(), train["_fold"].to_numpy()) if apart else None
        of, at, far = _nearest(Space(metric, known.value), train["_block"].iloc[0], _vectors(queries), _vectors(train), k,
                               queries["_radius"].fillna(np.inf).to_numpy(), folds)
        out = {f"q_{c}": queries[f"q_{c}"].to_numpy()[of] for c in ids}
        out |= {f"t_{c}": train[f"t_{c}"].to_numpy()[at] for c in ids}
        return pd.DataFrame(out | {"d": far, "y": train["y"].to_numpy()[at]})
    return run


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)            # NULL is NaN


def _packed_meeting(known, k: int, metric: str, ids: Sequence[str], apart: bool, schema: pa.Schema):
    """The same with one line per query: its neighbours there as an array."""
    def run(queries: pa.Table, train: pa.Table) -> pa.Table:
        if not len(queries) or not len(train):
            return schema.empty_table()
        train = train.sort_by([(f"t_{c}", "ascending") for c in ids])         # ties go by id
        asked, t = (np.asarray(f.column("_v").combine_chunks().flatten(), float).reshape(len(f), -1) for f in (queries, train))
        folds = (_column(queries, "_fold"), _column(train, "_fold")) if apart else None
        radius = np.nan_to_num(_column(queries, "_radius"), nan=np.inf)
        of, at, far = _nearest(Space(metric, known.value), train.column("_block")[0].as_py(), asked, t, k, radius, folds)
        order = np.argsort(of, kind="stable")
        of, at, far = of[order], at[order], far[order]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        rows = train.take(at)
        entry = schema.field("found").type.value_type
        values = [pa.array(far), *[rows.column(f"t_{c}").combine_chunks() for c in ids], rows.column("y").combine_chunks()]
        entries = pa.StructArray.from_arrays([v.cast(f.type) for v, f in zip(values, entry)], fields=list(entry))
        lists = pa.ListArray.from_arrays(np.append(begin, len(of)).astype(np.int32), entries)
        heads = queries.take(of[begin])
        return pa.Table.from_arrays([*[heads.column(f"q_{c}") for c in ids], lists], schema=schema)
    return run


def _dealt(frame: DataFrame, column: str, sizes: pd.DataFrame, ids: Sequence[str], rows: int, out: str) -> tuple[DataFrame, DataFrame]:
    """Number the pieces of about `rows` rows into which each group is dealt by a hash of the ids, and list all pieces.

    `sizes` has a row (group, n) for each group: at most PIVOTS * RINGS.
    """
    spark = frame.sparkSession
    parts = spark.createDataFrame([(int(g), int(ceil(n / rows))) for g, n in zip(sizes["block"], sizes["n"])],
                                  f"{column} long, _parts int")
    dealt = frame.join(F.broadcast(parts), column).withColumn(out, F.pmod(F.xxhash64(*ids), F.col("_parts")).cast("int")).drop("_parts")
    return dealt, parts.select(column, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias(out))


def neighbour_table(train: DataFrame, queries: DataFrame, k: int, ids: Sequence[str], vector: str, y: str,
                    metric: str = "euclidean", block_rows: int = BLOCK_ROWS, fold: str | None = None,
                    pivots: int | None = None, visits: list | None = None) -> DataFrame:
    """ids, neighbours: for each query its k nearest training rows as an array of (d, ids, y), nearest first, ties
    by ids. Any smaller k reads from the same array.

    With `fold` a query has no neighbours of its own fold. `visits` takes the number of (batch, block) meetings of
    each round and of all there could be.
    """
    spark, ids = train.sparkSession, list(ids)
    extra = [F.col(fold).cast("long").alias("_fold")] if fold else []
    source = written(train.select(*[F.col(c).alias(f"t_{c}") for c in ids], F.col(vector).cast("array<double>").alias("_v"),
                                  F.col(y).cast("double").alias("y"), *extra), "knn-rows")
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in ids], F.col(vector).cast("array<double>").alias("_v"), *extra)
    types = {c: dict(train.dtypes)[c] for c in ids}
    neighbour = "struct<d:double," + ",".join(f"`{c}`:{types[c]}" for c in ids) + ",y:double>"
    rows = source.count()
    if not rows:
        return asked.select(*[F.col(f"q_{c}").alias(c) for c in ids], F.expr(f"cast(array() as array<{neighbour}>)").alias("neighbours"))
    # on few rows more pivots than their number asks for, so that there are meetings for all cores; fewer for long vectors,
    # which are sent to nearly every block
    long = source.where(F.size("_v") > SHORT).head() is not None
    count = min(PIVOTS, rows, pivots or max(ceil(2 * rows / block_rows), min(24 if long else 64, rows // 512)))
    # the rows with the smallest hashes of their ids
    chosen = source.orderBy(F.xxhash64(*[f"t_{c}" for c in ids]), *[f"t_{c}" for c in ids]).limit(count).select("_v").collect()
    points = np.unique(np.array([r["_v"] for r in chosen], float), axis=0)
    known = {"pivots": points, "rings": np.empty((len(points), 0))}
    typed = ", ".join(f"{n} {t}" for n, t in source.dtypes) + ", _block long, _far double, _size double"

    def placed_rows() -> DataFrame:
        shared = spark.sparkContext.broadcast(known)
        return written(source.mapInPandas(_placer(shared, metric, "_block"), typed), "knn-placed")

    placed = placed_rows()
    wide = min(RINGS, ceil(rows / (len(points) * block_rows)))
    if wide > 1:
        cuts = placed.groupBy("_block").agg(F.percentile_approx("_far", [i / wide for i in range(1, wide)], 1000).alias("e")).collect()
        known["rings"] = np.full((len(points), wide - 1), np.inf)
        for r in cuts:
            known["rings"][r["_block"]] = r["e"]
        placed = placed_rows()
    # rows that a query of whichever fold may have for neighbours, at the least
    other = F.count(F.lit(1))
    if fold:
        numbers = [r[0] for r in placed.select("_fold").where("_fold is not null").distinct().limit(FOLDS + 1).collect()]
        other = (other - F.greatest(F.lit(0), F.lit(0), *[F.count(F.when(F.col("_fold") == f, 1)) for f in numbers])
                 if len(numbers) <= FOLDS else F.lit(0))
    blocks = placed.groupBy(F.col("_block").alias("block")).agg(
        F.min("_far").alias("near"), F.max("_far").alias("far"), F.min("_size").alias("low"), F.max("_size").alias("high"),
        F.count(F.lit(1)).alias("n"), other.alias("other")).orderBy("block").toPandas()     # at most PIVOTS * RINGS rows
    known = spark.sparkContext.broadcast(known | {c: blocks[c].to_numpy() for c in blocks})
    pieces, split = _dealt(placed.drop("_far", "_size"), "_block", blocks, [f"t_{c}" for c in ids], block_rows, "_piece")
    own = ", ".join(f"{n} {t}" for n, t in asked.dtypes)
    homes = written(asked.mapInPandas(_placer(known, metric, "_home"), f"{own}, _home long, _far double, _size double")
                    .drop("_far", "_size"), "knn-homes")
    sizes = homes.groupBy(F.col("_home").alias("block")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    # queries of one home are one or more batches
    batched, _ = _dealt(homes, "_home", sizes, [f"q_{c}" for c in ids], block_rows, "_part")
    batched = batched.withColumn("_batch", F.col("_home") * F.lit(1 << 20) + F.col("_part"))
    q = [f"q_{c}" for c in ids]
    start, stop, rounds = 0, 1, None
    found_type = asked.select(*q, F.expr(f"cast(array() as array<{neighbour}>)").alias("found")).schema
    packed = to_arrow_schema(found_type)
    while True:
        if rounds is None:
            now = batched.withColumn("_radius", F.lit(None).cast("double"))
        else:
            # only distances are read and shuffled here
            d = F.sort_array(F.flatten(F.collect_list("found.d")))
            radius = rounds.groupBy(*q).agg(F.when(F.size(d) >= k, F.get(d, k - 1)).alias("_radius"))
            now = written(batched.join(radius, q, "left"), "knn-now")
        plan = written(now.groupBy("_batch").applyInPandas(_planner(known, metric, start, stop, k), "_batch long, _block long, more long"),
                       "knn-plan")
        totals = plan.agg(F.count(F.when(F.col("_block") >= 0, 1)), F.sum("more"), F.countDistinct("_batch")).first()
        done, batches = totals[0], totals[2]
        if visits is not None:
            visits.append((done, batches * len(blocks)))
        if done:
            pairs = plan.where("_block >= 0").select("_batch", "_block")
            asking = now.drop("_home", "_part").join(pairs, "_batch")
            asking = asking.join(split, "_block")
            giving = pieces.join(pairs.select("_block", F.col("_batch").alias("_asker")), "_block").withColumnRenamed("_asker", "_batch")
            key = ["_batch", "_block", "_piece"]
            # meetings are small in bytes and long in work: their tasks are not put together
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(done, MEETINGS))
            met = (asking.repartition(tasks, *key).groupBy(*key).cogroup(giving.repartition(tasks, *key).groupBy(*key))
                   .applyInArrow(_packed_meeting(known, k, metric, ids, fold is not None, packed), found_type))
            # blocks differ from round to round, so a neighbour is found once
            met = written(met, "knn-found")
            rounds = met if rounds is None else rounds.unionByName(met)
        if not totals[1]:
            break
        start, stop = stop, stop + 4 * (stop - start)
    none = F.expr(f"cast(array() as array<{neighbour}>)")
    if rounds is None:
        return asked.select(*[F.col(f"q_{c}").alias(c) for c in ids], none.alias("neighbours"))
    best = rounds.groupBy(*q).agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("neighbours"))
    return homes.select(*q).join(best, q, "left").select(
        *[F.col(f"q_{c}").alias(c) for c in ids], F.coalesce("neighbours", none).alias("neighbours"))


def nearest(train: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, y: str,
            metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, t, d, y): the k nearest training rows of each query, ties by id."""
    table = neighbour_table(train, queries, k, [id_col], vector, y, metric, block_rows)
    return table.select(F.col(id_col).alias("q"), F.explode("neighbours").alias("n")).select(
        "q", F.col(f"n.{id_col}").alias("t"), "n.d", "n.y")


def share(k: int, weights: str = "uniform", table: str = "neighbours") -> Column:
    """Share of positive rows among the first k of the neighbours, optionally weighted by inverse distance.

    Where some are at distance 0, these alone count. NULL without neighbours.
    """
    near = f"slice({table}, 1, {k})"
    if weights == "uniform":
        return F.expr(f"try_divide(aggregate({near}, 0D, (s, n) -> s + n.y), size({near}))")
    zeros = f"filter({near}, n -> n.d = 0)"
    return F.expr(
        f"case when size({zeros}) > 0 then aggregate({zeros}, 0D, (s, n) -> s + n.y) / size({zeros}) "
        f"else try_divide(aggregate({near}, 0D, (s, n) -> s + n.y / n.d), aggregate({near}, 0D, (s, n) -> s + 1 / n.d)) end")


def knn_score(train: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, y: str,
              weights: str = "uniform", metric: str = "euclidean",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, prob): share of positive neighbours, optionally weighted by inverse distance."""
    table = neighbour_table(train, queries, k, [id_col], vector, y, metric, block_rows)
    return table.select(id_col, share(k, weights).alias("prob"))


# --- votes with one feature replaced at a time ---------------------------------------------------

QUERY_ROWS = 64
MERGED = 16               # pieces whose neighbours are merged in one task


def _kept(d: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row along the last axis, and their targets."""
    if d.shape[-1] > k:
        at = np.argpartition(d, k - 1, axis=-1)[..., :k]
        return np.take_along_axis(d, at, -1), np.take_along_axis(np.broadcast_to(y, d.shape), at, -1)
    return d, np.broadcast_to(y, d.shape)


def _in_reach(terms: np.ndarray, whole: np.ndarray, other: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that can be among the k nearest with some feature replaced, or with none: replacing takes away
    one term at most, and the k nearest rows as they are bound the k-th distance of every variant."""
    first = np.argpartition(whole, k - 1)[:k]
    variants = whole[first, None] - terms[first] + (other - t[first]) ** 2
    limit = max(float(variants.max(initial=0)), float(whole[first].max()))
    if not np.isfinite(limit):
        return np.arange(len(whole))
    return np.flatnonzero(whole - terms.max(axis=1, initial=0) <= limit + 1e-9 * float(whole.max()))


def _replacing(width: int, k: int):
    """Grouped function: per query, squared distances and targets of the k nearest rows of one block, for the query as
    it is (last) and with each feature replaced."""
    def run(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or train.empty:
            return pd.DataFrame({c: [] for c in ("_q", "_piece", "far", "who")})
        t, y = np.stack(train["_x"].to_numpy()).astype(float), train["_y"].to_numpy().astype(np.int8)
        far, who = [], []
        for x, other in zip(queries["_x"], queries["_p"]):
            terms = (np.asarray(x, float) - t) ** 2
            whole = terms.sum(axis=1)
            zero = 1e-12 * max(whole.max(), 1e-300)
            own = _in_reach(terms, whole, np.asarray(other, float), t, k) if len(t) > 4 * k else slice(None)
            terms, near, least = terms[own], t[own], whole[own]
            d = np.empty((width + 1, len(near)))
            for j in range(width):
                d[j] = least - terms[:, j] + (other[j] - near[:, j]) ** 2
            d[width] = least
            d[d < zero] = 0.0
            kept, target = _kept(d, y[own], k)
            far.append(kept.astype("<f8").tobytes())
            who.append(np.ascontiguousarray(target, np.int8).tobytes())
        return pd.DataFrame({"_q": queries["_q"].to_numpy(), "_piece": train["_block"].iloc[0], "far": far, "who": who})
    return run


def _merging(width: int, k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        far = [np.frombuffer(v, "<f8").reshape(width + 1, -1) for v in frame["far"]]
        who = [np.frombuffer(v, np.int8).reshape(width + 1, -1) for v in frame["who"]]
        d, y = np.concatenate(far, 1), np.concatenate(who, 1)
        if d.shape[1] > k:
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            d, y = np.take_along_axis(d, at, 1), np.take_along_axis(y, at, 1)
        return pd.DataFrame({"_q": frame["_q"].iloc[:1], "_piece": frame["_piece"].iloc[:1] // MERGED,
                             "far": [d.astype("<f8").tobytes()], "who": [np.ascontiguousarray(y).tobytes()]})
    return run


def _voting(width: int, weights: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            probs = []
            for far, who in zip(frame["far"], frame["who"]):
                d = np.sqrt(np.frombuffer(far, "<f8").reshape(width + 1, -1))
                y = np.frombuffer(who, np.int8).reshape(width + 1, -1)
                if weights == "uniform":
                    probs.append(y.mean(axis=1))
                    continue
                zero = d == 0
                w = np.where(zero.any(axis=1, keepdims=True), zero, 1 / np.where(zero, 1, d))
                probs.append((w * y).sum(axis=1) / w.sum(axis=1))
            yield pd.DataFrame({"_q": frame["_q"], "probs": [p.tolist() for p in probs]})
    return run


def replaced_votes(train: DataFrame, queries: DataFrame, width: int, k: int, weights: str, ids: Sequence[str],
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(at, y, w, prob): the vote of the k nearest rows for each query, as it is (at = width) and with feature `at`
    replaced by its other value.

    `train` has ids, `_x` and `_y`, `queries` besides `_p` and `_w`. Every batch of queries meets every block of rows;
    what a block gives is of one size, and blocks are merged by sixteen. Queries are meant to be few.
    """
    rows = written(train, "knn-rows")
    asked = written(queries.withColumn("_q", F.monotonically_increasing_id()), "knn-asked")
    blocks, batches = (max(1, ceil(frame.count() / n)) for frame, n in ((rows, block_rows), (asked, QUERY_ROWS)))
    t = rows.select("_x", "_y", F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("int").alias("_block"),
                    F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("_batch"))
    q = asked.select("_q", "_x", "_p", F.pmod(F.col("_q"), F.lit(batches)).cast("int").alias("_batch"),
                     F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    schema = "_q long, _piece int, far binary, who binary"
    found = (q.groupBy("_batch", "_block").cogroup(t.groupBy("_batch", "_block"))
             .applyInPandas(_replacing(width, k), schema))
    while blocks > 1:
        found = written(found.groupBy("_q", F.expr(f"_piece div {MERGED}")).applyInPandas(_merging(width, k), schema), "knn-merged")
        blocks = ceil(blocks / MERGED)
    votes = found.mapInPandas(_voting(width, weights), "_q long, probs array<double>")
    return votes.join(asked.select("_q", F.col("_y").alias("y"), F.col("_w").alias("w")), "_q").select(
        "y", "w", F.posexplode("probs").alias("at", "prob"))
