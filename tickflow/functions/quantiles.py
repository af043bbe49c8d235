"""Exact quantiles of many columns, by the same steps at every size.

The wanted order statistics are narrowed down by repeated histograms: each pass scans the columns once,
counts inside the tasks into a bounded number of buckets of all open intervals, and shrinks every interval to the
smallest and largest value of the bucket that holds the wanted rank. A value is looked up among its column's own
intervals, so the work of a pass grows with the values and not with the ranks asked for. Every pass splits an interval's
smallest from its largest value, so the steps end for any finite values. Values that are not finite count
as missing. What reaches the driver is one row per wanted rank.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Buckets of all open intervals together, which is what a task sends at most; each interval gets an equal share.
CELLS = 1 << 17
MOST_BUCKETS = 1 << 13

# the functions travel with the job, so the workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unpivot(df: DataFrame, columns: list[str], keep: list[str] | None = None,
            cast: str = "double") -> DataFrame:
    """(keep..., c, x): one row per row and column."""
    keep = keep or []
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast(cast).alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.c", "_p.x")


def profile(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Count, minimum, maximum, mean and sample deviation per column, in one scan.

    A task sends one row per column; those of a column meet in one place.
    """
    parts = (df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(_moments, MOMENTS)
             .groupBy("c").applyInArrow(_merged, MOMENTS))
    out = {}
    for r in parts.collect():
        n, there = r["n"], r["n"] > 0
        square = r["square"] if r["square"] < math.inf else math.nan          # a spread beyond all doubles is unknown
        out[columns[r["c"]]] = {"c": columns[r["c"]], "n": n, "low": r["low"] if there else None, "high": r["high"] if there else None,
                                "mean": r["total"] / n if there else None, "std": math.sqrt(square / (n - 1)) if n > 1 else None}
    return out


MOMENTS = "c int, n long, low double, high double, total double, centre double, square double"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: number, least, most, sum, mean and squared deviations of each column's values. NaN counts as the largest."""
    found: dict[int, tuple] = {}
    for batch in batches:
        for i, column in enumerate(batch.columns if batch.num_rows else ()):
            x = column.drop_null().to_numpy(zero_copy_only=False)
            own = 0, np.nan, np.nan, 0.0, 0.0, 0.0
            if len(x):
                with np.errstate(invalid="ignore", over="ignore"):
                    low, high, total = np.fmin.reduce(x), x.max(), x.sum()
                    # a constant has no spread, whatever its sum is rounded to
                    centre = low if low == high else total / len(x)
                    own = len(x), low, high, total, centre, 0.0 if low == high and np.isfinite(low) else np.square(x - centre).sum()
            found[i] = _both(found[i], own) if i in found else own
    if found:
        yield _moment_rows(zip(*((i, *f) for i, f in found.items())))


def _both(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", over="ignore"):
        apart = b[4] - a[4]
        return (n, np.fmin(a[1], b[1]), np.maximum(a[2], b[2]), a[3] + b[3], a[4] + apart * (b[0] / n),
                a[5] + b[5] + apart * apart * (a[0] / n * b[0]))


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in table.column_names)), key=str)     # sums in one order
    found = rows[0][1:]
    for r in rows[1:]:
        found = _both(found, r[1:])
    return pa.Table.from_batches([_moment_rows([(v,) for v in (rows[0][0], *found)])])


def _moment_rows(columns) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), *[pa.float64()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(list(v), k, from_pandas=False) for v, k in zip(columns, kinds)],
                                      ["c", "n", "low", "high", "total", "centre", "square"])


def finite(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., c, x) of the values that are numbers."""
    return unpivot(df, columns, keep).where(F.abs("x") < float("inf"))


def order_statistics(df: DataFrame, probs: dict[str, list[float]],
                     buckets: int | None = None) -> dict[str, list[tuple[float, float, float]] | None]:
    """For each column and probability the values around the rank and the share of the way between them;
    None for a column without values. Take them through a monotone function to get its quantiles."""
    columns = [c for c in probs if probs[c]]
    if not columns:
        return {c: [] for c in probs}
    shape = {columns[r["c"]]: r for r in df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
             .mapInArrow(_ends, "c int, n long, low double, high double").groupBy("c").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    ranks = {c: [(shape[c]["n"] - 1) * p for p in probs[c]] for c in columns if c in shape}
    still = {(c, k): (shape[c]["low"], shape[c]["high"], 0)
             for c, hs in ranks.items() for h in hs for k in (math.floor(h), math.ceil(h))}
    stats = _narrowed(df, still, buckets)
    return {c: [(stats[c, math.floor(h)], stats[c, math.ceil(h)], h - math.floor(h)) for h in ranks[c]]
            if c in ranks else None for c in columns}


def between(low: float, high: float, share: float) -> float:
    gap = high - low
    return low + gap * share if math.isfinite(gap) else low * (1 - share) + high * share


def quantiles(df: DataFrame, probs: dict[str, list[float]],
              buckets: int | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the finite values; None for a column without one."""
    found = order_statistics(df, probs, buckets)
    return {c: [None] * len(probs[c]) if found[c] is None else [between(*s) for s in found[c]]
            for c in probs if c in found}


def _counted(shared, spans: int, each: int):
    """Task: number, smallest and largest of the finite values in each bucket in use.

    `shared` has for each column the (number, lowest, highest) of its open intervals, which are disjoint and ascending.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last = np.zeros(spans * each, np.int64), np.full(spans * each, np.inf), np.full(spans * each, -np.inf)
        for batch in batches:
            for column, own in zip(batch.columns, shared.value):
                number, low, high = own[:, 0].astype(np.int64), own[:, 1], own[:, 2]
                x = np.sort(column.to_numpy(zero_copy_only=False))       # missing values go to the end
                ends = np.searchsorted(x, high, side="right")
                begins = np.minimum(np.searchsorted(x, low), ends)
                x = np.concatenate([x[a:b] for a, b in zip(begins, ends)])
                if not len(x):
                    continue
                # halves, where the width itself is too large for a double
                with np.errstate(over="ignore"):
                    unit = np.where(np.isfinite(high - low), 1.0, 0.5)
                start, width, first_cell = low * unit, high * unit - low * unit, number * each
                if len(own) > 1:
                    unit, start, width, first_cell = (np.repeat(v, ends - begins) for v in (unit, start, width, first_cell))
                cell = first_cell + np.minimum(((x * unit - start) / width * each).astype(np.int64), each - 1)
                begin = np.flatnonzero(np.diff(cell, prepend=-1))
                end = np.append(begin[1:], len(x))
                cell = cell[begin]
                n[cell] += end - begin
                first[cell] = np.minimum(first[cell], x[begin])
                last[cell] = np.maximum(last[cell], x[end - 1])
        used = np.flatnonzero(n)
        for a in range(0, len(used), 1 << 16):
            part = used[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part // each).astype(np.int32)), pa.array((part % each).astype(np.int32)), pa.array(n[part]),
                 pa.array(first[part]), pa.array(last[part])], ["id", "b", "n", "first", "last"])
    return count


def binned_counts(edges: list[np.ndarray], names: list[str]):
    """Task: rows by column, bin (the number of inner edges below the value) and class; the last column is the class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        kind, most = None, max(map(len, edges), default=0) + 1
        for batch in batches:
            kind = batch.columns[-1].type
            classes = batch.columns[-1].dictionary_encode(null_encoding="encode")
            which, values = classes.indices.to_numpy(), classes.dictionary.to_pylist()
            for v in values:
                if v not in found:
                    found[v] = np.zeros((len(edges), most), np.int64)
            order = np.argsort(which, kind="stable")
            limits = np.searchsorted(which[order], np.arange(len(values) + 1))
            for i, (column, inner) in enumerate(zip(batch.columns, edges)):
                there = column.is_valid().to_numpy(zero_copy_only=False)[order]
                x = column.to_numpy(zero_copy_only=False)[order]
                for v, a, b in zip(values, limits, limits[1:]):
                    own = np.sort(x[a:b][there[a:b]])
                    found[v][i, :len(inner) + 1] += np.diff(np.searchsorted(own, inner, side="right"), prepend=0, append=len(own))
        for v, counts in found.items():
            at, x = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in at], pa.string()), pa.array(x.astype(np.int32)), pa.array([v] * len(at), kind),
                 pa.array(counts[at, x])], ["c", "b", "y", "n"])
    return count


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: number, smallest and largest of the finite values of each column."""
    found: dict[int, tuple[int, float, float]] = {}
    for batch in batches:
        for i, column in enumerate(batch.columns):
            x = column.to_numpy(zero_copy_only=False)
            x = x[np.isfinite(x)]
            if len(x):
                n, low, high = found.get(i, (0, np.inf, -np.inf))
                found[i] = n + len(x), min(low, float(x.min())), max(high, float(x.max()))
    if found:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), *[pa.array([v[j] for v in found.values()], t)
                                                  for j, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]],
            ["c", "n", "low", "high"])


def _narrowed(df: DataFrame, still: dict[tuple[str, int], tuple[float, float, int]],
              buckets: int | None) -> dict[tuple[str, int], float]:
    """The k-th smallest values (0-based) for every (column, k); `still`: the lowest and highest value that
    may hold it and the rows below that interval."""
    found: dict[tuple[str, int], float] = {}
    spark = df.sparkSession
    while True:
        found |= {key: low for key, (low, high, _) in still.items() if low == high}
        still = {key: span for key, span in still.items() if key not in found}
        if not still:
            return found
        spans = sorted({(c, low, high, below) for (c, _), (low, high, below) in still.items()})
        numbers = {span: i for i, span in enumerate(spans)}
        each = buckets or max(64, min(MOST_BUCKETS, CELLS // len(spans)))
        wanted = spark.createDataFrame(
            [(numbers[c, *span], k - span[2], k) for (c, k), span in still.items()], "id int, place long, k long")
        columns = sorted({s[0] for s in spans})
        shared = spark.sparkContext.broadcast(
            [np.array([(i, lo, hi) for (c, lo, hi, _), i in numbers.items() if c == name], float) for name in columns])
        histogram = (df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
                     .mapInArrow(_counted(shared, len(spans), each), "id int, b int, n long, first double, last double")
                     .groupBy("id", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")))
        upto = F.sum("n").over(W.partitionBy("id").orderBy("b"))
        rows = (histogram.withColumn("upto", upto).join(F.broadcast(wanted), "id")
                .where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))).collect())
        shared.unpersist()
        names = {i: span for span, i in numbers.items()}
        for r in rows:
            c, _, _, below = names[r["id"]]
            low, high, under = r["first"], r["last"], r["upto"] - r["n"]
            if r["place"] == under:
                high = low
            elif r["place"] == r["upto"] - 1:
                low = high
            still[c, r["k"]] = (low, high, below + under)
