"""Joins by key, by rank and as-of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.order import DAY_ORDER, Order, backward_fill, lookup
from tickflow.runtime import written


def _suffixed(other: DataFrame, taken: Sequence[str], on: Sequence[str], suffix: str) -> DataFrame:
    return other.select(*[F.col(c).alias(c + suffix) if c in taken and c not in on else F.col(c)
                          for c in other.columns])


def left_join(df: DataFrame, other: DataFrame, on: list[str], suffix: str = "_right",
              order: Order = DAY_ORDER) -> DataFrame:
    """Left join on a group key; clashing names of the right side get ``suffix``."""
    return lookup(df, _suffixed(other, df.columns, on, suffix), on, order)


def left_join_rows(df: DataFrame, other: DataFrame, suffix: str = "_right") -> DataFrame:
    """Left join row by row on the four-part key, which is unique."""
    return df.join(_suffixed(other, df.columns, C.KEY, suffix), C.KEY, "left")


def outer_join_views(views: Sequence[tuple[str, DataFrame]], on: Sequence[str] = C.KEY) -> DataFrame:
    """Full outer join of feature views; a clashing name gets the view's suffix."""
    def step(left: DataFrame, view: tuple[str, DataFrame]) -> DataFrame:
        suffix, right = view
        return left.join(_suffixed(right, left.columns, on, suffix), list(on), "full")
    return reduce(step, views[1:], views[0][1])


def side_by_side(rankings: Sequence[DataFrame]) -> DataFrame:
    """Rankings next to each other by position; each has (position, ...) with unique names."""
    return reduce(lambda a, b: a.join(b, "position", "full"), rankings)


def asof_forward(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str,
                 carried: Sequence[str], order: Order = DAY_ORDER) -> DataFrame:
    """For each left row and each carried column: its first non-null value on the right at
    or after the left id, inside ``by``.

    ``right`` has one row per (by, id). Left ids are reduced to distinct values first, the
    two id sets are merged and filled backwards block by block, and the result is looked
    up again, so neither a hot day nor a hot id meets in one task.
    """
    wanted = left.select(by, F.col(left_on).alias("_id")).where("_id is not null").distinct()
    types = dict(right.dtypes)
    merged = written(
        right.select(by, F.col(right_on).alias("_id"), *carried, F.lit(0).alias("_want"))
        .unionByName(wanted.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in carried],
                                   F.lit(1).alias("_want")))
        .groupBy(by, "_id")
        .agg(*[F.max(c).alias(c) for c in carried], F.max("_want").alias("_want")), "ids")
    by_id = Order(by, "_id", order.block_rows, order.broadcast_rows)
    filled = (backward_fill(merged, list(carried), by_id).where("_want = 1")
              .select(by, F.col("_id").alias(left_on), *carried))
    return lookup(left, filled, [by, left_on], order)
