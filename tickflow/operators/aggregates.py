"""Counts, profiles, histograms and other aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.functions.quantiles import profile, quantiles
from tickflow.functions.scalars import right_closed_bin
from tickflow.operators.prep import fit_quantile_bins
from tickflow.order import DAY_ORDER, Order


def rows_per_date(df: DataFrame) -> DataFrame:
    """Rows per day and the total (day NULL)."""
    return df.rollup("date_trd").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), column))


def last_per_run(df: DataFrame, columns: Sequence[str] = ("max_run",),
                 order: Order = DAY_ORDER) -> DataFrame:
    """Last non-null values per (day, frequency, run)."""
    return df.groupBy(order.part, "freq", "id_run").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order.pos))).alias(c) for c in columns])


def mean_run_size(df: DataFrame, by_direction: bool = False, order: Order = DAY_ORDER) -> DataFrame:
    columns = ["max_run", "flag_d"] if by_direction else ["max_run"]
    keys = [order.part, "freq"] + (["flag_d"] if by_direction else [])
    return last_per_run(df, columns, order).groupBy(*keys).agg(
        F.avg(F.abs("max_run")).alias("max_run_abs"))


def trades_per_date(df: DataFrame) -> DataFrame:
    return df.groupBy("date_trd").agg(F.max("trd_id").alias("max_trd_id"))


def describe(df: DataFrame, columns: Sequence[str],
             percentiles: Sequence[float] = tuple(C.PROFILE_PERCENTILES)) -> DataFrame:
    """Long form: (column, statistic, value)."""
    shape = profile(df, list(columns))
    found = quantiles(df, {c: list(percentiles) for c in columns})
    out = []
    for c in columns:
        stats = [("count", shape[c]["n"]), ("mean", shape[c]["mean"]), ("std", shape[c]["std"]),
                 ("min", shape[c]["low"])]
        stats += [(f"{p * 100:g}%", q) for p, q in zip(percentiles, found[c])]
        stats += [("max", shape[c]["high"])]
        out += [(c, name, None if v is None else float(v)) for name, v in stats]
    # a few statistics per column
    return df.sparkSession.createDataFrame(out, "column string, statistic string, value double")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins between minimum and maximum; empty bins included."""
    x = F.col(column)
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if ends["a"] is None:                   # nothing to count: no bins
        return df.sparkSession.createDataFrame([], "bin long, low double, n long")
    low, high = float(ends["a"]), float(ends["b"])
    if low == high:
        low, high = low - 0.5, high + 0.5
    bucket = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    counts = df.where(x.isNotNull()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * ((high - low) / bins)).alias("low"),
        F.coalesce("n", F.lit(0)).alias("n"))


def bin_target_profile(df: DataFrame, column: str, y: str = "y", q: int = 10) -> DataFrame:
    """Mean target and rows per equal-frequency bin (edges included at both ends)."""
    edges = fit_quantile_bins(df, {column: q})[column]
    bucket = F.expr(right_closed_bin(column, edges))
    return (df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bin"))
            .agg(F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n")))


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    n, pos = F.count(y), F.sum(y)
    return df.agg(n.alias("n"), pos.cast("long").alias("positives"), (pos / n).alias("positive_rate"),
                  F.try_divide(n - pos, pos).alias("neg_pos_ratio"),
                  F.try_divide(n, pos).alias("count_per_positive"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weight n / (classes * n_class); one row per class."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes")).first()
    return counts.withColumn("weight", F.lit(float(totals["_all"])) / (totals["_classes"] * F.col("n")))


def null_counts(df: DataFrame, columns: Sequence[str], top: int = 50) -> DataFrame:
    """NULLs per column, the ``top`` columns with most first."""
    sums = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return (sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"))
                                            for c in columns])).alias("_p"))
            .select("_p.*").orderBy(F.desc("nulls"), "column").limit(top))


def any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    flags = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in columns])
    return flags.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(False)).cast("long").alias("has_null"))
        for c in columns])).alias("_p")).select("_p.*")


def range_flag(df: DataFrame, column: str, threshold: float, out: str) -> DataFrame:
    return df.withColumn(out, (F.col(column) > threshold).cast("long"))
