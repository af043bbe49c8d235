"""Regime classification and the feature matrix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.order import DAY_ORDER, Order, lookup, previous_row


def tag_regimes(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``model``: the regime of a row on which the leg id rises, else NULL."""
    with_previous = previous_row(df, ["id_p"], order)
    agreement = F.col("chg_max") * F.col("s_run")
    directional = F.col("flag_d") == 1
    kind = (F.when(directional & (agreement < 0), "mi")
            .when(directional & (agreement > 0), "md")
            .otherwise("mw"))
    side = F.when(F.col("chg_max") > 0, "_up").when(F.col("chg_max") < 0, "_down")
    rises = F.col("id_p") > F.col("prev_id_p")
    return with_previous.withColumn("model", F.when(rises, F.concat(kind, side))).drop("prev_id_p")


def regime_counts(df: DataFrame) -> DataFrame:
    return df.where("model is not null").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def first_updates(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """First non-null update of each day, one row per day."""
    return df.groupBy(order.part).agg(
        F.min_by("update", F.when(F.col("update").isNotNull(), F.col(order.pos))).alias("first_update"))


def without_first_update(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    joined = lookup(df, first_updates(df, order), [order.part], order)
    return joined.where(~F.col("update").eqNullSafe(F.col("first_update"))).drop("first_update")


def feature_columns(df: DataFrame, pattern: str = "f_") -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def feature_matrix(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Key, ``model`` and features (two-letter prefix removed) of all rows with a regime."""
    kept = without_first_update(df, order).where("model is not null")
    names = feature_columns(kept)
    return kept.selectExpr(*C.KEY, "model", *[f"`{c}` as `{c[2:]}`" for c in names])


def one_regime(df: DataFrame, regime: str) -> DataFrame:
    return df.where(F.col("model") == regime).drop("model")


def label_source(df: DataFrame) -> DataFrame:
    return df.select(*C.KEY, *C.LABEL_SOURCE)
