"""Exit study: exit run and price, entries, profit per trade and the stop/gain grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.operators.joins import asof_forward
from tickflow.order import DAY_ORDER, Order, forward_fill, lookup
from tickflow.runtime import written


def distinct_runs(df: DataFrame) -> DataFrame:
    return df.select("date_trd", "id_run", "s_run").distinct()


def next_sign(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``s_run_next``: sign of run n+1 of the day, 0 when there is none.

    A run that carries two signs counts with its earliest one, so rows are not multiplied.
    """
    following = (df.groupBy(order.part, "id_run").agg(F.min_by("s_run", order.pos).alias("s_run_next"))
                 .withColumn("id_run", F.col("id_run") - 1))
    return (lookup(df, following, [order.part, "id_run"], order)
            .withColumn("s_run_next", F.coalesce("s_run_next", F.lit(0).cast("long"))))


def exit_run(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``id_run_exit``: the run on which a position opened here is closed."""
    up, down = F.col("model").isin(C.UP_REGIMES), F.col("model").isin(C.DOWN_REGIMES)
    ends = F.col("s_run_next") == 0
    one = (up & ((F.col("s_run") > 0) | ends)) | (down & ((F.col("s_run") < 0) | ends))
    two = (up & (F.col("s_run") <= 0)) | (down & (F.col("s_run") >= 0))
    runs_ahead = F.when(one, 1).when(two, 2)
    marked = df.withColumn("_exit", F.col("id_run") + runs_ahead)
    filled = forward_fill(marked, "_exit", "id_run_exit", order)
    return filled.withColumn(
        "id_run_exit", F.coalesce("id_run_exit", F.lit(0)).cast("long")).drop("_exit")


def run_prices(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """First price of each (day, sign, run)."""
    return df.groupBy(order.part, "s_run", "id_run").agg(
        F.min_by("first_price", F.when(F.col("first_price").isNotNull(), F.col(order.pos)))
        .alias("first_price"))


def asof_run_prices(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Add the price of the first down, up and zero run at or after ``id_run_exit``."""
    def of_sign(sign: int, name: str) -> Column:
        # wrapped, so that a run without a price still counts as the match
        return F.max(F.when(F.col("s_run") == sign, F.struct("first_price"))).alias(name)

    sides = run_prices(df, order).groupBy(order.part, "id_run").agg(
        of_sign(-1, "_down"), of_sign(1, "_up"), of_sign(0, "_zero"))
    joined = asof_forward(df, sides, order.part, "id_run_exit", "id_run",
                          ["_down", "_up", "_zero"], order)
    return joined.select(
        *df.columns, *[F.col(f"_{s}.first_price").alias(f"first_price_{s}")
                       for s in ("down", "up", "zero")])


def exit_price(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``exit_price``: first opposite run, or first zero run when no run follows."""
    price = (F.when(F.col("model").isNotNull() & (F.col("s_run_next") == 0), F.col("first_price_zero"))
             .when(F.col("model").isin(C.UP_REGIMES), F.col("first_price_down"))
             .when(F.col("model").isin(C.DOWN_REGIMES), F.col("first_price_up")))
    # read by the id scan, the price scan and the final lookup
    staged = written(df, "exits")
    return asof_run_prices(staged, order).withColumn("exit_price", price)


def _threshold(thresholds: dict[str, float] | None = None) -> Column:
    out = F.lit(None).cast("double")
    for regime, value in (thresholds or C.REGIME_THRESHOLD).items():
        out = F.when(F.col("model") == regime, value).otherwise(out)
    return out


def entries(df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Add ``position`` (signed size, when the score reaches the regime's threshold) and ``entry_price``.

    ``thresholds`` are those of the fitted models; by default the ones that were studied.
    """
    long, short = F.col("model").isin(C.TRADED_UP), F.col("model").isin(C.TRADED_DOWN)
    sized = F.col("prob") >= _threshold(thresholds)
    position = F.when(long & sized, C.POSITION).when(short & sized, -C.POSITION)
    price, side = F.col("first_price"), F.col("side")
    entry = (F.when(long & (side == "-"), price + C.SPREAD)
             .when(short & (side == "+"), price - C.SPREAD)
             .when((long & (side == "+")) | (short & (side == "-")), price))
    return df.select("*", position.cast("long").alias("position"), entry.alias("entry_price"))


def trade_delta(df: DataFrame) -> DataFrame:
    """Add ``delta_p``: points won per traded unit, 0 without a position."""
    move = F.col("exit_price") - F.col("entry_price")
    won = F.when(F.col("position") > 0, move).when(F.col("position") < 0, -move)
    return df.withColumn("delta_p", F.coalesce(won, F.lit(0.0)))


def scored_trades(df: DataFrame, order: Order = DAY_ORDER,
                  thresholds: dict[str, float] | None = None) -> DataFrame:
    """Exit study from tagged trades with ``prob`` to ``delta_p``."""
    return trade_delta(entries(exit_price(exit_run(next_sign(df, order), order), order), thresholds))


def stop_gain_grid(df: DataFrame, regimes: list[str] | None = None,
                   thresholds: dict[str, float] | None = None) -> DataFrame:
    """Profit for every stop (i half points) and gain (j half points) of the grid, per regime.

    A profit clipped to [-i/2, j/2] is its clipped gain minus its clipped loss, so the
    i x j surface is the difference of two curves. Both come from counts and sums per half
    point, one aggregation with at most two groups per half point whatever the data size.
    """
    regimes = regimes or C.TRADED_DOWN + C.TRADED_UP
    traded = df.where(F.col("model").isin(regimes) & (F.col("prob") > _threshold(thresholds)))
    size = F.abs("delta_p")
    bucket = F.least(F.ceil(size * 2), F.lit(C.GRID_TO + 1)).cast("int")
    sums = (traded.where("delta_p is not null")
            .groupBy("model", (F.col("delta_p") >= 0).alias("_win"), bucket.alias("_b"))
            .agg(F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_n")))

    # per limit k: everything up to k half points in full, k half points for each larger one
    steps = F.explode(F.sequence(F.lit(C.GRID_FROM), F.lit(C.GRID_TO))).alias("k")
    curve = (sums.select("*", steps)
             .groupBy("model", "k")
             .agg(*[F.coalesce(F.sum(F.when(F.col("_win") == win, F.when(
                 F.col("_b") <= F.col("k"), F.col("_sum")).otherwise(F.col("_n") * F.col("k") / 2))),
                 F.lit(0.0)).alias(name) for win, name in ((True, "_gain"), (False, "_loss"))]))
    listed = curve.groupBy("model").agg(F.collect_list(F.struct("k", "_gain", "_loss")).alias("_c"))
    return (listed.select("model", F.explode("_c").alias("_s"), "_c")
            .select("model", "_s", F.explode("_c").alias("_g"))
            .select("model", F.col("_s.k").cast("long").alias("i"), F.col("_g.k").cast("long").alias("j"),
                    (F.col("_g._gain") - F.col("_s._loss")).alias("pnl")))


def best_cell(grid: DataFrame, objective: str = "pnl", digits: int = 9) -> DataFrame:
    """Best cell per regime, the first in (i, j) order on ties.

    ``pnl``: highest profit. ``ratio``: highest profit / |stop|. ``ratio_negative_stop``:
    highest profit / stop with the stop as a negative number, which favours losses; kept
    because the exit study reported it.
    """
    stop = F.col("i") * 0.5
    score = {"pnl": F.col("pnl"), "ratio": F.col("pnl") / stop,
             "ratio_negative_stop": -F.col("pnl") / stop}[objective]
    w = W.partitionBy("model").orderBy(F.round("score", digits).desc(), "i", "j")
    return (grid.withColumn("score", score).withColumn("_rn", F.row_number().over(w))
            .where("_rn = 1").drop("_rn"))


def grid_matrix(grid: DataFrame) -> DataFrame:
    """One row per (regime, stop), one column per gain limit."""
    gains = list(range(C.GRID_FROM, C.GRID_TO + 1))
    wide = grid.groupBy("model", "i").pivot("j", gains).agg(F.first("pnl"))
    return wide.select("model", "i", *[F.col(str(j)).alias(f"g{j}") for j in gains])
