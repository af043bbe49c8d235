"""The engineered features.

All look-backs share one window specification per block, so the plan has one shuffle and
one sort for them however many columns are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.functions.scalars import inverse_power, ratio_or_zero, replace_columns, signed_log
from tickflow.order import (DAY_ORDER, Order, drop_halo, global_index, lookup, require_gap_free,
                            with_halo)

LOOK_BACK = 80

# Difference columns that are built before the look-backs.
PAIR_DIFFERENCES = {
    "f_imp_DIF": ("f_imp_c_0p8", "f_imp_v_0p8"),
    "f_int_DIF": ("f_int_c_0p8", "f_int_v_0p8"),
    "f_aggpior_DIF": ("f_aggpior_c", "f_aggpior_v"),
    "f_abs_DIF": ("f_abs_c", "f_abs_v"),
    "f_pagg_DIF": ("f_pagg_c_best_0p7", "f_pagg_v_best_0p7"),
    "f_depth_DIF": ("f_depth_bid7", "f_depth_ask7"),
}

# output -> (column, rows back)
LAG_DIFFERENCES = {
    "f_smart_price_dif": ("f_smart_price", 10),
    "f_smart_price_50": ("f_smart_price", 50),
    "f_rng_ewma_dif": ("f_rng_ewma", 10),
    "f_rng_ewma_dif_40": ("f_rng_ewma", 40),
    "f_rng_ewma_dif_80": ("f_rng_ewma", 80),
    "f_vewma_10": ("f_vewma", 10),
    "f_vewma_g_p_10": ("f_vewma_g_p", 10),
    "f_imp_DIF_10": ("f_imp_DIF", 10),
    "f_imp_DIF_50": ("f_imp_DIF", 50),
    "f_agg_net_10": ("f_agg_net_d", 10),
    "f_agg_net_40": ("f_agg_net_d", 40),
    "f_agg_net_80": ("f_agg_net_d", 80),
    "f_loc_agg_net_10": ("f_loc_agg_net_d", 10),
    "f_aggbig_net_10": ("f_aggbig_net_d", 10),
    "f_int_DIF_10": ("f_int_DIF", 10),
    "f_int_DIF_50": ("f_int_DIF", 50),
    "f_aggpior_DIF_30": ("f_aggpior_DIF", 30),
    "f_abs_DIF_30": ("f_abs_DIF", 30),
    "f_abagg_10": ("f_abagg", 10),
    "f_book_imb_dif": ("f_book_imb", 10),
    "f_msg_imb_dif": ("f_msg_imb", 10),
    "f_depth_DIF_10": ("f_depth_DIF", 10),
}

# output -> (column, rows in the window)
ROLLING_RANGES = {"f_rng_smart_10": ("f_smart_price", 11), "f_rng_smart_50": ("f_smart_price", 51)}
ROLLING_MEANS = {
    "f_book_imb_mean_10": ("f_book_imb", 11),
    "f_book_imb_mean_40": ("f_book_imb", 41),
    "f_msg_imb_mean_10": ("f_msg_imb", 11),
    "f_msg_imb_mean_40": ("f_msg_imb", 41),
    "f_sspread_mean": ("f_sspread", 11),
}

# output -> (column, updates in the window)
UPDATE_MEANS = {
    "f_book_imb_mean_us_5": ("f_book_imb", 6),
    "f_book_imb_mean_us_20": ("f_book_imb", 21),
    "f_sspread_mean_us_5": ("f_sspread", 6),
}

PRICE = ["f_smart_price_dif", "f_smart_price_50", "f_rng_smart_10", "f_rng_smart_50", "f_ohlc_10",
         "f_ohlc_50", "f_rng_ewma_dif", "f_rng_ewma_dif_40", "f_rng_ewma_dif_80", "f_vewma_10",
         "f_vewma_g_p_10", "f_imp_DIF", "f_imp_DIF_10", "f_imp_DIF_50"]
VOLUME = ["f_agg_net_10", "f_agg_net_40", "f_agg_net_80", "f_loc_agg_net_10", "f_aggbig_net_10",
          "f_int_DIF", "f_int_DIF_10", "f_int_DIF_50", "f_imp_FCAST_10", "f_imp_FCAST_40",
          "f_aggpior_DIF", "f_aggpior_DIF_30", "f_abs_DIF", "f_abs_DIF_30", "f_pagg_DIF",
          "f_abagg_10"]
BOOK = ["f_book_imb_dif", "f_book_imb_mean_10", "f_book_imb_mean_40", "f_book_imb_mean_dif_lp",
        "f_book_imb_mean_dif_cp", "f_msg_imb_dif", "f_msg_imb_mean_10", "f_msg_imb_mean_40",
        "f_msg_imb_mean_dif_lp", "f_msg_imb_mean_dif_cp", "f_sspread_mean", "f_depth_DIF",
        "f_depth_DIF_10"]
UPDATE = list(UPDATE_MEANS)
# input columns of all families
READ = {c for pair in PAIR_DIFFERENCES.values() for c in pair} | {
    c for rule in (LAG_DIFFERENCES, ROLLING_RANGES, ROLLING_MEANS, UPDATE_MEANS) for c, _ in rule.values()} - {*PAIR_DIFFERENCES}


def _window_rule(spec, k: int):
    return spec.rowsBetween(1 - k, 0)


def _full(col: str, k: int, spec, value: Column) -> Column:
    """``value`` once the window holds k non-null rows."""
    return F.when(F.count(col).over(_window_rule(spec, k)) == k, value)


def lag_difference(col: str, n: int, order: Order = DAY_ORDER) -> Column:
    return F.col(col) - F.lag(col, n).over(order.rows())


def rolling_range(col: str, k: int, order: Order = DAY_ORDER) -> Column:
    w = _window_rule(order.rows(), k)
    return _full(col, k, order.rows(), F.max(col).over(w) - F.min(col).over(w))


def rolling_mean(col: str, k: int, order: Order = DAY_ORDER) -> Column:
    return _full(col, k, order.rows(), F.avg(col).over(_window_rule(order.rows(), k)))


def with_look_backs(df: DataFrame, exprs: dict[str, Column], order: Order = DAY_ORDER,
                    rows: int = LOOK_BACK) -> DataFrame:
    """Evaluate window expressions over ``order.rows()`` that look back at most ``rows`` rows."""
    haloed = with_halo(df, rows, order)
    return drop_halo(haloed.select("*", *[e.alias(name) for name, e in exprs.items()]))


def update_means(df: DataFrame, means: dict[str, tuple[str, int]] | None = None,
                 order: Order = DAY_ORDER) -> DataFrame:
    """Last non-null value per (day, update), averaged over the last k updates.

    The window runs over all updates in (day, update) order and crosses days. One row per
    (day, update).
    """
    means = means or UPDATE_MEANS
    columns = sorted({col for col, _ in means.values()})
    last = df.groupBy(order.part, "update").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order.pos))).alias(c) for c in columns])
    per_update = Order(order.part, "update", order.block_rows, order.broadcast_rows)
    indexed = global_index(last, "_row", per_update).withColumn("_all", F.lit(0))
    whole = Order("_all", "_row", order.block_rows, order.broadcast_rows)
    widest = max(k for _, k in means.values())
    rolled = with_look_backs(
        indexed, {out: rolling_mean(c, k, whole) for out, (c, k) in means.items()}, whole, widest)
    return rolled.select(order.part, "update", *means)


def basic_features(df: DataFrame, families: Sequence[str] = ("price", "volume", "book", "update"),
                   order: Order = DAY_ORDER) -> DataFrame:
    """Append the engineered features of the chosen families (46 for all)."""
    wanted = {"price": PRICE, "volume": VOLUME, "book": BOOK, "update": UPDATE}
    outputs = [name for family in families for name in wanted[family]]
    row_wise = [f for f in families if f != "update"]
    # the means come first, while rows are narrow
    out = lookup(df, update_means(df, order=order), [order.part, "update"], order) if "update" in families else df
    if row_wise:
        require_gap_free(df, order)
        present = set(df.columns)
        pairs = {o: F.col(a) - F.col(b) for o, (a, b) in PAIR_DIFFERENCES.items()
                 if a in present and b in present}
        out = out.select("*", *[e.alias(o) for o, e in pairs.items()])
        need = set(outputs)
        look = {o: lag_difference(c, n, order) for o, (c, n) in LAG_DIFFERENCES.items() if o in need}
        look |= {o: rolling_range(c, k, order) for o, (c, k) in ROLLING_RANGES.items() if o in need}
        look |= {o: rolling_mean(c, k, order) for o, (c, k) in ROLLING_MEANS.items() if o in need}
        out = with_look_backs(out, look, order)
        derived = {
            "f_ohlc_10": ratio_or_zero(F.col("f_smart_price_dif"), F.col("f_rng_smart_10")),
            "f_ohlc_50": ratio_or_zero(F.col("f_smart_price_50"), F.col("f_rng_smart_50")),
            "f_imp_FCAST_10": F.col("f_imp_DIF") * F.col("f_agg_net_10"),
            "f_imp_FCAST_40": F.col("f_imp_DIF") * F.col("f_agg_net_40"),
            "f_book_imb_mean_dif_lp": F.col("f_book_imb_mean_10") - F.col("f_book_imb_mean_40"),
            "f_book_imb_mean_dif_cp": F.col("f_book_imb") - F.col("f_book_imb_mean_10"),
            "f_msg_imb_mean_dif_lp": F.col("f_msg_imb_mean_10") - F.col("f_msg_imb_mean_40"),
            "f_msg_imb_mean_dif_cp": F.col("f_msg_imb") - F.col("f_msg_imb_mean_10"),
        }
        out = out.select("*", *[e.alias(o) for o, e in derived.items() if o in outputs])
    return out.select(*df.columns, *outputs)


def difference_features(df: DataFrame) -> DataFrame:
    """Bid minus ask, buy minus sell and absolute-value columns; use before the logarithm."""
    pairs = {}
    if "aggpior_c_aux" in df.columns:
        pairs["aggpior_aux_DIF"] = ("aggpior_c_aux", "aggpior_v_aux")
        pairs["pagg_aux_DIF"] = ("pagg_c_best_0p7_aux", "pagg_v_best_0p7_aux")
    for size, exponent in zip(C.PROP_SIZES, ["2", "1p2", "0p8"]):
        pairs[f"escora_{size}_{exponent}_DIF"] = (
            f"escora_bid_{size}_{exponent}", f"escora_ask_{size}_{exponent}")
    for size in C.PROP_SIZES:
        pairs[f"movesc_{size}_0p7_DIF"] = (f"movesc_bid_{size}_0p7", f"movesc_ask_{size}_0p7")
    absolute = ["book_imb_mean_dif_cp", "msg_imb_mean_40", "msg_imb_mean_dif_lp"]
    return df.select(
        "*",
        *[(F.col(a) - F.col(b)).alias(o) for o, (a, b) in pairs.items()],
        *[F.abs(c).alias(c + "_ABS") for c in absolute])


def proportion_grid(df: DataFrame) -> DataFrame:
    """Impute the resting-order columns and add all size x exponent and size x fade differences."""
    imputed = replace_columns(df, {c: f"coalesce(`{c}`, {inverse_power(14, e)})"
                                   for key, e in C.PROP_EXPONENTS.items() for c in C.prop_names(key)})
    grid = [(F.col(f"escora_bid_{s}_{e}") - F.col(f"escora_ask_{s}_{e}")).alias(f"escora_DIF_{s}_{e}")
            for s in C.PROP_SIZES for e in C.PROP_EXPONENTS]
    grid += [(F.col(f"movesc_bid_{s}_{f}") - F.col(f"movesc_ask_{s}_{f}")).alias(f"movesc_DIF_{s}_{f}")
             for s in C.PROP_SIZES for f in C.MOVE_FADES]
    return imputed.select("*", *grid)


def log_volume(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: signed_log(c) for c in columns})


def duplicate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).alias(c + "_2") for c in columns])


def union_select(df: DataFrame, *groups: Sequence[str]) -> DataFrame:
    """Two column subsets side by side; a column named twice appears once more with a suffix."""
    seen: dict[str, int] = {}
    out = []
    for name in [c for g in groups for c in g]:
        seen[name] = seen.get(name, 0) + 1
        out.append(F.col(name).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(*out)
