import random

import pytest
from pyspark.sql import functions as F

from tickflow.operators import backtest, joins, labels, regimes
from tickflow.operators.labels import LabelSpec
from tickflow.order import Order

TINY = Order(block_rows=2, broadcast_rows=0)
SCHEMA = ("date_trd string, update long, time string, trd_id long, side string, first_price double, id_run long, "
          "s_run long, max_run double, flag_d long, id_p long, seq long, chg_max double, chg_max_mp double, "
          "freq double")


def row(day, i, id_run, s_run, id_p, chg_max, *, mp=None, max_run=0.0, flag_d=0, update=None, freq=10.0,
        price=100.0, side="+"):
    return (day, i if update is None else update, "t", i, side, price, id_run, s_run, max_run, flag_d, id_p, i,
            chg_max, mp, freq)


def test_regimes_by_hand(frame):
    df = frame(SCHEMA, [
        row("d1", 0, 0, 1, 0, 5.0),                       # first row of the frame: no previous leg
        row("d1", 1, 0, 1, 1, -5.0, flag_d=1),            # against a directional run
        row("d1", 2, 0, 1, 2, 5.0, flag_d=1),             # with a directional run
        row("d1", 3, 0, 1, 2, 5.0, flag_d=1),             # same leg
        row("d1", 4, 0, 0, 3, -5.0, flag_d=1),            # run without sign
        row("d1", 5, 0, 1, 4, 0.0, flag_d=1),             # no change of price
        row("d1", 6, 0, 1, 5, 7.0, flag_d=0),             # not directional
        row("d2", 0, 0, 1, 6, -1.0),                      # leg id goes on over the day boundary
        row("d3", 0, 0, 1, 0, 1.0),                       # leg id starts again
    ])
    for order in (Order(), TINY):
        got = [r["model"] for r in regimes.tag_regimes(df, order).orderBy("date_trd", "trd_id").collect()]
        assert got == [None, "mi_down", "md_up", None, "mw_down", None, "mw_up", "mw_down", None]


def test_first_update_is_dropped_per_day(frame):
    df = frame(SCHEMA, [row("d1", 0, 0, 1, 0, 1.0, update=7), row("d1", 1, 0, 1, 0, 1.0, update=7),
                        row("d1", 2, 0, 1, 0, 1.0, update=8), row("d2", 0, 0, 1, 0, 1.0, update=8)])
    for order in (Order(), TINY):
        assert [(r["date_trd"], r["trd_id"]) for r in regimes.without_first_update(df, order).collect()] == [("d1", 2)]


def test_labels_by_hand(frame):
    df = frame(SCHEMA, [
        row("d1", 0, 0, -1, 0, -1.0, max_run=-1.0, update=0),
        # new directional run at its extreme: leg 1 is the ideal start
        row("d1", 1, 1, 1, 1, 2.0, mp=1.0, max_run=2.0, flag_d=1, update=1),
        row("d1", 2, 1, 1, 2, -1.0, mp=-2.0, max_run=2.0, flag_d=1, update=2),
        row("d1", 3, 1, 1, 3, 9.0, mp=1.0, max_run=9.0, flag_d=1, update=3),
    ])
    for order in (Order(), TINY):
        tagged = regimes.tag_regimes(df, order)

        def ys(spec):
            out = labels.export_label(labels.apply_label(tagged, spec, order)).orderBy("trd_id").collect()
            return [(r["trd_id"], r["model"], r["y"]) for r in out]
        assert ys(LabelSpec(threshold=0.6)) == [(1, "md_up", 1.0), (2, "mi_down", 0.0), (3, "md_up", 1.0)]
        # still to come: 9 - 2 at the start, 9 - 9 at the end
        assert ys(LabelSpec(threshold=0.6, dist=True)) == [(1, "md_up", 1.0), (2, "mi_down", 0.0), (3, "md_up", 0.0)]
        assert ys(LabelSpec("regression", dist=True, threshold=2, percent=False)) == [
            (1, "md_up", 7.0), (2, "mi_down", 0.0), (3, "md_up", 0.0)]
        assert ys(LabelSpec("regression", threshold=0.6)) == [
            (1, "md_up", 0.9), (2, "mi_down", 0.0), (3, "md_up", 0.9)]
        assert ys(LabelSpec(threshold=12, percent=False, custom_direction=True)) == [
            (1, "md_up", 0.0), (2, "mi_down", 0.0), (3, "md_up", 0.0)]


def test_label_options_are_checked():
    with pytest.raises(ValueError):
        LabelSpec("c_multi")
    with pytest.raises(ValueError):
        LabelSpec(threshold=0.5, percent=False)
    assert LabelSpec(threshold=0.4, dist=True).name("ft_") == (
        "prefix_ft__type_c_binary_th_0.4_dist_True_percent_True_custom_False")


def test_asof_forward(frame):
    left = frame("date_trd string, trd_id long, id long", [
        ("a", 0, 1), ("a", 1, 3), ("a", 2, 3), ("a", 3, 9), ("b", 0, 1), ("c", 0, None)])
    right = frame("date_trd string, rid long, v string", [("a", 3, "x"), ("a", 2, "w"), ("b", 5, "y")])
    for order in (Order(), TINY):
        got = joins.asof_forward(left, right, "date_trd", "id", "rid", ["v"], order)
        assert [tuple(r) for r in got.select("date_trd", "trd_id", "v").orderBy("date_trd", "trd_id").collect()] == [
            ("a", 0, "w"), ("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("b", 0, "y"), ("c", 0, None)]


def exit_frame(frame):
    return frame(SCHEMA + ", model string, prob double", [
        row("d", 0, 0, 1, 0, 1.0, price=100.0) + (None, 0.9),
        row("d", 1, 0, 1, 1, 1.0, price=101.0) + ("mi_up", 0.9),
        row("d", 2, 1, -1, 2, 1.0, price=103.0, side="-") + ("mi_up", 0.9),
        row("d", 3, 2, 1, 3, 1.0, price=104.0) + ("mi_down", 0.9),
        row("d", 4, 3, -1, 4, 1.0, price=99.0) + (None, 0.9),
        row("d", 5, 3, 1, 4, 1.0, price=98.0) + ("mw_down", 0.9),      # second sign of run 3
        row("e", 0, 0, 0, 0, 1.0, price=50.0) + ("mw_up", 0.1),
    ])


def test_exit_study_by_hand(frame):
    df = exit_frame(frame)
    for order in (Order(), TINY):
        out = backtest.scored_trades(df, order).orderBy("date_trd", "trd_id").collect()
        assert len(out) == 7                               # two signs do not multiply rows
        assert [r["s_run_next"] for r in out] == [-1, -1, 1, -1, 0, 0, 0]
        assert [r["id_run_exit"] for r in out] == [0, 1, 3, 4, 4, 4, 1]
        assert [r["exit_price"] for r in out] == [None, 103.0, 99.0, None, None, None, None]
        assert [r["entry_price"] for r in out] == [None, 101.0, 103.5, 103.5, None, 97.5, 50.0]
        assert [r["position"] for r in out] == [None, 5, 5, -5, None, -5, None]
        assert [r["delta_p"] for r in out] == [0.0, 2.0, -4.5, 0.0, 0.0, 0.0, 0.0]


def test_grid_equals_brute_force_and_is_monotone(frame):
    rng = random.Random(7)
    rows = [("mi_up", rng.random(), round(rng.uniform(-60, 60) * 4) / 4) for _ in range(400)]
    rows += [("mi_down", 0.9, 0.0), ("mi_down", 0.9, -2.0), ("mi_down", 0.9, 2.0), ("md_up", 0.9, 5.0)]
    df = frame("model string, prob double, delta_p double", rows)
    grid = {(r["model"], r["i"], r["j"]): r["pnl"] for r in backtest.stop_gain_grid(df).collect()}
    limits = {"mi_up": 0.56, "mi_down": 0.52}
    assert len(grid) == 2 * 76 * 76
    for (m, i, j), pnl in grid.items():
        if i % 9 == 0 or j in (4, 79):
            want = sum(min(max(d, -i / 2), j / 2) for k, p, d in rows if k == m and p > limits[m])
            assert abs(pnl - want) < 1e-9
    assert all(grid["mi_up", 4, j] <= grid["mi_up", 4, j + 1] + 1e-9 for j in range(4, 79))


def test_best_cell_takes_the_first_on_ties(frame):
    grid = frame("model string, i long, j long, pnl double", [
        ("m", 5, 4, 2.0), ("m", 4, 6, 2.0), ("m", 4, 5, 2.0), ("m", 6, 4, -9.0)])
    best = {o: tuple(backtest.best_cell(grid, o).select("i", "j").first())
            for o in ("pnl", "ratio", "ratio_negative_stop")}
    assert best == {"pnl": (4, 5), "ratio": (4, 5), "ratio_negative_stop": (6, 4)}


def test_outer_join_suffixes(frame):
    key = "date_trd string, update long, time string, trd_id long"
    a = frame(key + ", x long", [("d", 0, "t", 0, 1)])
    b = frame(key + ", x long, z long", [("d", 0, "t", 0, 2, 3), ("d", 0, "t", 1, 4, 5)])
    out = joins.outer_join_views([("", a), ("_me", b)]).orderBy("trd_id").collect()
    assert [(r["x"], r["x_me"], r["z"]) for r in out] == [(1, 2, 3), (None, 4, 5)]
