"""Ordered scans against plain Python, with tiny blocks, no broadcast and one hot day."""

import random

import pytest
from pyspark.sql import functions as F

from tickflow import order as o
from tickflow.operators.features import (lag_difference, rolling_mean, rolling_range, update_means,
                                         with_look_backs)
from tickflow.order import Order, require_gap_free

ORDERS = [Order(block_rows=8, broadcast_rows=0), Order(block_rows=8), Order()]
DAYS = {"d1": 3, "d2": 120, "d3": 1, "d4": 17}     # d2 holds most rows


def make_rows():
    rng = random.Random(3)
    rows = []
    for day, n in DAYS.items():
        group = 0
        for i in range(n):
            group += rng.random() < (0.02 if day == "d2" else 0.4)
            value = None if rng.random() < 0.15 else round(rng.uniform(-5, 5), 2)
            rows.append((day, i, group, i // 3, value))
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def df(spark):
    shuffled = ROWS[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(
        shuffled, "date_trd string, trd_id long, g long, update long, x double").repartition(5)


def collected(out, *cols):
    return [tuple(r) for r in out.orderBy("date_trd", "trd_id").select("date_trd", "trd_id", *cols).collect()]


@pytest.mark.parametrize("order", ORDERS)
def test_previous_row_crosses_days(df, order):
    got = collected(o.previous_row(df, ["x", "g"], order), "prev_x", "prev_g")
    before = [None] + [(r[4], r[2]) for r in ROWS[:-1]]
    assert got == [(r[0], r[1], *(b or (None, None))) for r, b in zip(ROWS, before)]
    inside = collected(o.previous_row(df, ["g"], order, across_parts=False), "prev_g")
    assert [g[2] for g in inside] == [None if r[1] == 0 else ROWS[i - 1][2] for i, r in enumerate(ROWS)]


@pytest.mark.parametrize("order", ORDERS)
def test_fills_and_running_values(df, order):
    last, filled = None, []
    for r in ROWS:
        last = r[4] if r[4] is not None else last
        filled.append(last)
    assert [g[2] for g in collected(o.forward_fill(df, "x", "f", order), "f")] == filled

    sums, tops, total, top = [], [], {}, {}
    for r in ROWS:
        total[r[0]] = total.get(r[0], 0) + r[2]
        sums.append(total[r[0]])
        key = (r[0], r[2])
        if r[4] is not None:
            top[key] = max(top.get(key, r[4]), r[4])
        tops.append(top.get(key))
    assert [g[2] for g in collected(o.running_sum(df, "g", "s", order), "s")] == sums
    assert [g[2] for g in collected(o.running_group_max(df, "g", "x", "m", order), "m")] == tops

    ahead, nxt = [], {}
    for r in reversed(ROWS):
        nxt[r[0]] = r[4] if r[4] is not None else nxt.get(r[0])
        ahead.append(nxt[r[0]])
    assert [g[2] for g in collected(o.backward_fill(df, ["x"], order), "x")] == ahead[::-1]


@pytest.mark.parametrize("order", ORDERS)
def test_group_edges_and_lookup(df, order):
    last = {}
    for r in ROWS:
        if r[4] is not None:
            last[r[0], r[2]] = r[4]
    got = collected(o.group_edges(df, "g", last={"e": "x"}, order=order), "e")
    assert [g[2] for g in got] == [last.get((r[0], r[2])) for r in ROWS]
    per_day = df.groupBy("date_trd").agg(F.count(F.lit(1)).alias("n"))
    assert [g[2] for g in collected(o.lookup(df, per_day, ["date_trd"], order), "n")] == [
        DAYS[r[0]] for r in ROWS]


@pytest.mark.parametrize("order", ORDERS)
def test_index_and_ranks(df, order):
    assert [g[2] for g in collected(o.global_index(df, "i", order), "i")] == list(range(len(ROWS)))
    ranks = [0, 2, 3, 50, 123, len(ROWS) - 1]
    found = o.keys_at(df, {0: ranks}, order=order)
    assert {k[1]: v for k, v in found.items()} == {r: (ROWS[r][0], ROWS[r][1]) for r in ranks}


def test_dense_position_and_cumulative(spark, df):
    renumbered = o.dense_position(df.drop("trd_id").withColumn("k", F.monotonically_increasing_id()),
                                  "date_trd", ["k"], "p", partitions=6)
    for day, n in DAYS.items():
        assert sorted(r["p"] for r in renumbered.where(F.col("date_trd") == day).collect()) == list(range(n))
    values = spark.range(100).selectExpr("id % 3 as c", "id div 3 as v", "id + 1 as n")
    got = {(r["c"], r["v"]): r["before_n"] for r in o.cumulative(
        values, ["c"], "v", ["n"], partitions=7, max_rows=0).collect()}
    for c in range(3):
        total = 0
        for v in range(34):
            i = v * 3 + c
            if i < 100:
                assert got[c, v] == total
                total += i + 1


def window_rule(values, i, k, value):
    part = values[max(0, i - k + 1):i + 1]
    return value(part) if len(part) == k and None not in part else None


@pytest.mark.parametrize("order", ORDERS)
def test_look_backs_stop_at_the_day_and_need_full_windows(df, order):
    out = with_look_backs(df, {"d": lag_difference("g", 2, order), "m": rolling_mean("x", 4, order),
                               "r": rolling_range("x", 4, order)}, order, rows=4)
    got = collected(out, "d", "m", "r")
    by_day = {d: [r for r in ROWS if r[0] == d] for d in DAYS}
    for day, i, d, m, r in got:
        rows = by_day[day]
        xs = [q[4] for q in rows]
        assert d == (rows[i][2] - rows[i - 2][2] if i >= 2 else None)
        mean = window_rule(xs, i, 4, lambda p: sum(p) / 4)
        assert (m is None) == (mean is None) and (m is None or abs(m - mean) < 1e-12)
        spread = window_rule(xs, i, 4, lambda p: max(p) - min(p))
        assert r == spread or abs(r - spread) < 1e-12


@pytest.mark.parametrize("order", ORDERS)
def test_update_means_cross_days(df, order):
    updates = {}
    for r in ROWS:
        updates.setdefault((r[0], r[3]), None)
        if r[4] is not None:
            updates[r[0], r[3]] = r[4]
    keys = sorted(updates)
    values = [updates[k] for k in keys]
    got = {(r["date_trd"], r["update"]): r["m"] for r in update_means(df, {"m": ("x", 6)}, order).collect()}
    assert len(got) == len(keys)
    for i, k in enumerate(keys):
        want = window_rule(values, i, 6, lambda p: sum(p) / 6)
        assert (got[k] is None) == (want is None) and (want is None or abs(got[k] - want) < 1e-12)


def test_look_back_longer_than_a_block_is_refused(df):
    with pytest.raises(ValueError):
        with_look_backs(df, {}, Order(block_rows=8), rows=9)


@pytest.mark.parametrize("positions, good", [
    ([0, 1, 2, 3], True), ([0, 1, 1, 3], False), ([0, 2, 3], False), ([5, 6, 7], True), ([0, 1, 4, 5], False), ([0, 0], False),
    ([0, 3, 3, 3], False), ([2], True), ([0, 1, 2, 9, 10], False)])
def test_gaps_and_repeats_cannot_cancel(spark, positions, good):
    df = spark.createDataFrame([("d", p) for p in positions] + [("e", 0), ("e", 1)], "date_trd string, trd_id long")
    for rows in (2, 3, 100):
        if good:
            require_gap_free(df, Order(block_rows=rows))
        else:
            with pytest.raises(ValueError):
                require_gap_free(df, Order(block_rows=rows))


def test_only_groups_that_cross_a_block_are_carried(spark, monkeypatch):
    rows = [("d", i, i // 3, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "d string, p long, g long, x double")
    carried_rows, attach = [], o.attach
    monkeypatch.setattr(o, "attach", lambda left, table, *a, **k: carried_rows.append(table.count()) or attach(left, table, *a, **k))
    got = {r["p"]: r["m"] for r in o.running_group_max(df, "g", "x", "m", o.Order("d", "p", block_rows=8)).collect()}
    assert got == {p: max(r[3] for r in rows if r[2] == g and r[1] <= p) for _, p, g, _ in rows}
    # blocks end after rows 7, 15, 23 and 31; the groups of three rows are cut by the first, second and fourth
    assert carried_rows == [3]
