import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.operators import features, prep
from tickflow.order import Order
from tickflow.plans import ticks as trade_table
from tickflow.plans.ticks import ticks
from tickflow.plans.windows import featured, tagged

SMALL = "/root/testdata/sf0.001"


def test_features_do_not_depend_on_blocks_or_partitions(spark):
    df = ticks(spark, SMALL, True)
    want = features.basic_features(df).orderBy("date_trd", "trd_id").collect()
    for order, parts in ((Order(block_rows=96, broadcast_rows=0), 1), (Order(block_rows=80), 8)):
        got = features.basic_features(df.repartition(parts), order=order).orderBy("date_trd", "trd_id").collect()
        assert len(got) == len(want)
        for a, b in zip(want, got):
            for x, y in zip(a, b):
                assert x == y or (isinstance(x, float) and y is not None and abs(x - y) < 1e-9)


def test_hot_day_over_many_blocks(spark):
    """All trades on one day, blocks of 80 rows: the result of one big block."""
    df = ticks(spark, SMALL, True).orderBy("date_trd", "trd_id").limit(1000).withColumn(
        "trd_id", F.row_number().over(Window.orderBy("date_trd", "trd_id")) - 1
    ).withColumn("date_trd", F.lit("2024-01-01")).cache()
    want = features.basic_features(df, ["price"]).orderBy("trd_id").select(*features.PRICE).collect()
    got = features.basic_features(df, ["price"], Order(block_rows=80, broadcast_rows=0)).orderBy(
        "trd_id").select(*features.PRICE).collect()
    assert want == got
    assert sum(r["f_smart_price_50"] is not None for r in got) == 950


def test_gaps_are_refused(spark):
    df = ticks(spark, SMALL, True)
    with pytest.raises(ValueError, match="dense_position"):
        features.basic_features(df.where("trd_id <> 3"), ["price"])


def test_count_of_features():
    names = features.PRICE + features.VOLUME + features.BOOK + features.UPDATE
    assert len(names) == len(set(names)) == 46


def difference_input(frame, aux):
    names = [f"{k}_{side}_{s}_{e}" for side in ("bid", "ask") for s in C.PROP_SIZES
             for k, e in (("escora", "2"), ("escora", "1p2"), ("escora", "0p8"), ("movesc", "0p7"))]
    names += ["book_imb_mean_dif_cp", "msg_imb_mean_40", "msg_imb_mean_dif_lp"]
    if aux:
        names += ["aggpior_c_aux", "aggpior_v_aux", "pagg_c_best_0p7_aux", "pagg_v_best_0p7_aux"]
    return frame(", ".join(f"{n} double" for n in names), [tuple(float(-i) for i in range(len(names)))])


def test_aux_differences_only_with_aux_columns(frame):
    assert "aggpior_aux_DIF" not in features.difference_features(difference_input(frame, False)).columns
    row = features.difference_features(difference_input(frame, True)).first()
    assert row["aggpior_aux_DIF"] == 1.0 and row["msg_imb_mean_40_ABS"] == 25.0


def test_dropped_columns_by_regime():
    weak, strong = prep.dropped_columns("mw_up"), prep.dropped_columns("mi_up")
    assert "vol_trd_aux" in weak and "vol_trd_aux" not in strong
    assert "s_run" in strong and "s_run" not in weak
    assert {"smart_price", "sspread", "escora_bid_4p5_2", "big_c_aux"} <= set(weak) & set(strong)


def test_duplicate_and_union(frame):
    df = frame("a long, b long", [(1, 2)])
    assert features.duplicate(df, ["a"]).first().asDict() == {"a": 1, "b": 2, "a_2": 1}
    assert features.union_select(df, ["a"], ["b", "a"]).columns == ["a", "b", "a_2"]


def test_raw_features_are_the_numbers_of_their_definitions(spark):
    rows = [(s, e, u, v) for s in (-1, 0, 1) for e in (0, 53, 1067, 9_999_999_999) for u in (-7, 0, 13, 4321) for v in (0.0, 2.11, -7.3)]
    core = spark.createDataFrame([*rows, (None, None, None, None)], "s_run long, event_id long, user_id long, value double")
    got = trade_table.with_raw_features(core)
    want = core.select("*", *[F.expr(f"cast({e} as double)").alias("f_" + n) for n, e in trade_table.RAW_FEATURES.items()])
    assert got.columns == want.columns
    assert [str(r) for r in got.collect()] == [str(r) for r in want.collect()]


def test_wide_trades_are_not_shuffled(spark, tmp_path):
    events = [(i, datetime.datetime(2024, 1, 1 + i // 40, 0, 0, i % 40), i % 7, ("click", "view", "error", "purchase")[i % 4], i % 11 + 0.5)
              for i in range(80)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(
        f"{tmp_path}/events.parquet")
    plan = tagged(spark, str(tmp_path), features=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    trades = trade_table.ticks(spark, str(tmp_path)).select("date_trd", "update", "trd_id", *trade_table.FEATURE_SOURCE)
    out = featured(trades)
    moved = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line]
    assert moved and not any("f_big_c_aux" in line for line in moved)
    assert out.count() == 80 and "f_big_c_aux" in out.columns
