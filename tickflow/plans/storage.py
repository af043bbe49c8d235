"""Queries: sources and sinks. Files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.functions.scalars import round_doubles
from tickflow.operators import labels
from tickflow.operators.labels import LabelSpec
from tickflow.order import DAY_ORDER
from tickflow.plans.labelling import BINARY, TH, label_sql
from tickflow.plans.registry import query, r6, r6s, sql
from tickflow.plans.ticks import RAW_FEATURES, ticks
from tickflow.plans.windows import FIRST_UPDATE, tagged
from tickflow.runtime import new_path
from tickflow.sources import files

TRADE_CSV = ("date_trd date, update long, time string, seq long, side string, first_price double, "
             "s_run long, prob double")


def _trade_files(spark, sf):
    """One CSV folder per day and block, rows in order."""
    folder = new_path(spark, "csv")
    blocks = DAY_ORDER.tag(ticks(spark, sf)).withColumn(
        "ft_day", F.concat_ws("_", "date_trd", "_blk"))
    (blocks.select("ft_day", "date_trd", "update", "time", "seq", "side", "first_price", "s_run", "prob")
     .repartition("ft_day").sortWithinPartitions("ft_day", "seq")
     .write.partitionBy("ft_day").option("header", True).csv(folder))
    return folder


@query("src_multi_csv", sql(
    f"select date_trd, update, time, side, s_run, {r6s('first_price', 'prob')} from ticks "
    "where date_trd::varchar like '%2024-01-1%'"))
def src_multi_csv(spark, sf):
    """All files of the days whose name contains 2024-01-1."""
    scan = files.scan_csv(spark, _trade_files(spark, sf), "ft_day=2024-01-1", TRADE_CSV)
    return round_doubles(scan.select("date_trd", "update", "time", "side", "s_run", "first_price", "prob"))


@query("src_row_id", sql("select date_trd, seq, trd_id from ticks"))
def src_row_id(spark, sf):
    trades = files.read_trades(spark, _trade_files(spark, sf), "ft_day", TRADE_CSV)
    return trades.select("date_trd", "seq", "trd_id")


@query("src_single_csv", "select o_orderkey, o_orderpriority, (round(o_totalprice, 6) + 0.0) as o_totalprice "
                         "from orders")
def src_single_csv(spark, sf):
    path = new_path(spark, "single")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.select(F.col("o_orderkey").alias("Unnamed: 0"), "o_orderkey", "o_orderpriority", "o_totalprice") \
        .write.option("header", True).csv(path)
    return round_doubles(files.read_table_csv(
        spark, path, "`Unnamed: 0` long, o_orderkey long, o_orderpriority string, o_totalprice double"))


@query("src_regime_tables", sql(
    f"select date_trd, trd_id, model, {r6s('chg_max')} from tagged where model is not null", tagged=True))
def src_regime_tables(spark, sf):
    folder = new_path(spark, "regimes")
    frame = tagged(spark, sf).where("model is not null").select("date_trd", "trd_id", "chg_max", "model")
    frame.write.partitionBy("model").option("header", True).csv(folder)
    paths = {m: f"{folder}/model={m}" for m in C.REGIMES}
    schema = "date_trd date, trd_id long, chg_max double"
    return round_doubles(files.read_regime_tables(spark, paths, schema))


@query("sink_X", sql(
    "select t.date_trd, t.update, t.time, t.trd_id, t.model, "
    + ", ".join(r6(f"f_{n}", n) for n in RAW_FEATURES)
    + " from tagged t join firsts f using (date_trd) "
      "where t.update <> f.first_update and t.model is not null", FIRST_UPDATE, tagged=True))
def sink_x(spark, sf):
    folder = new_path(spark, "train")
    files.write_features(tagged(spark, sf, features=True), folder, "ft_")
    return round_doubles(files.load_saved(spark, folder, "X_samples_ft_"))


@query("sink_y_source", sql(
    "select date_trd, update, time, trd_id, side, id_run, s_run, flag_d, id_p, seq, model, "
    + r6s("first_price", "max_run", "chg_max", "chg_max_mp", "freq") + " from tagged", tagged=True))
def sink_y_source(spark, sf):
    folder = new_path(spark, "train")
    files.write_label_source(tagged(spark, sf), folder, "ft_")
    return round_doubles(files.load_saved(spark, folder, "y_source_ft_"))


@query("sink_y", sql(
    f"select date_trd, update, time, trd_id, model, {r6(BINARY[True], 'y')} from labelled "
    "where model is not null", FIRST_UPDATE, label_sql(), tagged=True))
def sink_y(spark, sf):
    spec = LabelSpec(threshold=TH, dist=True)
    folder = new_path(spark, "train")
    files.write_label(labels.apply_label(tagged(spark, sf), spec), folder, "ft_", spec)
    return round_doubles(files.load_saved(spark, folder, f"y_{spec.name('ft_')}"))


@query("src_saved", sql("select date_trd, trd_id, side from ticks"))
def src_saved(spark, sf):
    folder = new_path(spark, "saved")
    ticks(spark, sf).select("date_trd", "trd_id", "side").write.parquet(f"{folder}/trades")
    try:
        files.load_saved(spark, folder, "absent")
    except FileNotFoundError:
        return files.load_saved(spark, folder, "trades")
    raise AssertionError("a missing table was not reported")


@query("sink_csv_overwrite", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def sink_csv_overwrite(spark, sf):
    path = new_path(spark, "result")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    files.write_csv(line.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), path)
    files.write_csv(line.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_table_csv(spark, path, "l_returnflag string, l_linestatus string, n long")


@query("sink_csv_append", "select 1 as run, l_returnflag, count(*) as n from lineitem group by 2 "
                          "union all select 2, o_orderstatus, count(*) from orders group by 2")
def sink_csv_append(spark, sf):
    path = new_path(spark, "runs")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    one = line.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    two = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    files.write_csv(one.select(F.lit(1).alias("run"), "l_returnflag", "n"), path, header=False)
    files.write_csv(two.select(F.lit(2).alias("run"), "o_orderstatus", "n"), path, "append", header=False)
    return spark.read.schema("run int, l_returnflag string, n long").csv(path)
