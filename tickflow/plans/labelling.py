"""Queries: labels, joins, aggregations, split and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.functions.scalars import round_doubles
from tickflow.operators import aggregates, joins, labels, prep
from tickflow.operators.backtest import run_prices
from tickflow.operators.labels import LabelSpec
from tickflow.operators.models import contiguous_folds
from tickflow.plans.registry import query, r6, r6s, sql
from tickflow.plans.ticks import ticks
from tickflow.plans.windows import FIRST_UPDATE, tagged
from tickflow.sources.files import append

TH = 0.2


def label_sql(threshold=TH, custom=None):
    d_run = (f"cast(abs(run_high) >= {custom} * freq as bigint)" if custom
             else "last_flag")
    return f"""
highs as (
  select *, last_value(max_run) over w as run_high, last_value(flag_d) over w as last_flag,
         lag(id_run) over (order by date_trd, trd_id) as prev_run
  from tagged
  window w as (partition by date_trd, id_run order by trd_id
               rows between unbounded preceding and unbounded following)),
directed as (select *, {d_run} as d_run from highs),
legs as (
  select *, case when d_run = 1 and id_run > prev_run then
              case when s_run <> 0 and (chg_max = max_run or chg_max_mp = -max_run)
                   then id_p else id_p - 2 end end as id_first_p
  from directed),
leg_highs as (
  select date_trd, id_first_p as id_p, arg_min(run_high, trd_id) as run_high_dir
  from legs where id_first_p is not null group by 1, 2),
labelled as (
  select l.*, h.run_high_dir, {threshold}::double * freq as th
  from legs l left join leg_highs h using (date_trd, id_p)
  join firsts f using (date_trd) where l.update <> f.first_update)"""


_S = "run_high_dir is not null and model is not null"
_R = "model is not null and chg_max * s_run > 0 and d_run = 1"
_FAR = "run_high - (max_run + chg_max_mp + chg_max)"
BINARY = {
    False: f"""case when {_S} and abs(run_high_dir) >= th then 1.0 when {_S} then 0.0
      when {_R} and abs(run_high) >= th then 1.0 when model is not null then 0.0 end""",
    True: f"""case when {_S} and abs(run_high_dir - chg_max) >= th then 1.0 when {_S} then 0.0
      when {_R} and abs(chg_max) >= abs(chg_max_mp) and abs(run_high - max_run) >= th then 1.0
      when {_R} and abs(chg_max) < abs(chg_max_mp) and abs({_FAR}) >= th then 1.0
      when model is not null then 0.0 end""",
}
REGRESSION = {
    False: f"case when {_S} then run_high_dir when {_R} then run_high when model is not null then 0.0 end",
    True: f"""case when {_S} then run_high_dir - chg_max
      when {_R} and abs(chg_max) >= abs(chg_max_mp) then run_high - max_run
      when {_R} and abs(chg_max) < abs(chg_max_mp) then {_FAR}
      when model is not null then 0.0 end""",
}


@query("lbl_run_high", sql(
    f"select date_trd, trd_id, {r6s('run_high')} from highs", FIRST_UPDATE, label_sql(), tagged=True))
def lbl_run_high(spark, sf):
    return round_doubles(labels.run_high(ticks(spark, sf)).select("date_trd", "trd_id", "run_high"))


@query("lbl_direction", sql(
    "select h.date_trd, h.trd_id, last_flag as d_run, "
    "cast(abs(run_high) >= 0.2::double * freq as bigint) as d_run_custom, "
    "cast(abs(run_high) >= 0.2::double * freq * 2 as bigint) as d_run_custom_dist from highs h",
    FIRST_UPDATE, label_sql(), tagged=True))
def lbl_direction(spark, sf):
    df = ticks(spark, sf)
    plain = labels.run_direction(df, LabelSpec(threshold=TH))
    # both custom rules are projections of the run extreme
    custom = {n: F.coalesce(F.abs("run_high") >= LabelSpec(threshold=TH).limit() * k, F.lit(False))
              .cast("long").alias(n) for n, k in (("d_run_custom", 1), ("d_run_custom_dist", 2))}
    return plain.select("date_trd", "trd_id", "d_run", *custom.values())


@query("lbl_first_leg", sql(
    "select date_trd, trd_id, id_first_p from legs where id_first_p is not null",
    FIRST_UPDATE, label_sql(), tagged=True))
def lbl_first_leg(spark, sf):
    out = labels.first_leg(labels.run_direction(ticks(spark, sf), LabelSpec(threshold=TH)))
    return out.where("id_first_p is not null").select("date_trd", "trd_id", "id_first_p")


@query("lbl_first_leg_dedupe", sql(
    f"select date_trd, id_p, {r6s('run_high_dir')} from leg_highs",
    FIRST_UPDATE, label_sql(), tagged=True))
def lbl_first_leg_dedupe(spark, sf):
    out = labels.first_leg(labels.run_direction(ticks(spark, sf), LabelSpec(threshold=TH)))
    return round_doubles(labels.leg_highs(out))


@query("lbl_dir_join", sql(
    f"select date_trd, trd_id, id_p, {r6s('run_high_dir')} from legs "
    "left join leg_highs using (date_trd, id_p)", FIRST_UPDATE, label_sql(), tagged=True))
def lbl_dir_join(spark, sf):
    out = labels.first_leg(labels.run_direction(ticks(spark, sf), LabelSpec(threshold=TH)))
    return round_doubles(labels.join_leg_highs(out).select("date_trd", "trd_id", "id_p", "run_high_dir"))


def _label(name, spec, expr, ctes):
    @query(name, sql(f"select date_trd, update, time, trd_id, model, {r6(expr, 'y')} from labelled "
                     "where model is not null", FIRST_UPDATE, ctes, tagged=True))
    def run(spark, sf):
        return round_doubles(labels.export_label(labels.apply_label(tagged(spark, sf), spec)))
    return run


_label("lbl_binary", LabelSpec(threshold=TH), BINARY[False], label_sql())
_label("lbl_binary_dist", LabelSpec(threshold=TH, dist=True), BINARY[True], label_sql())
_label("lbl_binary_points", LabelSpec(threshold=40, dist=True, percent=False),
       BINARY[True].replace(">= th", ">= 40"), label_sql())
_label("lbl_binary_custom", LabelSpec(threshold=TH, dist=True, custom_direction=True),
       BINARY[True], label_sql(custom="2 * 0.2::double"))
_label("lbl_regression", LabelSpec("regression", threshold=TH),
       f"({REGRESSION[False]}) / freq", label_sql())
_label("lbl_regression_dist", LabelSpec("regression", dist=True, threshold=TH),
       f"({REGRESSION[True]}) / freq", label_sql())
_label("lbl_regression_points", LabelSpec("regression", dist=True, threshold=40, percent=False),
       REGRESSION[True], label_sql())


@query("lbl_export", sql(
    f"select date_trd, update, time, trd_id, model, {r6(BINARY[False], 'y')} from labelled "
    "where model = 'mw_down'", FIRST_UPDATE, label_sql(), tagged=True))
def lbl_export(spark, sf):
    return round_doubles(labels.export_label(
        labels.apply_label(tagged(spark, sf), LabelSpec(threshold=TH)), "mw_down"))


EXIT_LABEL_SQL = f"""
exit_highs as (
  select *, last_value(max_run) over w as run_high, last_value(flag_d) over w as d_run,
         lag(id_run) over (order by date_trd, trd_id) as prev_run
  from tagged
  window w as (partition by date_trd, id_run order by trd_id
               rows between unbounded preceding and unbounded following)),
exit_legs as (
  select *, case when s_run <> 0 and (chg_max = max_run or chg_max_mp = -max_run) then id_p
                 when id_run > prev_run then id_p - 2 end as id_first_p
  from exit_highs),
exit_leg_highs as (
  select date_trd, id_first_p as id_p, arg_min(run_high, trd_id) as run_high_dir
  from exit_legs where id_first_p is not null group by 1, 2),
exit_labelled as (
  select l.*, h.run_high_dir,
         case when model is null then null when run_high_dir is not null then run_high_dir - chg_max
              when abs(chg_max) >= abs(chg_max_mp) then run_high - max_run
              when abs(chg_max) < abs(chg_max_mp) then {_FAR} end as y
  from exit_legs l left join exit_leg_highs h using (date_trd, id_p))"""


@query("lbl_exit_variant", sql(
    f"select date_trd, trd_id, model, id_first_p, {r6s('run_high_dir', 'y')} from exit_labelled",
    EXIT_LABEL_SQL, tagged=True))
def lbl_exit_variant(spark, sf):
    out = labels.exit_label(tagged(spark, sf))
    return round_doubles(out.select("date_trd", "trd_id", "model", "id_first_p", "run_high_dir", "y"))


# --- joins -----------------------------------------------------------------------------

_UPDATE_LAST = "(select date_trd, update, max(value) as value, count(*) as n from ticks group by 1, 2)"


@query("join_left_multi", sql(
    f"select t.date_trd, t.trd_id, {r6('t.value', 'value')}, {r6('u.value', 'value_update')}, u.n "
    f"from ticks t left join (select * from {_UPDATE_LAST} where n = 3) u using (date_trd, update)"))
def join_left_multi(spark, sf):
    df = ticks(spark, sf).select("date_trd", "trd_id", "update", "value")
    per_update = (df.groupBy("date_trd", "update")
                  .agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n")).where("n = 3"))
    out = joins.left_join(df, per_update, ["date_trd", "update"], "_update")
    return round_doubles(out.drop("update"))


@query("join_left_key4", sql(
    "select t.date_trd, t.update, t.time, t.trd_id, l.y from tagged t left join "
    f"(select *, {r6(BINARY[False], 'y')} from labelled where model is not null) l "
    "using (date_trd, update, time, trd_id)",
    FIRST_UPDATE, label_sql(), tagged=True))
def join_left_key4(spark, sf):
    trades = tagged(spark, sf)
    y = labels.export_label(labels.apply_label(trades, LabelSpec(threshold=TH))).drop("model")
    return round_doubles(joins.left_join_rows(trades.select(*C.KEY), y))


@query("join_align_key", sql(
    f"select date_trd, update, time, trd_id, model, {r6('case when model in (' + ', '.join(repr(m) for m in C.TRADED_UP + C.TRADED_DOWN) + ') then prob end', 'y_hat')} "
    "from tagged where model is not null", tagged=True))
def join_align_key(spark, sf):
    trades = tagged(spark, sf).where("model is not null")
    scores = trades.where(F.col("model").isin(C.TRADED_UP + C.TRADED_DOWN)).select(
        *C.KEY, F.col("prob").alias("y_hat"))
    return round_doubles(joins.left_join_rows(trades.select(*C.KEY, "model"), scores))


@query("join_outer_key4", sql(
    f"select coalesce(a.date_trd, b.date_trd) as date_trd, coalesce(a.update, b.update) as update, "
    f"coalesce(a.time, b.time) as time, coalesce(a.trd_id, b.trd_id) as trd_id, "
    f"{r6('a.value', 'value')}, {r6('b.value', 'value_d')} "
    "from (select * from ticks where s_run >= 0) a full join (select * from ticks where s_run <= 0) b "
    "on a.date_trd = b.date_trd and a.trd_id = b.trd_id"))
def join_outer_key4(spark, sf):
    df = ticks(spark, sf).select(*C.KEY, "s_run", "value")
    a, b = df.where("s_run >= 0").drop("s_run"), df.where("s_run <= 0").drop("s_run")
    return round_doubles(joins.outer_join_views([("", a), ("_d", b)]))


@query("join_concat_cols", sql(
    f"select date_trd, update, time, trd_id, {r6s('value', 'prob')} from ticks"))
def join_concat_cols(spark, sf):
    df = ticks(spark, sf)
    return round_doubles(joins.left_join_rows(df.select(*C.KEY, "value"), df.select(*C.KEY, "prob")))


# --- aggregations ----------------------------------------------------------------------

@query("agg_rows_per_date", sql(
    "select date_trd, count(*) as n from ticks group by rollup (date_trd)"))
def agg_rows_per_date(spark, sf):
    return aggregates.rows_per_date(ticks(spark, sf))


@query("agg_value_counts", sql(
    "select model, count(*) as n from tagged where model is not null group by 1 order by 2 desc, 1",
    tagged=True))
def agg_value_counts(spark, sf):
    return aggregates.value_counts(tagged(spark, sf), "model")


_PER_RUN = """
per_run as (select date_trd, freq, id_run, arg_max(max_run, trd_id) as max_run,
                   arg_max(flag_d, trd_id) as flag_d from ticks group by 1, 2, 3)"""


@query("agg_last_per_run", sql(
    f"select date_trd, id_run, flag_d, {r6s('freq', 'max_run')} from per_run", _PER_RUN))
def agg_last_per_run(spark, sf):
    return round_doubles(aggregates.last_per_run(ticks(spark, sf), ["max_run", "flag_d"]))


@query("agg_mean_run_size", sql(
    f"select date_trd, {r6('freq', 'freq')}, flag_d, {r6('avg(abs(max_run))', 'max_run_abs')} from per_run "
    "group by date_trd, freq, flag_d", _PER_RUN))
def agg_mean_run_size(spark, sf):
    return round_doubles(aggregates.mean_run_size(ticks(spark, sf), by_direction=True))


@query("agg_first_price_run", sql(
    f"select date_trd, s_run, id_run, {r6('arg_min(first_price, trd_id)', 'first_price')} "
    "from ticks group by 1, 2, 3"))
def agg_first_price_run(spark, sf):
    return round_doubles(run_prices(ticks(spark, sf)))


@query("agg_trades_per_date", sql("select date_trd, max(trd_id) as max_trd_id from ticks group by 1"))
def agg_trades_per_date(spark, sf):
    return aggregates.trades_per_date(ticks(spark, sf))


def _describe_sql(table, columns):
    parts = []
    for c in columns:
        stats = [("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
                 ("min", f"min({c})")]
        stats += [(f"{p * 100:g}%", f"quantile_cont({c}, {p!r}::double)") for p in C.PROFILE_PERCENTILES]
        stats += [("max", f"max({c})")]
        parts += [f"select '{c}' as \"column\", '{n}' as statistic, {r6(f'cast({e} as double)', 'value')} "
                  f"from {table}" for n, e in stats]
    return " union all ".join(parts)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg_describe", _describe_sql("lineitem", _LINE))
def agg_describe(spark, sf):
    return round_doubles(aggregates.describe(spark.read.parquet(f"{sf}/lineitem.parquet"), _LINE))


@query("agg_histogram", """
with e as (select min(o_totalprice) as a, max(o_totalprice) as b from orders),
h as (select least(cast(floor((o_totalprice - a) * 30 / (b - a)) as bigint), 29) as bin, count(*) as n
      from orders, e group by 1)
select r.range as bin, (round(a + r.range * ((b - a) / 30), 6) + 0.0) as low, coalesce(n, 0) as n
from range(30) r cross join e left join h on h.bin = r.range""")
def agg_histogram(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return round_doubles(aggregates.histogram(orders, "o_totalprice", 30))


def bins_sql(x, q, table, name="edges"):
    return (f"{name} as (select list_sort(list_distinct(quantile_cont({x}, "
            f"[{', '.join(repr(k / q) for k in range(q + 1))}]))) as e from {table} where {x} is not null)")


@query("agg_bin_target_profile", sql(
    "select cast(greatest(len(list_filter(e, lambda v: v < value)) - 1, 0) as bigint) as bin, "
    f"{r6('avg(hit)', 'mean_y')}, count(*) as n from ticks, edges group by 1",
    bins_sql("value", 10, "ticks")))
def agg_bin_target_profile(spark, sf):
    return round_doubles(aggregates.bin_target_profile(ticks(spark, sf), "value", "hit", 10))


@query("agg_class_balance", sql(
    f"select count(hit) as n, cast(sum(hit) as bigint) as positives, {r6('avg(hit)', 'positive_rate')}, "
    f"{r6('(count(hit) - sum(hit)) / sum(hit)', 'neg_pos_ratio')}, "
    f"{r6('count(hit) / sum(hit)', 'count_per_positive')} from ticks"))
def agg_class_balance(spark, sf):
    return round_doubles(aggregates.class_balance(ticks(spark, sf), "hit"))


@query("cls_weight", """
select toxic, count(*) as n,
       (round((select count(*) from labels) / (2.0::double * count(*)), 6) + 0.0) as weight
from labels group by toxic""")
def cls_weight(spark, sf):
    return round_doubles(aggregates.class_weights(spark.read.parquet(f"{sf}/labels.parquet"), "toxic"))


@query("distinct_runs", sql("select distinct date_trd, id_run, s_run from ticks"))
def distinct_runs(spark, sf):
    return ticks(spark, sf).select("date_trd", "id_run", "s_run").distinct()


@query("sort_multi", sql(
    "select date_trd, id_run, trd_id from ticks order by id_run, date_trd, trd_id"))
def sort_multi(spark, sf):
    return ticks(spark, sf).select("date_trd", "id_run", "trd_id").orderBy("id_run", "date_trd", "trd_id")


_FEATURE_VARS = "features as (" + " union all ".join(
    f"select 'f_{n}' as cols, abs(corr(f_{n}, hit)) as importance from raw"
    for n in ("smart_price", "rng_ewma", "vewma", "vewma_g_p", "msg_imb", "PA_up", "n_trd", "n_big",
              "vol_trd", "aggimb", "abagg", "chgfreq")) + ")"


@query("topk_importance", sql(
    f"select cols, {r6s('importance')} from features order by round(importance, 9) desc, cols limit 50",
    _FEATURE_VARS))
def topk_importance(spark, sf):
    names = ["f_" + n for n in ("smart_price", "rng_ewma", "vewma", "vewma_g_p", "msg_imb", "PA_up",
                                "n_trd", "n_big", "vol_trd", "aggimb", "abagg", "chgfreq")]
    wide = ticks(spark, sf, True).agg(*[F.abs(F.corr(c, "hit")).alias(c) for c in names])
    table = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cols"), F.col(c).alias("importance"))
                                            for c in names])).alias("_p")).select("_p.*")
    return round_doubles(table.orderBy(F.round("importance", 9).desc(), "cols").limit(50))


@query("union_append", sql(
    f"select date_trd, trd_id, s_run, {r6('case when s_run >= 0 then value end', 'value')}, "
    f"{r6('case when s_run < 0 then prob end', 'prob')} from ticks"))
def union_append(spark, sf):
    df = ticks(spark, sf)
    return round_doubles(append([
        df.where("s_run >= 0").select("date_trd", "trd_id", "s_run", "value"),
        df.where("s_run < 0").select("date_trd", "trd_id", "s_run", "prob")]))


def split_sql(table, share):
    return (f"split as (select *, row_number() over (order by date_trd, trd_id) - 1 as idx, "
            f"(select count(*) - ceil(count(*) * {share}::double) from {table}) as n_train from {table})")


@query("ordered_split", sql(
    "select date_trd, trd_id, case when idx < n_train then 'train' else 'test' end as part from split",
    split_sql("ticks", 0.2)))
def ordered_split(spark, sf):
    train, test = prep.ordered_split(ticks(spark, sf).select("date_trd", "trd_id"), 0.2)
    return (train.withColumn("part", F.lit("train"))
            .unionByName(test.withColumn("part", F.lit("test"))))


@query("cv_folds", sql(
    "select date_trd, trd_id, hit, cast(ntile(4) over (partition by hit order by date_trd, trd_id) - 1 "
    "as bigint) as fold from ticks"))
def cv_folds(spark, sf):
    out = contiguous_folds(ticks(spark, sf), "hit", 4)
    return out.select("date_trd", "trd_id", "hit", "fold")
