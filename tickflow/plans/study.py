"""Queries: metrics, threshold sweeps and the exit study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.functions.scalars import above, round_doubles
from tickflow.operators import backtest, metrics, prep
from tickflow.operators.models import contiguous_folds
from tickflow.plans.labelling import split_sql
from tickflow.plans.registry import query, r6, r6s, sql
from tickflow.plans.ticks import ticks
from tickflow.plans.windows import tagged

CELLS = """count(*) filter ({y} = 0 and yhat = 0) as tn, count(*) filter ({y} = 0 and yhat = 1) as fp,
       count(*) filter ({y} = 1 and yhat = 0) as fn, count(*) filter ({y} = 1 and yhat = 1) as tp"""


def f_sql(beta, tp="tp", fp="fp", fn="fn"):
    b = f"{beta * beta!r}::double"
    return (f"case when (1 + {b}) * {tp} + {b} * {fn} + {fp} = 0 then 0.0 "
            f"else (1 + {b}) * {tp} / ((1 + {b}) * {tp} + {b} * {fn} + {fp}) end")


AP = """case when tp + fp = 0 then (tp + fn) / (tp + fn + tn + fp)::double
  else tp / (tp + fn)::double * (tp / (tp + fp)::double)
       + (1 - tp / (tp + fn)::double) * ((tp + fn) / (tp + fn + tn + fp)::double) end"""
CONFUSION = ("cells as (select " + CELLS.format(y="hit")
             + " from (select hit, cast(prob > 0.5 as bigint) as yhat from ticks))")


def cells(spark, sf):
    return metrics.confusion(ticks(spark, sf).withColumn("yhat", above(F.col("prob"), 0.5)), "hit")


@query("metric_confusion", sql("select * from cells", CONFUSION))
def metric_confusion(spark, sf):
    return cells(spark, sf)


@query("metric_f1", sql(f"select {r6(f_sql(1.0), 'f1')} from cells", CONFUSION))
def metric_f1(spark, sf):
    return round_doubles(cells(spark, sf).select(metrics.fbeta(1.0).alias("f1")))


_BETAS = {"f04": 0.4, "f05": 0.5, "f03": 0.3}


@query("metric_fbeta", sql(
    "select " + ", ".join(r6(f_sql(b), n) for n, b in _BETAS.items()) + " from cells", CONFUSION))
def metric_fbeta(spark, sf):
    return round_doubles(cells(spark, sf).select(*[metrics.fbeta(b).alias(n) for n, b in _BETAS.items()]))


@query("metric_f1_weighted", sql(
    "select " + r6(f"(({f_sql(1.0)}) * (tp + fn) + ({f_sql(1.0, 'tn', 'fn', 'fp')}) * (tn + fp)) "
                   "/ (tp + fn + tn + fp)", "f1_weighted") + " from cells", CONFUSION))
def metric_f1_weighted(spark, sf):
    return round_doubles(cells(spark, sf).select(metrics.f1_weighted().alias("f1_weighted")))


@query("metric_ap_hard", sql(f"select {r6(AP, 'ap')} from cells", CONFUSION))
def metric_ap_hard(spark, sf):
    return round_doubles(cells(spark, sf).select(metrics.average_precision_hard().alias("ap")))


def auc_sql(table, y="hit", by=""):
    return f"""(
  select {by + ',' if by else ''}
         (sum(case when {y} = 1 then rnk end) - sum({y}) * (sum({y}) + 1) / 2.0::double)
         / (sum({y}) * (count(*) - sum({y}))::double) as auc
  from (select *, rank() over ({'partition by ' + by if by else ''} order by prob)
               + (count(*) over (partition by {by + ',' if by else ''} prob) - 1) / 2.0::double as rnk
        from {table})
  {'group by ' + by if by else ''})"""


@query("metric_auc", sql(f"select {r6s('auc')} from {auc_sql('ticks')}"))
def metric_auc(spark, sf):
    return round_doubles(metrics.auc(ticks(spark, sf), "hit"))


def sweep_sql(table, step, y="hit"):
    n = metrics.threshold_steps(step=step)
    return f"""sweep as (
  select th, {CELLS.format(y=y)} from (
    select th, {y}, cast(prob > th as bigint) as yhat from {table},
      (select 0.2::double + range * {step!r}::double as th from range({n}))) group by th)"""


@query("threshold_sweep", sql("select * from (" + " union all ".join(
    f"(select '{kind}' as kind, {r6(repr(beta) + '::double' if beta else 'null::double', 'beta')}, "
    f"{r6(repr(step) + '::double', 'step')}, {r6('th', 'th')}, tn, fp, fn, tp, "
    f"{r6(AP if kind == 'ap' else f_sql(beta), 'score')} from sweep{i} "
    f"order by round({AP if kind == 'ap' else f_sql(beta)}, 12) desc, th limit 1)"
    for i, (kind, beta, step) in enumerate(metrics.SWEEPS)) + ")",
    *[sweep_sql("ticks", step).replace("sweep as", f"sweep{i} as")
      for i, (_, _, step) in enumerate(metrics.SWEEPS)]))
def threshold_sweep(spark, sf):
    """Best threshold of every sweep in use."""
    scored = ticks(spark, sf).select("hit", "prob")
    out = None
    for kind, beta, step in metrics.SWEEPS:
        one = metrics.best_threshold(scored, "hit", "prob", kind, beta, step).select(
            F.lit(kind).alias("kind"), F.lit(beta).cast("double").alias("beta"),
            F.lit(step).alias("step"), "th", "tn", "fp", "fn", "tp", "score")
        out = one if out is None else out.unionByName(one)
    return round_doubles(out)


@query("threshold_curve", sql(
    f"select {r6('th', 'th')}, tn, fp, fn, tp, {r6(f_sql(0.4), 'fbeta')} from sweep",
    sweep_sql("ticks", 0.01)))
def threshold_curve(spark, sf):
    counts = metrics.threshold_counts(ticks(spark, sf), "hit")
    return round_doubles(counts.withColumn("fbeta", metrics.fbeta(0.4)))


@query("report_results", sql(
    "select " + ", ".join(r6(f"max(case when part = '{s}' then {m} end)", f"{s}_{m}")
                          for m in ("auc", "f1", "fbeta") for s in ("train", "test")) + ", "
    + ", ".join(f"max(case when part = '{s}' then {m} end) as {s}_{m}"
                for m in ("tn", "fp", "fn", "tp") for s in ("train", "test")) + ", "
    + ", ".join(r6(f"max(case when part = 'train' then {m} end) - max(case when part = 'test' then {m} end)",
                   f"overfit_{m}") for m in ("auc", "f1", "fbeta"))
    + ", " + r6("max(th)", "th") + " from scores",
    split_sql("ticks", 0.2),
    "parts as (select *, case when idx < n_train then 'train' else 'test' end as part from split)",
    "train as (select * from parts where part = 'train')",
    sweep_sql("train", 0.01),
    f"best as (select th from sweep order by round({f_sql(0.4)}, 12) desc, th limit 1)",
    "part_cells as (select part, " + CELLS.format(y="hit")
    + " from (select part, hit, cast(prob > (select th from best) as bigint) as yhat from parts) group by 1)",
    "areas as (select * from " + auc_sql("parts", by="part") + ")",
    f"scores as (select part, auc, {f_sql(1.0)} as f1, {f_sql(0.4)} as fbeta, tn, fp, fn, tp, "
    "(select th from best) as th from part_cells join areas using (part))"))
def report_results(spark, sf):
    train, test = prep.ordered_split(ticks(spark, sf), 0.2)
    return round_doubles(metrics.report(train, test, "hit"))


@query("baseline_const", sql(
    f"select {r6('prob', 'prob')}, {r6('0.5::double', 'auc')}, {r6(f_sql(1.0), 'f1')}, "
    f"{r6(f_sql(0.4), 'fbeta')} from const_cells",
    "const_cells as (select prob, " + CELLS.format(y="hit") + " from (select hit, prob, "
    "cast(prob > 0.5 as bigint) as yhat from (select hit, unnest([0.0::double, 0.99::double]) as prob "
    "from ticks)) group by prob)"))
def baseline_const(spark, sf):
    return round_doubles(metrics.constant_baselines(ticks(spark, sf), "hit"))


@query("baseline_random", sql(
    "select " + r6("th", "th") + ", " + ", ".join(r6(f"{f}({m})", f"{n}_{m}") for f, n in (("avg", "mean"), ("max", "max"))
                                                   for m in ("auc", "f1", "fbeta")) + " from measured group by th",
    "drawn as (select hit, trial, ('0x' || substr(md5(date_trd || '|' || trd_id || '|' || trial || '|0'), 1, 13))::bigint "
    "/ 4503599627370496.0::double as prob from ticks, generate_series(0, 19) as g(trial))",
    "placed as (select *, rank() over (partition by trial order by prob) as place from drawn)",
    "areas as (select trial, (sum(place) filter (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) "
    "/ (sum(hit)::double * sum(1 - hit)) as auc from placed group by trial)",
    "limits as (select 0.5::double as th union all select 1 - avg(hit) from ticks)",
    "cells as (select trial, th, " + CELLS.format(y="hit") + " from (select *, (prob > th)::bigint as yhat from drawn, limits) "
    "group by trial, th)",
    f"measured as (select th, auc, {f_sql(1.0)} as f1, {f_sql(0.4)} as fbeta from cells join areas using (trial))"))
def baseline_random(spark, sf):
    return round_doubles(metrics.random_baselines(ticks(spark, sf), "hit"))


@query("cv_estimate", sql(
    "select " + ", ".join([r6("avg(train_score)", "mean_train"), r6("avg(test_score)", "mean_test"),
                           r6("stddev_pop(test_score)", "std_test")]
                          + [r6(f"avg(test_score) - stddev_pop(test_score) / {s} "
                                f"- abs(avg(train_score) - avg(test_score)) / {o}", n)
                             for n, s, o in (("estimate", 4, 3), ("estimate_search", 3, 2))])
    + " from scores",
    "folds as (select hit, prob, ntile(4) over (partition by hit order by date_trd, trd_id) - 1 as fold "
    "from ticks)",
    *[f"test{k} as (select * from folds where fold = {k}), train{k} as (select * from folds where fold <> {k})"
      for k in range(4)],
    "scores as (" + " union all ".join(
        f"select (select auc from {auc_sql(f'train{k}')}) as train_score, "
        f"(select auc from {auc_sql(f'test{k}')}) as test_score" for k in range(4)) + ")"))
def cv_estimate(spark, sf):
    folds = contiguous_folds(ticks(spark, sf), "hit", 4).select("hit", "prob", "fold")
    # every row is a test row of its own fold and a training row of the others
    roles = folds.select("hit", "prob", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("trial"),
                         "fold").withColumn("test", F.col("trial") == F.col("fold"))
    areas = metrics.auc(roles, "hit", "prob", by=["trial", "test"])
    scores = areas.groupBy("trial").agg(
        F.max(F.when(~F.col("test"), F.col("auc"))).alias("train_score"),
        F.max(F.when(F.col("test"), F.col("auc"))).alias("test_score"))
    a = metrics.fold_estimate(scores)
    b = metrics.fold_estimate(scores, 3.0, 2.0).select(F.col("estimate").alias("estimate_search"))
    return round_doubles(_one_row(a, b))


def _one_row(a, b):
    """Two one-row frames side by side."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


# --- exit study ------------------------------------------------------------------------

_UP = "model in ('md_up', 'mi_up', 'mw_up')"
_DOWN = "model in ('md_down', 'mi_down', 'mw_down')"
_TH = "case model " + " ".join(f"when '{m}' then {t}::double" for m, t in C.REGIME_THRESHOLD.items()) + " end"
EXIT_SQL = f"""
signs as (select date_trd, id_run - 1 as id_run, arg_min(s_run, trd_id) as s_next
          from tagged group by date_trd, id_run),
nexts as (select t.*, coalesce(s.s_next, 0) as s_run_next
          from tagged t left join signs s using (date_trd, id_run)),
marked as (
  select *, case when {_UP} and (s_run > 0 or s_run_next = 0) then id_run + 1
                 when {_DOWN} and (s_run < 0 or s_run_next = 0) then id_run + 1
                 when {_UP} and s_run <= 0 then id_run + 2
                 when {_DOWN} and s_run >= 0 then id_run + 2 end as mark
  from nexts),
exits as (
  select *, coalesce(last_value(mark ignore nulls) over (
      order by date_trd, trd_id rows between unbounded preceding and current row), 0) as id_run_exit
  from marked),
prices as (select date_trd, s_run, id_run, arg_min(first_price, trd_id) as first_price
           from tagged group by 1, 2, 3),
priced as (
  select e.*, d.first_price as first_price_down, u.first_price as first_price_up,
         z.first_price as first_price_zero
  from exits e
  asof left join (select * from prices where s_run = -1) d
    on e.date_trd = d.date_trd and e.id_run_exit <= d.id_run
  asof left join (select * from prices where s_run = 1) u
    on e.date_trd = u.date_trd and e.id_run_exit <= u.id_run
  asof left join (select * from prices where s_run = 0) z
    on e.date_trd = z.date_trd and e.id_run_exit <= z.id_run),
closed as (
  select *, case when model is not null and s_run_next = 0 then first_price_zero
                 when {_UP} then first_price_down when {_DOWN} then first_price_up end as exit_price
  from priced),
entered as (
  select *, case when model in ('mi_up', 'mw_up') and prob >= {_TH} then 5
                 when model in ('mi_down', 'mw_down') and prob >= {_TH} then -5 end::bigint as position,
         case when model in ('mi_up', 'mw_up') then first_price + case side when '-' then 0.5 else 0 end
              when model in ('mi_down', 'mw_down') then first_price - case side when '+' then 0.5 else 0 end
         end as entry_price
  from closed),
won as (
  select *, coalesce(case when position > 0 then exit_price - entry_price
                          when position < 0 then entry_price - exit_price end, 0.0) as delta_p
  from entered),
grid as (
  select model, i, j, sum(greatest(least(delta_p, j / 2.0::double), -i / 2.0::double)) as pnl
  from won, (select range as i from range(4, 80)), (select range as j from range(4, 80))
  where model in ('mi_up', 'mw_up', 'mi_down', 'mw_down') and prob > {_TH}
  group by model, i, j)"""


@query("join_next_run", sql(
    "select date_trd, trd_id, id_run, s_run, s_run_next from nexts", EXIT_SQL, tagged=True))
def join_next_run(spark, sf):
    return backtest.next_sign(ticks(spark, sf)).select(
        "date_trd", "trd_id", "id_run", "s_run", "s_run_next")


@query("bt_next_sign", sql(
    "select date_trd, id_run, s_run_next, count(*) as n from nexts where model is not null group by 1, 2, 3",
    EXIT_SQL, tagged=True))
def bt_next_sign(spark, sf):
    return (backtest.next_sign(tagged(spark, sf)).where("model is not null")
            .groupBy("date_trd", "id_run", "s_run_next").agg(F.count(F.lit(1)).alias("n")))


@query("bt_exit_run", sql("select date_trd, trd_id, id_run_exit from exits", EXIT_SQL, tagged=True))
def bt_exit_run(spark, sf):
    return backtest.exit_run(backtest.next_sign(tagged(spark, sf))).select(
        "date_trd", "trd_id", "id_run_exit")


@query("join_asof_forward", sql(
    "select date_trd, trd_id, id_run_exit, "
    + r6s("first_price_down", "first_price_up", "first_price_zero") + " from priced", EXIT_SQL, tagged=True))
def join_asof_forward(spark, sf):
    out = backtest.asof_run_prices(backtest.exit_run(backtest.next_sign(tagged(spark, sf))))
    return round_doubles(out.select("date_trd", "trd_id", "id_run_exit", "first_price_down",
                                    "first_price_up", "first_price_zero"))


@query("bt_exit_price", sql(
    f"select date_trd, trd_id, model, {r6s('exit_price')} from closed", EXIT_SQL, tagged=True))
def bt_exit_price(spark, sf):
    out = backtest.exit_price(backtest.exit_run(backtest.next_sign(tagged(spark, sf))))
    return round_doubles(out.select("date_trd", "trd_id", "model", "exit_price"))


@query("bt_entry", sql(
    f"select date_trd, trd_id, position, {r6s('entry_price')} from entered", EXIT_SQL, tagged=True))
def bt_entry(spark, sf):
    return round_doubles(backtest.entries(tagged(spark, sf)).select(
        "date_trd", "trd_id", "position", "entry_price"))


@query("bt_delta", sql(
    f"select date_trd, trd_id, model, position, {r6s('delta_p')} from won", EXIT_SQL, tagged=True))
def bt_delta(spark, sf):
    return round_doubles(backtest.scored_trades(tagged(spark, sf)).select(
        "date_trd", "trd_id", "model", "position", "delta_p"))


def grid(spark, sf):
    trades = backtest.scored_trades(tagged(spark, sf)).select("model", "prob", "delta_p")
    return backtest.stop_gain_grid(trades)


@query("bt_grid", sql(f"select model, i, j, {r6s('pnl')} from grid", EXIT_SQL, tagged=True))
def bt_grid(spark, sf):
    return round_doubles(grid(spark, sf))


def _best_sql(score):
    return (f"select model, i, j, {r6s('pnl', 'score')} from (select *, {score} as score from grid) "
            "qualify row_number() over (partition by model order by round(score, 9) desc, i, j) = 1")


@query("bt_grid_best_pnl", sql(_best_sql("pnl"), EXIT_SQL, tagged=True))
def bt_grid_best_pnl(spark, sf):
    return round_doubles(backtest.best_cell(grid(spark, sf), "pnl"))


@query("bt_grid_best_ratio", sql(_best_sql("pnl / (-i * 0.5::double)"), EXIT_SQL, tagged=True))
def bt_grid_best_ratio(spark, sf):
    return round_doubles(backtest.best_cell(grid(spark, sf), "ratio_negative_stop"))


@query("bt_grid_best_ratio_abs", sql(_best_sql("pnl / (i * 0.5::double)"), EXIT_SQL, tagged=True))
def bt_grid_best_ratio_abs(spark, sf):
    return round_doubles(backtest.best_cell(grid(spark, sf), "ratio"))


@query("bt_grid_matrix", sql(
    "select model, i, " + ", ".join(r6(f"max(case when j = {j} then pnl end)", f"g{j}")
                                    for j in range(C.GRID_FROM, C.GRID_TO + 1))
    + " from grid group by model, i", EXIT_SQL, tagged=True))
def bt_grid_matrix(spark, sf):
    return round_doubles(backtest.grid_matrix(grid(spark, sf)))
