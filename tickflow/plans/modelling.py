"""Queries: feature selection, classifiers, stacking and search."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickflow.functions.quantiles import unpivot
from tickflow.functions.scalars import round_doubles
from tickflow.operators import backtest, boosting, joins, linear_fits, metrics, models, neighbours, prep, selection
from tickflow.operators.models import Base
from tickflow.plans.preparation import binned_sql, edges_sql
from tickflow.plans.registry import query, r6, r6s, sql
from tickflow.plans.ticks import RAW_FEATURES, ticks
from tickflow.plans.windows import tagged
from tickflow.runtime import state_of, written

FEATURES = ["f_" + c for c in RAW_FEATURES]
COLUMNS = [*FEATURES, "prob"]
X = [*RAW_FEATURES, "score"]
MI = [*FEATURES, "prob"]
_frames: dict = {}


def model_frame(spark, sf):
    """(train, test): normalised features and target, normalisation fitted on the training rows."""
    slot = (spark.sparkContext.applicationId, sf, state_of(spark, f"{sf}/events.parquet"))
    if slot not in _frames:
        raw = tagged(spark, sf, features=True).select(
            "date_trd", "trd_id", "model", F.col("hit").alias("y"),
            *[F.col(c).alias(x) for c, x in zip(COLUMNS, X)])
        train, _ = prep.ordered_split(raw)
        norm = prep.fit_base_norm(train, X)
        _frames[slot] = written(prep.apply_norm(raw, norm, zero_nulls=True), "model")
    return prep.ordered_split(_frames[slot])


# --- selection without models --------------------------------------------------------------

@query("mi_scores", sql(
    "select c as cols, " + r6("sum(n / total * ln((n / total) / ((nx / total) * (ny / total))))", "importance")
    + " from counted group by c",
    edges_sql({c: 10 for c in MI}, "raw"),
    "b as (select hit, " + ", ".join(f"{binned_sql(c)} as {c}" for c in MI) + " from raw, edges)",
    "cells as (" + " union all ".join(
        f"select '{c}' as c, {c} as x, hit, count(*)::double as n from b where {c} is not null group by 2, 3"
        for c in MI) + ")",
    "counted as (select *, sum(n) over (partition by c) as total, sum(n) over (partition by c, x) as nx, "
    "sum(n) over (partition by c, hit) as ny from cells)"))
def mi_scores(spark, sf):
    return round_doubles(selection.mi_scores(ticks(spark, sf, True), MI, "hit", 10))


def _near_sql(columns, k=3):
    cells = " union all ".join(f"select '{c}' as c, hit as y, {c} as x from raw where {c} is not null" for c in columns)
    sides = ", ".join(f"x - lag(x, {j}) over w, lead(x, {j}) over w - x" for j in range(1, k + 1))
    psi = selection.digamma_sql
    mean = "avg({})".format
    value = (f"{psi('count(*)::double')} + {mean(psi(f'least({k}, size - 1)::double'))} - {mean(psi('size::double'))} - {mean(psi('m::double'))}")
    return sql(f"select c as cols, {r6(f'greatest({value}, 0)', 'importance')} from counted group by c",
               f"cells as ({cells})",
               "sized as (select * from (select *, count(*) over (partition by c, y) as size from cells) where size > 1)",
               f"near as (select c, y, x, size, list_sort(list_filter([{sides}], lambda v: v is not null))[least({k}, size - 1)] "
               f"* {1 - 1e-9!r}::double as reach from sized window w as (partition by c, y order by x))",
               "counted as (select *, count(*) over (partition by c order by x range between reach preceding and reach following) as m from near)")


@query("mi_nearest", _near_sql(MI))
def mi_nearest(spark, sf):
    return round_doubles(selection.mi_nearest(ticks(spark, sf, True), MI, "hit"))


@query("mi_random")
def mi_random(spark, sf):
    return selection.mi_random(ticks(spark, sf), "hit")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TICK_CORR = ["value", "chg_cum", "max_run", "f_smart_price", "f_rng_ewma", "f_vewma", "f_vewma_g_p", "f_n_p",
             "f_book_imb", "flat"]


def rho_sql(columns, table):
    """Ranks are taken among the rows where both columns of a pair have a value."""
    def ranked(c):
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double"
    pairs = " union all ".join(
        f"select '{a}' as a, '{b}' as b, corr(x, y) as r from (select {ranked(a)} as x, {ranked(b)} as y "
        f"from {table} where {a} is not null and {b} is not null)" for a in columns for b in columns)
    return f"rho as (select a, b, case when isnan(r) then null else r end as rho from ({pairs}))"


CORR_RAW = "corr_raw as (select *, 1.0::double as flat from raw)"


def corr_frame(spark, sf):
    """Trades with a column that has NULLs and one without spread among those to correlate."""
    return ticks(spark, sf, True).withColumn("flat", F.lit(1.0))


@query("corr_spearman", sql(f"select a, b, {r6s('rho')} from rho", CORR_RAW, rho_sql(TICK_CORR, "corr_raw")))
def corr_spearman(spark, sf):
    return round_doubles(selection.corr_spearman(
        corr_frame(spark, sf), TICK_CORR, ["date_trd", "trd_id"]))


@query("corr_clean", sql(
    "select a as cols from rho where a <> b and abs(rho) >= 0.77 group by a", CORR_RAW, rho_sql(TICK_CORR, "corr_raw")))
def corr_clean(spark, sf):
    """Dropped columns, both members of each pair."""
    matrix = selection.corr_spearman(corr_frame(spark, sf), TICK_CORR, ["date_trd", "trd_id"])
    dropped = selection.corr_clean(matrix, TICK_CORR)
    return spark.createDataFrame([(c,) for c in dropped], "cols string")


@query("corr_clean_greedy", sql(
    "select b.name as cols from (" + " union all ".join(
        f"select {i} as i, '{c}' as name" for i, c in enumerate(TICK_CORR)) + ") b "
    "where list_contains((" + "select d" + str(len(TICK_CORR) - 1) + " from greedy), b.name)",
    CORR_RAW, rho_sql(TICK_CORR, "corr_raw"),
    # d_i: columns dropped among the first i + 1
    "greedy as (select * from " + " ".join(
        (f"(select []::varchar[] as d0) g0" if i == 0 else
         f"cross join lateral (select case when exists (select 1 from rho where a = '{c}' and b in ("
         + ", ".join(f"'{o}'" for o in TICK_CORR[:i]) + f") and not list_contains(d{i - 1}, b) and abs(rho) >= 0.77) "
         f"then list_append(d{i - 1}, '{c}') else d{i - 1} end as d{i}) g{i}")
        for i, c in enumerate(TICK_CORR)) + ")"))
def corr_clean_greedy(spark, sf):
    """Dropped columns, the earlier member of each pair stays."""
    matrix = selection.corr_spearman(corr_frame(spark, sf), TICK_CORR, ["date_trd", "trd_id"])
    dropped = selection.corr_clean(matrix, TICK_CORR, greedy=True)
    return spark.createDataFrame([(c,) for c in dropped], "cols string")


def _groups_sql():
    """Columns in order; each opens a group of the unseen ones it is correlated with."""
    steps = "(select []::varchar[] as s0) b0"
    for i, c in enumerate(TICK_CORR):
        steps += (f" cross join lateral (select case when list_contains(s{i}, '{c}') then [] else list_prepend("
                  f"'{c}', coalesce((select list(b) from rho where a = '{c}' and b <> '{c}' and abs(rho) > 0.8 "
                  f"and not list_contains(s{i}, b)), [])) end as g{i}) l{i}"
                  f" cross join lateral (select case when len(g{i}) > 1 then list_concat(s{i}, g{i}) else s{i} end "
                  f"as s{i + 1}) n{i}")
    return ("grouped as (select unnest([" + ", ".join(f"g{i}" for i in range(len(TICK_CORR)))
            + f"]) as g from {steps})")


@query("smart_corr", sql(
    "select best as kept, c as dropped from (select g, first(c order by round(s, 9) desc, i) as best from members group by g) "
    "join members using (g) where c <> best",
    CORR_RAW, rho_sql(TICK_CORR, "corr_raw"), _groups_sql(),
    "spreads as (" + " union all ".join(f"select '{c}' as c, {i} as i, stddev_samp({c}) as s from corr_raw"
                                    for i, c in enumerate(TICK_CORR)) + ")",
    "members as (select g, c, s, i from (select g, unnest(g) as c from grouped where len(g) > 1) join spreads using (c))"))
def smart_corr(spark, sf):
    df = corr_frame(spark, sf)
    matrix = selection.corr_spearman(df, TICK_CORR, ["date_trd", "trd_id"])
    groups = selection.smart_corr(df, matrix, TICK_CORR)
    return spark.createDataFrame([(k, d) for k, ds in groups.items() for d in ds], "kept string, dropped string")


def _feature_tree_sql(columns, bins=10):
    """AUC of a tree of two levels on each column alone."""
    cells = " union all ".join(f"select '{c}' as c, {binned_sql(c)} as b, hit from corr_raw, tree_edges where {c} is not null" for c in columns)
    gain = "round(power(p1, 2) / n1 + power(p - p1, 2) / (n - n1) - power(p, 2) / n, 9)"
    out = [edges_sql({c: bins for c in columns}, "corr_raw", "tree_edges"),
           f"counted0 as (select c, b, 0 as node, count(*)::double as n, sum(hit)::double as p from ({cells}) group by c, b)"]
    for d in range(2):
        out.append(f"""cut{d} as (
  select c, node, b, {gain} as gain from (
    select c, node, b, sum(n) over w as n1, sum(p) over w as p1, sum(n) over (partition by c, node) as n, sum(p) over (partition by c, node) as p
    from counted{d} window w as (partition by c, node order by b))
  where n1 < n qualify row_number() over (partition by c, node order by gain desc, b) = 1)""")
        out.append(f"counted{d + 1} as (select t.c, t.b, 2 * t.node + case when gain > 0 and t.b > cut{d}.b then 1 else 0 end as node, n, p "
                   f"from counted{d} t left join cut{d} using (c, node))")
    out.append("tree_leaves as (select c, node, sum(n) as n, sum(p) as p from counted2 group by c, node)")
    out.append("""tree_scores as (
  select a.c, coalesce(sum(a.p * (b.n - b.p) * case when a.p / a.n > b.p / b.n then 1 when a.p / a.n = b.p / b.n then 0.5 else 0 end)
         / nullif(sum(a.p * (b.n - b.p)), 0), 0.5) as s
  from tree_leaves a join tree_leaves b on a.c = b.c group by a.c)""")
    return out


@query("smart_corr_model", sql(
    "select best as kept, c as dropped from (select g, first(c order by round(s, 9) desc, i) as best from members group by g) "
    "join members using (g) where c <> best",
    CORR_RAW, rho_sql(TICK_CORR, "corr_raw"), _groups_sql(), *_feature_tree_sql(TICK_CORR),
    "places as (" + " union all ".join(f"select '{c}' as c, {i} as i" for i, c in enumerate(TICK_CORR)) + ")",
    "members as (select g, c, s, i from (select g, unnest(g) as c from grouped where len(g) > 1) join places using (c) join tree_scores using (c))"))
def smart_corr_model(spark, sf):
    """Of each group of correlated columns the one stays whose own tree tells the target best."""
    df = corr_frame(spark, sf)
    matrix = selection.corr_spearman(df, TICK_CORR, ["date_trd", "trd_id"])
    scores = {c: round(v, 9) for c, v in selection.one_feature_scores(df, TICK_CORR, "hit").items()}
    groups = selection.smart_corr(df, matrix, TICK_CORR, score=scores.get)
    return spark.createDataFrame([(k, d) for k, ds in groups.items() for d in ds], "kept string, dropped string")


_RANKED = [*MI, "chg_cum", "max_run", "freq"]
_CRITERIA = {"target": "abs(corr({c}, hit))", "value": "abs(corr({c}, value))", "spread": "stddev_samp({c})"}
RANKING_SQL = ("scored as (" + " union all ".join(
    f"select '{r}' as ranking, '{c}' as cols, round({e.format(c=c)}, 9) as importance from raw"
    for r, e in _CRITERIA.items() for c in _RANKED) + "),\n"
    "ranked_cols as (select *, row_number() over (partition by ranking order by importance desc, cols) as position, "
    "count(*) over (partition by ranking) as total from scored)")


def rankings(spark, sf):
    """Three rankings of the features; one row per (ranking, feature).

    Features become rows first: a few sums per feature stay one small compiled loop, where hundreds of them side by side
    are not. The table is written, as cuts and sides read it several times.
    """
    sums = unpivot(ticks(spark, sf, True), _RANKED, keep=["hit", "value"]).groupBy("c").agg(
        *[F.expr(e.format(c="x")).alias(r) for r, e in _CRITERIA.items()])
    names = spark.createDataFrame([(c,) for c in _RANKED], "c string")
    table = names.join(F.broadcast(sums), "c", "left").select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("ranking"), F.col("c").alias("cols"), F.round(r, 9).alias("importance"))
        for r in _CRITERIA])).alias("_p")).select("_p.*")
    w = W.partitionBy("ranking").orderBy(F.desc("importance"), "cols")
    return written(table.withColumn("position", F.row_number().over(w).cast("long")), "rankings")


@query("rank_union", sql(
    "select distinct cols from ranked_cols where position <= round_even(0.2::double * total, 0)", RANKING_SQL))
def rank_union(spark, sf):
    return selection.rank_union(rankings(spark, sf), 0.2)


@query("rank_inter", sql(
    "select cols from ranked_cols where position <= round_even(0.5::double * total, 0) "
    "group by cols having count(*) = 3", RANKING_SQL))
def rank_inter(spark, sf):
    return selection.rank_intersection(rankings(spark, sf), 0.5)


@query("rank_side_by_side", sql(
    "select position, " + ", ".join(
        f"max(case when ranking = '{r}' then cols end) as {r}, "
        + r6(f"max(case when ranking = '{r}' then importance end)", f"{r}_importance") for r in _CRITERIA)
    + " from ranked_cols group by position", RANKING_SQL))
def rank_side_by_side(spark, sf):
    table = rankings(spark, sf)
    sides = [table.where(F.col("ranking") == r).select(
        "position", F.col("cols").alias(r), F.col("importance").alias(f"{r}_importance")) for r in _CRITERIA]
    return round_doubles(joins.side_by_side(sides))


# --- model-based selection -----------------------------------------------------------------

_SMALL_RF = {"numTrees": 20, "maxDepth": 5, "subsamplingRate": 0.7, "balanced": True}


@query("imp_rf")
def imp_rf(spark, sf):
    train, _ = model_frame(spark, sf)
    return models.importance_table(spark, models.fit_classifier("rf", train, X, **_SMALL_RF))


@query("imp_gbt")
def imp_gbt(spark, sf):
    train, _ = model_frame(spark, sf)
    return models.importance_table(spark, models.fit_classifier(
        "gbt", train, X, trees=10, depth=4, rate=0.1, row_share=0.5, column_share=0.7, gamma=0.5))


@query("imp_linear")
def imp_linear(spark, sf):
    train, _ = model_frame(spark, sf)
    return models.importance_table(spark, models.fit_classifier(
        "logit", train, X, balanced=True, regParam=0.01, elasticNetParam=1.0), absolute=True)


@query("imp_permutation")
def imp_permutation(spark, sf):
    train, _ = model_frame(spark, sf)
    fitted = models.fit_classifier("svm", train, X, balanced=True, maxIter=20, gamma=0.05)
    return selection.permutation_importance(train, X, fitted)


_SINGLE = ["f_smart_price", "f_rng_ewma", "f_vewma", "f_msg_imb", "f_chgfreq", "f_n_trd", "f_n_big", "f_n_p", "prob"]


def _newton_sql(columns, steps=12):
    """Logistic regression with an L2 penalty of 1 on each column alone, by Newton steps."""
    rows = " union all ".join(f"select '{c}' as c, {c} as x, hit::double as y from raw" for c in columns)
    out = [f"points as materialized ({rows})", "step0 as (select distinct c, 0.0::double as b, 0.0::double as a from points)"]
    for i in range(steps):
        out.append(f"""step{i + 1} as materialized (
  select c, b - (s1 * gx - sx * g1) / (s1 * sxx - sx * sx) as b, a - (sxx * g1 - sx * gx) / (s1 * sxx - sx * sx) as a from (
    select c, any_value(b) as b, any_value(a) as a, sum(w * x * x) + 1 as sxx, sum(w * x) as sx, sum(w) as s1,
           sum(r * x) + any_value(b) as gx, sum(r) as g1
    from (select c, x, a, b, p - y as r, p * (1 - p) as w
          from (select points.*, a, b, 1 / (1 + exp(-(a + b * x))) as p from points join step{i} using (c)))
    group by c))""")
    return sql(f"select c as cols, {r6('b', 'coefficient')}, {r6('a', 'intercept')} from step{steps}", *out)


@query("linear_single", _newton_sql(_SINGLE))
def linear_single(spark, sf):
    """One logistic regression for each column, all fitted in the same passes."""
    blocks = linear_fits.Blocks(ticks(spark, sf, True), _SINGLE, "hit")
    fits = linear_fits.fit_all(blocks, [linear_fits.Fit((i,), l2=1.0) for i in range(len(_SINGLE))], tolerance=1e-10)
    rows = [(c, float(s.beta[i]), float(s.beta[-1])) for i, (c, s) in enumerate(zip(_SINGLE, fits))]
    return round_doubles(spark.createDataFrame(rows, "cols string, coefficient double, intercept double"))


FOLDS = 5


def _blocks(spark, sf, k=FOLDS, columns=X):
    train, _ = model_frame(spark, sf)
    return linear_fits.Blocks(models.contiguous_folds(train, "y", k), columns, "y", "fold")


@query("sel_rfa")
def sel_rfa(spark, sf):
    """Recursive addition over all features, in the order of their coefficients in a fit with all of them."""
    blocks = _blocks(spark, sf, 3)
    whole = linear_fits.fit_all(blocks, [linear_fits.Fit(tuple(range(len(X))), l2=1.0)], tolerance=1e-6)[0]
    ordered = sorted(X, key=lambda c: (-abs(whole.beta[X.index(c)]), X.index(c)))
    log = linear_fits.addition(blocks, ordered, 3)
    return spark.createDataFrame(log, "cols string, gain double, kept boolean")


@query("sel_rfe")
def sel_rfe(spark, sf):
    """Recursive elimination over all features to five, and its area on each held fold."""
    kept, areas = linear_fits.elimination(_blocks(spark, sf), FOLDS, keep=5)
    return spark.createDataFrame([(c, sum(areas) / len(areas)) for c in kept], "cols string, cv_auc double")


@query("sel_sequential")
def sel_sequential(spark, sf):
    """Backward selection from all features to fourteen, five folds."""
    log = linear_fits.backward(_blocks(spark, sf), FOLDS, keep=14, balanced=True)
    return spark.createDataFrame(log, "dropped string, cv_auc double")


@query("sel_family")
def sel_family(spark, sf):
    """Mutual information first, then the importances of all families."""
    train, _ = model_frame(spark, sf)
    out = selection.mi_scores(train, X).select(F.lit("mi").alias("ranking"), "cols", "importance")
    small = {"rf": {"numTrees": 20}, "rf2": {"numTrees": 20}, "gbt": {"trees": 3, "depth": 4}, "gbt2": {"trees": 3, "depth": 4}}
    for family in selection.FAMILIES:
        out = out.unionByName(selection.family_importances(train, X, family, fixed=small))
    return out


# --- classifiers ---------------------------------------------------------------------------

def _model(name, family, **params):
    @query(name)
    def run(spark, sf):
        train, test = model_frame(spark, sf)
        return models.fit_classifier(family, train, X, **params).score(test).select(
            "date_trd", "trd_id", "y", "prob")
    return run


_model("mdl_rf", "rf", **_SMALL_RF)
_model("mdl_gbt", "gbt", trees=10, depth=5, rate=0.1, row_share=0.7, column_share=0.99999, min_child_weight=25, gamma=3,
       alpha=2, positive_weight=2.5)
_model("mdl_svm", "svm", balanced=True, C=24.8497, gamma=0.0030157, maxIter=30)
_model("mdl_linear_svm", "linear_svm", C=0.1)
_model("mdl_logit", "logit", balanced=True, regParam=0.01, elasticNetParam=1.0)
_model("mdl_mlp", "mlp", hidden=(8, 4), maxIter=20)


KNN_SQL = """
with pairs as (
  select q.vec_id as vec_id, t.vec_id as t, t.label % 2 as y,
         list_distance(q.embedding::double[], t.embedding::double[]) as d
  from embeddings q, embeddings t),
near as (select *, row_number() over (partition by vec_id order by d, t) as rn from pairs)
select vec_id, (round(avg(y), 6) + 0.0) as prob from near where rn <= 57 group by vec_id"""


def _vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "embedding", F.expr("label % 2").alias("y"))


@query("mdl_knn", KNN_SQL)
def mdl_knn(spark, sf):
    """Share of odd labels among the 57 nearest vectors of every vector."""
    df = _vectors(spark, sf)
    return round_doubles(neighbours.knn_score(df, df, 57, "vec_id", "embedding", "y"))


@query("mdl_knn_distance", KNN_SQL.replace("avg(y)", "case when bool_or(d = 0) then sum(y) filter (d = 0) "
       "/ count(*) filter (d = 0) else sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) end").replace("57", "16"))
def mdl_knn_distance(spark, sf):
    df = _vectors(spark, sf)
    return round_doubles(neighbours.knn_score(df, df, 16, "vec_id", "embedding", "y", "distance"))


@query("mdl_knn_braycurtis", """
with pairs as (
  select q.vec_id as vec_id, t.vec_id as t, t.label % 2 as y,
         list_sum([abs(e.a - e.b) for e in e2]) / list_sum([abs(e.a + e.b) for e in e2]) as d
  from embeddings q, embeddings t,
       lateral (select list_transform(list_zip(q.embedding, t.embedding),
                       lambda z: {'a': z[1]::double, 'b': z[2]::double}) as e2)),
near as (select *, row_number() over (partition by vec_id order by d, t) as rn from pairs)
select vec_id, (round(avg(y), 6) + 0.0) as prob from near where rn <= 10 group by vec_id""")
def mdl_knn_braycurtis(spark, sf):
    df = _vectors(spark, sf)
    return round_doubles(neighbours.knn_score(
        df, df, 10, "vec_id", "embedding", "y", metric="braycurtis"))


@query("pca")
def pca(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", array_to_vector("embedding").alias("v"))
    out = models.principal_components(df, "v", 6).select("vec_id", vector_to_array("components").alias("c"))
    return out.select("vec_id", *[F.col("c")[i].alias(f"pc{i + 1}") for i in range(6)])


_BASES = [Base("svm1", "svm", ("chgfreq", "smart_price", "rng_ewma", "movesc_ask_2p5_0p9", "msg_imb", "loc_agg_imb_m"),
               {"balanced": True, "maxIter": 10, "C": 24.84969151880429, "gamma": 0.0030157367155080337, "components": 32}),
          Base("gbt1", "gbt", ("smart_price", "chgfreq", "agg_net_d", "book_imb"),
               {"trees": 3, "depth": 3, "row_share": 0.7, "column_share": 0.99999, "min_child_weight": 25, "rate": 0.1, "gamma": 3,
                "alpha": 2, "positive_weight": 2.5}),
          Base("knn57", "knn", ("chgfreq", "smart_price", "rng_ewma"), {"n_neighbors": 57}),
          Base("knn75", "knn", ("book_imb", "imp_c_0p8", "imp_v_0p8", "loc_agg_net_m_aux", "n_trd_aux", "msg_imb", "score"),
               {"n_neighbors": 75}),
          Base("logit1", "logit", ("agg_net_m", "n_p", "chgfreq", "vewma", "aggimb_big_aux", "smart_price", "agg_net_d", "int_c_0p8",
                                   "msg_imb", "score"), {"regParam": 0.001})]


@query("stacking")
def stacking(spark, sf):
    train, test = model_frame(spark, sf)
    return models.fit_stack(train, _BASES, meta_params={"C": 0.018202370448969933}).score(test).select(
        "date_trd", "trd_id", "y", *[b.name for b in _BASES], "prob")


@query("search_random")
def search_random(spark, sf):
    """Ten draws and five folds over all features, fitted in shared passes."""
    train, _ = model_frame(spark, sf)
    return models.search_random("logit", train, X).scores


@query("search_neighbours")
def search_neighbours(spark, sf):
    """Ten draws and five folds of neighbour votes over all features, from one neighbour table for each metric."""
    train, _ = model_frame(spark, sf)
    return models.search_random("knn", train, X).scores


@query("model_compare")
def model_compare(spark, sf):
    train, test = model_frame(spark, sf)
    small = {"rf": {"numTrees": 5, "maxDepth": 4}, "gbt": {"trees": 3, "depth": 3}, "logit": {}, "svm": {"maxIter": 5, "components": 16}}
    return models.model_compare(train, test, X, list(small), draws=2, k=2, fixed=small)


_OOF_SQL = """
folded as (select *, case when hit = 1 then {one} else {zero} end as fold from numbered),
pairs as (
  select q.date_trd, q.trd_id, t.hit, sqrt({d}) as d, t.date_trd as td, t.trd_id as tt
  from folded q join folded t on q.fold <> t.fold),
near as (select *, row_number() over (partition by date_trd, trd_id order by d, td, tt) as rn from pairs)"""


def _oof_sql():
    """Votes of the 57 nearest rows of other folds on three features in whole units."""
    def fold(label):
        n = f"(select count(*) from raw where hit = {label})"
        return f"case when nth < {n} // 3 + least(1, {n} % 3) then 0 when nth < 2 * ({n} // 3) + least(2, {n} % 3) then 1 else 2 end"
    d = " + ".join(f"power(q.{c} - t.{c}, 2)" for c in ("value", "chg_cum", "freq"))
    return ("numbered as (select date_trd, trd_id, hit, value, chg_cum, freq, "
            "row_number() over (partition by hit order by date_trd, trd_id) - 1 as nth from raw)," + _OOF_SQL.format(
                one=fold(1), zero=fold(0), d=d))


@query("knn_out_of_fold", sql(
    "select date_trd, trd_id, " + r6("avg(hit)", "knn57") + ", " + r6("avg(hit) filter (rn <= 11)", "knn11")
    + " from near where rn <= 57 group by date_trd, trd_id", _oof_sql()))
def knn_out_of_fold(spark, sf):
    """Two neighbour bases of a stack, out of fold, from one neighbour table."""
    rows = ticks(spark, sf, True).select("date_trd", "trd_id", F.col("hit").alias("y"), "value", "chg_cum", "freq")
    folds = written(models.contiguous_folds(rows, "y", 3), "folds").withColumn("_v", F.array("value", "chg_cum", "freq"))
    table = neighbours.neighbour_table(folds, folds, 57, ["date_trd", "trd_id"], "_v", "y", fold="fold")
    return round_doubles(table.select("date_trd", "trd_id", neighbours.share(57).alias("knn57"), neighbours.share(11).alias("knn11")))


# --- one boosted tree, grown again in SQL ------------------------------------------------------

_TREE = MI[:40]


def _tree_sql(depth=2, alpha=0.5, penalty=1.0, bins=10):
    """Binned rows, and level by level: sums of each node, feature and bin, the best split of each node, its children."""
    rows = " union all ".join(f"select date_trd, trd_id, hit, {i} as c, {binned_sql(c)} as b from raw, edges" for i, c in enumerate(_TREE))
    q = f"(power(greatest(abs({{g}}) - {alpha}, 0), 2) / ({{h}} + {penalty}))"
    out = [edges_sql({c: bins for c in _TREE}, "raw"), f"cells as ({rows})",
           "at0 as (select date_trd, trd_id, hit, 0 as node from raw)"]
    for d in range(depth):
        out.append(f"node{d} as (select node, sum(0.5 - hit)::double as g, count(*) / 4.0::double as h from at{d} group by node)")
        out.append(f"bin{d} as (select node, c, b, sum(0.5 - hit)::double as g, count(*) / 4.0::double as h "
                   f"from at{d} join cells using (date_trd, trd_id, hit) group by node, c, b)")
        out.append(f"""side{d} as (
  select node, c, k, m, sum(g) filter (b <= k or (b is null and m = 1)) as gl, sum(h) filter (b <= k or (b is null and m = 1)) as hl
  from bin{d}, (select unnest(range({bins})) as k), (select unnest([0, 1]) as m) group by node, c, k, m)""")
        gain = (q.format(g="gl", h="hl") + " + " + q.format(g="(n.g - gl)", h="(n.h - hl)") + " - " + q.format(g="n.g", h="n.h"))
        out.append(f"""best{d} as (
  select node, c, k, m, gl, hl, n.g, n.h, {gain} as gain from side{d} join node{d} n using (node)
  where hl >= 1 and n.h - hl >= 1
  qualify row_number() over (partition by node order by round(gain, 9) desc, c, k, m) = 1)""")
        out.append(f"split{d} as (select *, row_number() over (order by node) as nth from best{d} where gain > 1e-6)")
        first = "(select 1)" if d == 0 else f"(select 1 + 2 * ({' + '.join(f'(select count(*) from split{e})' for e in range(d))}))"
        out.append(f"""at{d + 1} as (
  select a.date_trd, a.trd_id, a.hit, {first} + 2 * (nth - 1) + case when cells.b <= k or (cells.b is null and m = 1) then 0 else 1 end as node
  from at{d} a join split{d} s on a.node = s.node join cells on cells.c = s.c and cells.date_trd = a.date_trd and cells.trd_id = a.trd_id)""")
    names = "[" + ", ".join(f"'{c}'" for c in _TREE) + "]"
    inner = " union all ".join(f"select node, {names}[c + 1] as cols, m = 1 as missing_left, gain, g, h from split{d}" for d in range(depth))
    ends = " union all ".join(
        f"select node, g, h from (select node, sum(0.5 - hit)::double as g, count(*) / 4.0::double as h from at{d} group by node)"
        + (f" where node not in (select node from split{d})" if d < depth else "") for d in range(depth + 1))
    out.append(f"inner_nodes as ({inner})")
    out.append(f"leaves as ({ends})")
    value = f"-0.3::double * sign(g) * greatest(abs(g) - {alpha}, 0) / (h + {penalty})"
    body = ("select node::bigint as node, cols, missing_left, " + r6("gain", "gain") + ", " + r6("g", "gradient") + ", "
            + r6("h", "curvature") + ", " + r6("0", "value") + " from inner_nodes union all select node::bigint, null, null, null, "
            + r6("g") + ", " + r6("h") + ", " + r6(value) + " from leaves")
    return sql(body, *out)


@query("gbt_tree", _tree_sql())
def gbt_tree(spark, sf):
    """Nodes and leaf values of the first tree, two levels deep, on ten bins of forty features with missing values."""
    fitted = boosting.fit_boosted(ticks(spark, sf, True), _TREE, "hit", boosting.Boosting(trees=1, depth=2, alpha=0.5, bins=10))
    rows = [(n[1], n[2], n[4], n[7], n[8], n[9], n[10]) for n in fitted.nodes()]
    return round_doubles(spark.createDataFrame(
        rows, "node long, cols string, missing_left boolean, gain double, gradient double, curvature double, value double"))


@query("metric_auc_weighted", sql(
    "select " + r6("sum(up * (below + down / 2)) / (sum(up) * sum(down))", "auc") + """ from (
  select up, down, coalesce(sum(down) over (order by prob rows between unbounded preceding and 1 preceding), 0) as below
  from (select prob, sum(w * hit) as up, sum(w * (1 - hit)) as down from (
    select prob, hit, hit * ((n - p) / p - 1) + 1 as w from raw, (select count(*)::double as n, sum(hit)::double as p from raw))
    group by prob))"""))
def metric_auc_weighted(spark, sf):
    """AUC with the weights of the permutation importances: a positive row counts as many negative ones as there are to it."""
    df = ticks(spark, sf)
    return round_doubles(metrics.auc(selection.with_positive_weight(df, "hit", "w"), "hit", "prob", weight="w"))


@query("predict_by_regime")
def predict_by_regime(spark, sf):
    train, test = model_frame(spark, sf)
    scored, thresholds = models.predict_by_regime(train, test, X, params={"regParam": 0.001})
    limit = F.lit(None).cast("double")
    for regime, value in thresholds.items():
        limit = F.when(F.col("model") == regime, value).otherwise(limit)
    return scored.select("date_trd", "trd_id", "model", "prob", limit.alias("th"))


@query("exit_study_scored")
def exit_study_scored(spark, sf):
    """Features, one model per regime, scores of later trades, exits, and the stop and gain grid."""
    train, test = model_frame(spark, sf)
    scored, thresholds = models.predict_by_regime(train, test, X, params={"regParam": 0.001})
    # the frame with features carries its own stand-in score
    trades = tagged(spark, sf).drop("prob").join(scored.select("date_trd", "trd_id", "prob"), ["date_trd", "trd_id"], "left")
    study = written(backtest.scored_trades(written(trades, "scored-trades"), thresholds=thresholds), "study")
    return backtest.stop_gain_grid(study, thresholds=thresholds)
