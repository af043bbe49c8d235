import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickflow.functions.scalars import above
from tickflow.operators import metrics, models, neighbours, selection
from tickflow.operators.models import Base
from tickflow.order import Order


def scored(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.4 + 0.15 * y, 0.2), 0, 1), 2)
    rows = [(f"d{i % 4}", i // 4, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "date_trd string, trd_id long, y long, prob double"), y, p


def auc_by_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_auc_counts_ties_half(spark):
    df, y, p = scored(spark)
    assert metrics.auc(df).first()["auc"] == pytest.approx(auc_by_pairs(y, p))
    flipped = metrics.auc(df.withColumn("prob", 1 - F.col("prob"))).first()["auc"]
    assert flipped + auc_by_pairs(y, p) == pytest.approx(1.0)
    assert metrics.auc(df.where("y = 1")).first()["auc"] is None


def test_sweep_equals_brute_force(spark):
    df, y, p = scored(spark)
    for step in (0.01, 0.025, 0.1):
        counts = metrics.threshold_counts(df, step=step).orderBy("th").collect()
        ths = 0.2 + np.arange(metrics.threshold_steps(step=step)) * step
        assert len(counts) == len(np.arange(0.2, 1, step)) == len(ths)
        for r, th in zip(counts, ths):
            assert r["th"] == th
            hat = p > th
            assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (
                int(((y == 0) & ~hat).sum()), int(((y == 0) & hat).sum()),
                int(((y == 1) & ~hat).sum()), int(((y == 1) & hat).sum()))


def test_best_threshold_is_the_lowest_of_ties(frame):
    df = frame("y long, prob double", [(1, 0.9), (1, 0.9), (0, 0.1)])
    best = metrics.best_threshold(df).first()
    assert best["th"] == 0.2 and best["score"] == 1.0


def test_scores_by_hand(frame):
    df = frame("y long, prob double", [(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1), (0, 0.1)])
    row = metrics.confusion(df.withColumn("yhat", above(F.col("prob"), 0.5))).select(
        "*", metrics.fbeta(1.0).alias("f1"), metrics.f1_weighted().alias("w"),
        metrics.average_precision_hard().alias("ap")).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 1, 1, 1)
    assert row["f1"] == pytest.approx(0.5)
    assert row["w"] == pytest.approx((0.5 * 2 + (2 / 3) * 3) / 5)
    assert row["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.4)
    none = metrics.confusion(df.withColumn("yhat", F.lit(0))).select(
        metrics.fbeta(0.4).alias("f"), metrics.average_precision_hard().alias("ap")).first()
    assert (none["f"], none["ap"]) == (0.0, pytest.approx(0.4))


def test_folds_are_contiguous_per_class(spark):
    df, y, _ = scored(spark, 103)
    order = Order(block_rows=4)
    rows = models.contiguous_folds(df, "y", 4, order).orderBy("date_trd", "trd_id").collect()
    for label in (0, 1):
        folds = [r["fold"] for r in rows if r["y"] == label]
        n = len(folds)
        sizes = [n // 4 + (i < n % 4) for i in range(4)]
        assert folds == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_fold_estimate(frame):
    df = frame("train_score double, test_score double", [(0.9, 0.6), (0.7, 0.8)])
    assert metrics.fold_estimate(df).first()["estimate"] == pytest.approx(0.7 - 0.1 / 4 - 0.1 / 3)


@pytest.mark.parametrize("metric", ["euclidean", "braycurtis"])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_equal_brute_force(spark, metric, weights):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.1, (60, 3)), np.ones((15, 3))])
    y = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, v array<double>, y long").repartition(4)
    got = {r["id"]: r["prob"] for r in neighbours.knn_score(
        df, df, 7, "id", "v", "y", weights, metric, block_rows=20).collect()}
    assert len(got) == len(x)
    for i in range(len(x)):
        if metric == "euclidean":
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        else:
            d = np.abs(x - x[i]).sum(axis=1) / np.abs(x + x[i]).sum(axis=1)
        near = np.lexsort((np.arange(len(x)), d))[:7]
        if weights == "uniform":
            want = y[near].mean()
        elif (d[near] == 0).any():
            want = y[near][d[near] == 0].mean()
        else:
            want = (y[near] / d[near]).sum() / (1 / d[near]).sum()
        assert got[i] == pytest.approx(want)


def planted(spark, n=600):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (n, 3))
    y = (x[:, 0] + 0.5 * rng.normal(0, 1, n) > 0).astype(int)
    return spark.createDataFrame(
        [("d", i, int(t), *[float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
        "date_trd string, trd_id long, y long, signal double, noise1 double, noise2 double").repartition(4).cache()


X = ["signal", "noise1", "noise2"]


@pytest.mark.parametrize("family,params", [
    ("logit", {"balanced": True, "regParam": 0.01}), ("rf", {"numTrees": 10}), ("gbt", {"maxIter": 5}),
    ("svm", {"balanced": True, "maxIter": 20}), ("linear_svm", {"maxIter": 20}), ("mlp", {"maxIter": 30})])
def test_classifiers_beat_the_random_floor(spark, family, params):
    df = planted(spark)
    train, test = df.where("trd_id < 400"), df.where("trd_id >= 400")
    fitted = models.fit_classifier(family, train, X, **params)
    assert models.area(fitted.score(test)) > 0.8


def test_stack_search_and_regimes(spark):
    df = planted(spark)
    train, test = df.where("trd_id < 400"), df.where("trd_id >= 400")
    stack = models.fit_stack(train, [Base("a", "logit", ("signal", "noise1"), {}),
                                     Base("b", "rf", tuple(X), {"numTrees": 5})])
    assert models.area(stack.score(test)) > 0.8
    found = models.search_random("logit", train, X, draws=5, k=2, fixed={"maxIter": 10})
    assert found.scores.count() == 5 and found.best_score > 0.5
    tagged = df.withColumn("model", F.when(F.col("trd_id") % 3 == 0, "mi_up").when(F.col("trd_id") % 3 == 1, "md_up"))
    out, thresholds = models.predict_by_regime(tagged.where("trd_id < 400"), tagged.where("trd_id >= 400"), X)
    assert out.count() == 200 and thresholds["md_up"] == 0.5 and thresholds["mi_up"] != 0.5
    assert out.where("model = 'mi_up' and prob is null").count() == 0
    assert out.where("model is null and prob is not null").count() == 0


def test_area_is_exact(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(0, 1, 10_000)
    y = (p + rng.normal(0, 3, 10_000) > 0).astype(int)
    order = p.argsort().argsort() + 1
    want = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y long, prob double")
    assert models.area(df) == pytest.approx(want, abs=1e-12)
    assert math.isnan(models.area(df.where("y = 1")))


@pytest.mark.parametrize("family", ["logit", "rf", "svm"])
def test_saved_models_score_alike(spark, tmp_path, family):
    df = planted(spark).withColumn("model", F.lit("mi_up"))
    params = {"numTrees": 3} if family == "rf" else {"maxIter": 5}
    fitted = models.fit_by_regime(df.where("trd_id < 400"), X, family=family, params=params, k=2)
    fitted.save(str(tmp_path / "m"))
    again = models.RegimeModels.load(spark.newSession(), str(tmp_path / "m"))
    rows = df.where("trd_id >= 400")
    assert again.thresholds == fitted.thresholds
    a, b = ({r["trd_id"]: r["prob"] for r in m.score(rows).collect()} for m in (fitted, again))
    assert a == b and len(a) == 200


def test_selection(spark):
    df = planted(spark)
    mi = {r["cols"]: r["importance"] for r in selection.mi_scores(df, X).collect()}
    assert mi["signal"] > 3 * max(mi["noise1"], mi["noise2"])
    floor = selection.mi_random(df, "y", repeats=2).agg(F.max("importance").alias("m")).first()["m"]
    assert mi["signal"] > floor
    fitted = models.fit_classifier("logit", df, X)
    drop = {r["cols"]: r["importance"] for r in selection.permutation_importance(df, X, fitted.score).collect()}
    assert drop["signal"] > 0.2 and abs(drop["noise1"]) < 0.05
    assert selection.recursive_elimination(X, lambda c: models.fit_classifier("logit", df, c).importances(), 1) == [
        "signal"]


def test_spearman_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random(300) < 0.4, 0.0, rng.normal(0, 1, 300))
    b = a + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame([("d", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "date_trd string, trd_id long, a double, b double")

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    want = np.corrcoef(ranks(a), ranks(b))[0, 1]
    for share in (selection.HOT_SHARE, 0.1):
        selection.HOT_SHARE, kept = share, selection.HOT_SHARE
        try:
            matrix = selection.corr_spearman(df, ["a", "b"], ["date_trd", "trd_id"])
        finally:
            selection.HOT_SHARE = kept
        assert matrix.where("a = 'a' and b = 'b'").first()["rho"] == pytest.approx(want)


def test_spearman_with_nulls_and_constants(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 3)).round(1)
    x[:, 1] += x[:, 0]
    x[rng.random(400) < 0.4, 2] = np.nan
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=2.0, e=np.where(rng.random(400) < 0.2, np.nan, x[:, 0] ** 2))
    rows = [("d", i, *[None if v != v else float(v) for v in r]) for i, r in enumerate(frame.to_numpy())]
    df = spark.createDataFrame(rows, "date_trd string, trd_id long, a double, b double, c double, flat double, e double")
    names = ["a", "b", "c", "flat", "e"]
    matrix = selection.corr_spearman(df, names, ["date_trd", "trd_id"])

    def want(p, q):
        both = frame[[p, q]].dropna() if p != q else frame[[p]].dropna()
        u, v = (both[n].rank() for n in (p, q))
        return None if u.std() == 0 or v.std() == 0 else np.corrcoef(u, v)[0, 1]
    for r in matrix.collect():
        right = want(r["a"], r["b"])
        assert (r["rho"] is None) == (right is None)
        assert right is None or r["rho"] == pytest.approx(right, abs=1e-9)
    assert "flat" not in selection.corr_clean(matrix, names)


def test_correlation_filters(frame):
    names = ["a", "b", "c"]
    rho = {("a", "b"): 0.9, ("b", "c"): 0.8}
    rows = [(x, y, 1.0 if x == y else rho.get((x, y), rho.get((y, x), 0.1))) for x in names for y in names]
    matrix = frame("a string, b string, rho double", rows)
    assert selection.corr_clean(matrix, names) == ["a", "b", "c"]
    assert selection.corr_clean(matrix, names, greedy=True) == ["b"]
    df = frame("a double, b double, c double", [(0.0, 0.0, 0.0), (1.0, 5.0, 2.0)])
    assert selection.smart_corr(df, matrix, names, 0.85) == {"b": ["a"]}


def test_rank_cuts_round_half_to_even(frame):
    rows = [(r, f"c{(i + s) % 5}", i + 1) for r, s in (("x", 0), ("y", 1)) for i in range(5)]
    table = frame("ranking string, cols string, position long", rows)
    # 0.5 of 5 is 2.5 and rounds to 2
    assert sorted(r["cols"] for r in selection.rank_union(table, 0.5).collect()) == ["c0", "c1", "c2"]
    assert sorted(r["cols"] for r in selection.rank_intersection(table, 0.5).collect()) == ["c1"]


def test_large_machines_are_fitted_one_after_the_other(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x], "a double, b double, y int")
    used = []

    def watched(run, arguments, parallelism=4):
        used.append(parallelism)
        return [run(a) for a in arguments]

    monkeypatch.setattr(models, "together", watched)
    small = models.fit_classifier("svm", df, ["a", "b"], maxIter=3)
    monkeypatch.setattr(models, "KEPT_BYTES", 0)
    large = models.fit_classifier("svm", df, ["a", "b"], maxIter=3)
    assert used == [4, 1]
    probs = [[r["prob"] for r in m.score(df).orderBy("a").collect()] for m in (small, large)]
    assert np.allclose(*probs)
