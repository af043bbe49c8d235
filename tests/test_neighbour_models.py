import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickflow.operators import models, neighbours
from tickflow.operators.models import Base


def points(n=2600, d=3, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-40, 40, (30, d))
    x = centres[rng.integers(0, 30, n)] + rng.normal(0, 1, (n, d))
    x[:40] = x[40:80]                                  # repeated vectors
    y = (np.sin(x[:, 0] / 5) + rng.normal(0, 0.5, n) > 0).astype(int)
    return x, y


def frame(spark, x, y, fold=None):
    fold = np.zeros(len(y), int) if fold is None else fold
    rows = [("d%d" % (i % 3), i, [float(v) for v in r], int(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "date_trd string, trd_id long, v array<double>, y int, fold int").repartition(5)


def brute(x, q, k, metric, apart=None):
    out = []
    for i, v in enumerate(q):
        if metric == "euclidean":
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
        else:
            bottom = np.abs(x + v).sum(axis=1)
            d = np.divide(np.abs(x - v).sum(axis=1), bottom, out=np.zeros(len(x)), where=bottom > 0)
        if apart is not None:
            d = np.where(apart[0][i] == apart[1], np.inf, d)
        near = np.lexsort((np.arange(len(x)), d))[:k]
        out.append([(d[j], j) for j in near if d[j] < np.inf])
    return out


@pytest.mark.parametrize("metric", ["euclidean", "braycurtis"])
def test_pruned_search_is_exact_and_visits_few_blocks(spark, metric):
    x, y = points()
    if metric == "braycurtis":
        x = np.abs(x) ** 2 / 10
    df, visits = frame(spark, x, y), []
    asked = df.where("trd_id % 7 = 0")
    got = {r["trd_id"]: r["neighbours"] for r in neighbours.neighbour_table(
        df, asked, 9, ["trd_id"], "v", "y", metric, block_rows=64, pivots=60, visits=visits).collect()}
    want = brute(x, x[::7], 9, metric)
    assert len(got) == len(want)
    for i, near in zip(range(0, len(x), 7), want):
        assert [n["trd_id"] for n in got[i]] == [j for _, j in near]
        assert np.allclose([n["d"] for n in got[i]], [d for d, _ in near]) and [n["y"] for n in got[i]] == [y[j] for _, j in near]
    most = visits[0][1]
    assert most > 50 * 50
    assert sum(n for n, _ in visits) < 0.25 * most if metric == "euclidean" else sum(n for n, _ in visits) < 0.8 * most


def test_folds_are_kept_apart_and_every_k_reads_one_table(spark):
    x, y = points(400)
    fold = np.arange(400) % 4
    df = frame(spark, x, y, fold)
    table = neighbours.neighbour_table(df, df, 12, ["date_trd", "trd_id"], "v", "y", fold="fold", block_rows=50)
    shares = [neighbours.share(k, w).alias(f"{w}{k}") for k in (1, 5, 12) for w in ("uniform", "distance")]
    got = {r["trd_id"]: r for r in table.select("trd_id", *shares).collect()}
    # ties go by day and number
    order = sorted(range(400), key=lambda i: (f"d{i % 3}", i))
    near = brute(x[order], x, 12, "euclidean", (fold, fold[order]))
    for i in range(400):
        for k in (1, 5, 12):
            d = np.array([a for a, _ in near[i][:k]])
            t = np.array([y[order[j]] for _, j in near[i][:k]])
            assert got[i][f"uniform{k}"] == pytest.approx(t.mean())
            want = t[d == 0].mean() if (d == 0).any() else (t / d).sum() / (1 / d).sum()
            assert got[i][f"distance{k}"] == pytest.approx(want)


def test_fewer_rows_than_neighbours_and_none(spark):
    x, y = points(90)
    df = frame(spark, x, y)
    few = neighbours.neighbour_table(df.where("trd_id < 3"), df.where("trd_id < 2"), 5, ["trd_id"], "v", "y").collect()
    assert [len(r["neighbours"]) for r in few] == [3, 3]
    none = neighbours.knn_score(df.limit(0), df.where("trd_id < 2"), 5, "trd_id", "v", "y").collect()
    assert [r["prob"] for r in none] == [None, None]
    assert neighbours.knn_score(df, df.limit(0), 5, "trd_id", "v", "y").collect() == []
    same = df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    got = neighbours.neighbour_table(same, same.where("trd_id = 50"), 4, ["trd_id"], "v", "y", pivots=9).first()["neighbours"]
    assert [n["trd_id"] for n in got] == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (500, 3))
    y = (x[:, 0] + 0.5 * rng.normal(0, 1, 500) > 0).astype(int)
    return spark.createDataFrame([("d", i, int(t), *[float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
                                 "date_trd string, trd_id long, y long, a double, b double, c double").repartition(4), x, y


def vote(x, y, q, k, self_at=None):
    out = []
    for v in q:
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        out.append(y[np.lexsort((np.arange(len(x)), d))[:k]].mean())
    return np.array(out)


def auc(y, p):
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])


def test_search_over_neighbour_grids_from_one_table(spark, planted):
    df, x, y = planted
    found = models.search_random("knn", df, ["a", "b", "c"], draws=8, k=3, seed=4)
    assert found.scores.count() == 8 and found.best_score > 0.7
    fold = {r["trd_id"]: r["fold"] for r in models.contiguous_folds(df, "y", 3).collect()}
    own = np.array([fold[i] for i in range(500)])
    import random
    rng = random.Random(4)
    draws = [models.draw_params("knn", rng) for _ in range(8)]
    checked = 0
    for i, p in enumerate(draws):
        if p["metric"] == "euclidean" and p["weights"] == "uniform":
            for f in range(3):
                train, test = own != f, own == f
                _, got_train, got_test = found.rows[i * 3 + f]
                assert got_test == pytest.approx(auc(y[test], vote(x[train], y[train], x[test], p["n_neighbors"])))
                assert got_train == pytest.approx(auc(y[train], vote(x[train], y[train], x[train], p["n_neighbors"])))
                checked += 1
    assert checked


BASES = [Base("knn11", "knn", ("a", "b"), {"n_neighbors": 11}), Base("knn25", "knn", ("a", "c"), {"n_neighbors": 25, "weights": "distance"}),
         Base("logit1", "logit", ("a", "b", "c"), {"regParam": 0.01})]


def test_stack_with_neighbours(spark, planted, tmp_path):
    df, x, y = planted
    train, test = df.where("trd_id < 350"), df.where("trd_id >= 350")
    folds = models.written(models.contiguous_folds(train, "y", 3), "folds")
    oof = {r["trd_id"]: r for r in models.out_of_fold(folds, BASES, "y", 3).collect()}
    own = {r["trd_id"]: r["fold"] for r in folds.collect()}
    fold = np.array([own[i] for i in range(350)])
    for f in range(3):
        want = vote(x[:350][fold != f][:, :2], y[:350][fold != f], x[:350][fold == f][:, :2], 11)
        assert np.allclose([oof[i]["knn11"] for i in np.flatnonzero(fold == f)], want)
    stack = models.fit_stack(train, BASES, meta_params={"C": 1.0})
    scored = {r["trd_id"]: r for r in stack.score(test).collect()}
    assert np.allclose([scored[i]["knn11"] for i in range(350, 500)], vote(x[:350, :2], y[:350], x[350:, :2], 11))
    assert models.area(stack.score(test)) > 0.8
    stack.save(str(tmp_path / "s"))
    again = models.Stack.load(spark, str(tmp_path / "s"))
    assert {r["trd_id"]: round(r["prob"], 12) for r in again.score(test).collect()} == {i: round(r["prob"], 12) for i, r in scored.items()}


def test_stack_search_refits_no_base(spark, planted, monkeypatch):
    df, _, _ = planted
    nested = models.nested_scores(df, BASES, outer=2, inner=2)
    counts = {(r["outer"], r["role"]): r["count"] for r in nested.groupBy("outer", "role").count().collect()}
    assert all(counts[o, "fit"] == counts[o, "train"] == 500 - counts[o, "test"] for o in (0, 1))
    monkeypatch.setattr(models, "fit_classifier", None)
    found = models.search_stack(df, BASES, draws=5, outer=2, nested=nested)
    assert found.scores.count() == 5 and 0.5 < found.best_score <= 1
    for i, train, test in found.rows:
        assert 0 <= test <= 1 and 0 <= train <= 1
    # the best draw's F-beta, again from its coefficients
    own = models.search_stack(df, BASES, draws=5, outer=2, nested=nested, scoring="auc")
    assert own.best_score > 0.8


def test_scoring_by_fbeta(spark, planted):
    df, x, y = planted
    folds = models.written(models.contiguous_folds(df, "y", 2), "folds")
    for _, test in models.cross_validate("logit", folds, ["a", "b"], 2, scoring=("fbeta", 0.5)):
        assert 0.6 < test < 1
    rows = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.5)], "y int, prob double")
    assert models.quality(rows, scoring=("fbeta", 0.5)) == pytest.approx(1.25 * 1 / (1.25 * 1 + 0.25 * 1 + 1))
    with pytest.raises(ValueError):
        models.quality(rows, scoring=("accuracy", 1))


def test_too_many_classes_are_refused(spark):
    df = spark.range(300).selectExpr("'d' as date_trd", "id as trd_id", "id as y")
    with pytest.raises(ValueError):
        models.contiguous_folds(df, "y", 3)
    with pytest.raises(ValueError):
        models.with_weights(df)


@pytest.mark.parametrize("apart", [False, True])
def test_meetings_of_long_vectors_are_one_product(monkeypatch, apart):
    """Every row's neighbours with ties by id, bit by bit, without the distances of all pairs in full."""
    rng = np.random.default_rng(5)
    q, t = (np.round(rng.normal(size=(n, 40)), 1) for n in (60, 900))
    t[300:330] = t[:30]
    q[:20] = t[:20]
    full = neighbours._distances(q, t, "euclidean")
    ids, folds = rng.permutation(900), (np.arange(60) % 3, np.arange(900) % 3)
    if apart:
        full[folds[0][:, None] == folds[1]] = np.inf
    known = {"pivots": t[:1], "rings": np.empty((1, 0)), "block": np.array([0]), "near": np.array([0.0]), "far": np.array([1e3]),
             "low": np.array([0.0]), "high": np.array([1e3]), "n": np.array([900])}
    queries = pd.DataFrame({"q_id": np.arange(60), "_v": list(q), "_radius": [np.nan, 8.0] * 30, "_fold": folds[0]})
    train = pd.DataFrame({"t_id": ids, "_v": list(t), "y": 1.0, "_block": 0, "_fold": folds[1]})
    monkeypatch.setattr(neighbours, "_distances", lambda a, b, metric, real=neighbours._distances: real(a, b, metric)
                        if len(b) < 900 else pytest.fail("all pairs"))
    run = neighbours._meeting(type("Known", (), {"value": known}), 5, "euclidean", ["id"], apart)
    got = run(queries, train)
    for i in range(60):
        order = np.lexsort((ids, full[i]))[:5]
        order = order[full[i][order] <= (8.0 if i % 2 else 1e300)]
        mine = got[got["q_id"] == i]
        assert mine["t_id"].tolist() == ids[order].tolist() and mine["d"].tolist() == full[i][order].tolist()


def _one_block(t):
    known = {"pivots": t[:1], "rings": np.empty((1, 0)), "block": np.array([0]), "near": np.array([0.0]), "far": np.array([1e3]),
             "low": np.array([0.0]), "high": np.array([1e3]), "n": np.array([len(t)])}
    return type("Known", (), {"value": known})


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("metric, width", [("euclidean", 3), ("braycurtis", 40)])
def test_meetings_of_short_vectors_and_of_bray_curtis_skip_most_distances(monkeypatch, metric, width, apart):
    """Every row's neighbours with ties by id, bit by bit, from few distances in double precision."""
    rng = np.random.default_rng(3)
    q, t = (np.round(rng.normal(size=(n, width)), 1) for n in (300, 3000))
    q[:, 0], t[:, 0] = 40 * rng.uniform(size=300), 40 * rng.uniform(size=3000)
    t[300:330], q[:20], q[20], t[50:60] = t[:30], t[:20], 0.0, 0.0
    full = neighbours._distances(q, t, metric)
    ids, folds = rng.permutation(3000), (np.arange(300) % 3, np.arange(3000) % 3)
    if apart:
        full[folds[0][:, None] == folds[1]] = np.inf
    radius = np.where(np.arange(300) % 2, np.partition(full, 2, axis=1)[:, 2], np.nan)
    queries = pd.DataFrame({"q_id": np.arange(300), "_v": list(q), "_radius": radius, "_fold": folds[0]})
    train = pd.DataFrame({"t_id": ids, "_v": list(t), "y": 1.0, "_block": 0, "_fold": folds[1]})
    counted = []
    monkeypatch.setattr(neighbours, "_distances", lambda a, b, metric, real=neighbours._distances:
                        counted.append(len(a) * len(b)) or real(a, b, metric))
    got = neighbours._meeting(_one_block(t), 5, metric, ["id"], apart)(queries, train)
    assert sum(counted) < 0.5 * full.size
    for i in range(300):
        order = np.lexsort((ids, full[i]))[:5]
        order = order[full[i][order] <= (radius[i] if i % 2 else 1e300)]
        mine = got[got["q_id"] == i]
        assert mine["t_id"].tolist() == ids[order].tolist() and mine["d"].tolist() == full[i][order].tolist()


def test_search_over_neighbours_holds_rows_against_each_other_once(spark, planted, monkeypatch):
    df, x, y = planted
    asked = []
    monkeypatch.setattr(models, "neighbour_table", lambda train, queries, *more, real=models.neighbour_table:
                        asked.append(train.count() * queries.count()) or real(train, queries, *more))
    tried = [{"n_neighbors": 5, "metric": "euclidean", "weights": "uniform"}]
    folds = models.written(models.contiguous_folds(df, "y", 4), "folds")
    rows = models._validate_neighbours(folds, ["a", "b", "c"], 4, "y", tried)
    assert sum(asked) == 500 * 500
    own = np.array([r["fold"] for r in folds.orderBy("trd_id").collect()])
    for f, (_, _, got) in enumerate(rows):
        assert got == pytest.approx(auc(y[own == f], vote(x[own != f], y[own != f], x[own == f], 5)))
