from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickflow.operators import linear_fits, models
from tickflow.operators.linear_fits import Blocks, Fit, fit_all


def rows(n=500, p=6, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, p))
    x[:, 1] = 0.9 * x[:, 0] + 0.3 * x[:, 1]
    y = (x[:, 0] - 0.7 * x[:, 2] + 0.4 * x[:, 3] + rng.logistic(0, 1, n) > 0.4).astype(int)
    return x, y, np.arange(n) % 4


@pytest.fixture(scope="module")
def blocks(spark):
    x, y, fold = rows()
    data = [(*[float(v) for v in r], int(a), int(f)) for r, a, f in zip(x, y, fold)]
    # rows that can't be used
    data += [(None, *[1.0] * 5, 1, 0), (float("nan"), *[1.0] * 5, 0, 0), (*[1.0] * 6, None, 0), (*[1.0] * 6, 1, None)]
    df = spark.createDataFrame(data, ", ".join(f"x{i} double" for i in range(6)) + ", y int, fold int").repartition(5)
    return Blocks(df, [f"x{i}" for i in range(6)], "y", "fold")


def single(x, y, columns, l1=0.0, l2=0.0, loss="logistic", weights=(1.0, 1.0), steps=20_000):
    """One fit by plain proximal gradient descent."""
    own = np.column_stack([x[:, list(columns)], np.ones(len(x))])
    w = np.where(y > 0, weights[1], weights[0])
    bound = (0.25 if loss == "logistic" else 2) * np.linalg.norm(own * np.sqrt(w)[:, None], 2) ** 2 + l2
    b, past, t = np.zeros(own.shape[1]), np.zeros(own.shape[1]), 1.0
    for _ in range(steps):
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = b + (t - 1) / further * (b - past)
        z = own @ at
        if loss == "logistic":
            pull = 1 / (1 + np.exp(-z)) - y
        else:
            pull = -2 * (2 * y - 1) * np.maximum(1 - (2 * y - 1) * z, 0)
        g = own.T @ (w * pull)
        g[:-1] += l2 * at[:-1]
        new = at - g / bound
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - l1 / bound, 0)
        past, b, t = b, new, further
    return b


def area(y, z):
    z = np.floor(z * linear_fits.RESOLUTION)
    return np.mean([(a > b) + 0.5 * (a == b) for a in z[y == 1] for b in z[y == 0]])


def test_fits_of_one_call_equal_single_fits(blocks):
    x, y, fold = rows()
    n = [(y == c).sum() for c in (0, 1)]
    fits = [Fit((0, 1, 2, 3, 4, 5), l2=1.0), Fit((0, 2), held=1, l2=0.5), Fit((1, 3, 5), only=2, l2=2.0),
            Fit((0, 1, 2, 3, 4, 5), l1=20.0), Fit((0, 1, 2, 3), held=0, l1=10.0, balanced=True),
            Fit((0, 1, 2, 3, 4, 5), l1=30.0, loss="squared_hinge"), Fit((2, 4), l1=1.0, l2=1.0, loss="squared_hinge")]
    for fit, state in zip(fits, fit_all(blocks, fits, tolerance=1e-9)):
        seen = np.ones(len(y), bool) if fit.held is None and fit.only is None else (
            fold != fit.held if fit.only is None else fold == fit.only)
        own = y[seen]
        weights = tuple(len(own) / (2 * (own == c).sum()) for c in (0, 1)) if fit.balanced else (1.0, 1.0)
        want = single(x[seen], own, fit.columns, fit.l1, fit.l2, fit.loss, weights)
        got = state.beta[[*fit.columns, 6]]
        assert state.done and np.allclose(got, want, atol=2e-5), (fit, got, want)
        assert set(np.flatnonzero(state.beta[:-1])) <= set(fit.columns)
        z = x @ state.beta[:-1] + state.beta[-1]
        if not seen.all():
            assert state.auc == pytest.approx(area(y[~seen], z[~seen]))
        assert state.train_auc == pytest.approx(area(y[seen], z[seen]))
    # the lasso leaves columns out
    assert (fit_all(blocks, [fits[3]])[0].beta[:-1] == 0).any() and n[0] and n[1]


def test_fits_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(1.0, 1, 0)], "a double, y int, fold int")
    empty = fit_all(Blocks(df.limit(0), ["a"], "y", "fold"), [Fit((0,), l2=1.0)])[0]
    assert empty.done and not empty.beta.any()
    alone = fit_all(Blocks(df, ["a"], "y", "fold"), [Fit((0,), l2=1.0)], most=5)[0]
    assert np.isfinite(alone.beta).all() and np.isnan(alone.auc)


def backward_by_single_fits(x, y, fold, folds, keep):
    left, log = list(range(x.shape[1])), []
    while len(left) > keep:
        scores = {}
        for c in left:
            own = [o for o in left if o != c]
            areas = []
            for f in range(folds):
                b = single(x[fold != f], y[fold != f], own, l2=1.0, steps=3000)
                areas.append(area(y[fold == f], x[fold == f][:, own] @ b[:-1] + b[-1]))
            scores[c] = np.mean(areas)
        worst = max(left, key=lambda c: (round(scores[c], 9), -c))
        left.remove(worst)
        log.append((f"x{worst}", scores[worst]))
    return log


def test_backward_selection_equals_single_fits(blocks):
    x, y, fold = rows()
    want = backward_by_single_fits(x, y, fold, 4, 2)
    got = linear_fits.backward(blocks, 4, 2, refresh=2)
    assert [c for c, _ in got] == [c for c, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=2e-4)


def test_passes_do_not_grow_with_the_subsets(blocks, monkeypatch):
    passes = []
    look = Blocks._look
    monkeypatch.setattr(Blocks, "_look", lambda self, states, h: (passes.append(len(states)), look(self, states, h))[1])
    parents = fit_all(blocks, [Fit(tuple(range(6)), f, l2=1.0) for f in range(4)])
    inverses = [np.linalg.inv(linear_fits._curved(p)) for p in parents]
    passes.clear()
    found = linear_fits.without_each(blocks, parents, inverses)
    assert sum(len(v) for v in found.values()) == 24
    assert passes[0] == 24 and len(passes) <= 9


def test_addition_equals_trying_one_by_one(blocks):
    x, y, fold = rows()
    order = ["x0", "x4", "x2", "x1", "x3", "x5"]

    def mean_area(own):
        areas = []
        for f in range(4):
            b = single(x[fold != f], y[fold != f], own, l2=1.0, steps=4000)
            areas.append(area(y[fold == f], x[fold == f][:, own] @ b[:-1] + b[-1]))
        return np.mean(areas)

    kept, best, want = [0], mean_area([0]), []
    for c in order[1:]:
        gain = mean_area(kept + [int(c[1])]) - best
        want.append((c, gain > 0.002))
        if gain > 0.002:
            kept, best = kept + [int(c[1])], best + gain
    got = linear_fits.addition(blocks, order, 4, 0.002)
    assert [(c, k) for c, _, k in got[1:]] == want and got[0][0] == "x0"


def test_elimination_equals_single_fits(blocks):
    x, y, fold = rows()

    def path(rows_in):
        left = list(range(6))
        while len(left) > 2:
            b = single(x[rows_in], y[rows_in], left, l1=3.0)
            b = np.where(np.abs(b) < 1e-9, 0, b)
            left.remove(min(left, key=lambda c: (abs(b[left.index(c)]), c)))
        return left

    kept, areas = linear_fits.elimination(blocks, 4, 2, l1=3.0)
    assert kept == [f"x{c}" for c in path(np.ones(len(y), bool))]
    for f, got in enumerate(areas):
        own = path(fold != f)
        b = single(x[fold != f], y[fold != f], own, l1=3.0)
        assert got == pytest.approx(area(y[fold == f], x[fold == f][:, own] @ b[:-1] + b[-1]), abs=2e-4)


def test_linear_svm_meets_its_conditions_and_is_calibrated_elsewhere(spark, tmp_path):
    x, y, _ = rows(900)
    df = spark.createDataFrame([("d", i, int(t), *[float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
                               "date_trd string, trd_id long, y int, " + ", ".join(f"x{i} double" for i in range(6))).repartition(3)
    names = [f"x{i}" for i in range(6)]
    fitted = models.fit_classifier("linear_svm", df, names, C=0.02)
    w, side = np.array(fitted.weights), 2 * y - 1
    gap = np.maximum(1 - side * (x @ w + fitted.intercept), 0)
    g = -2 * (x.T @ (side * gap))
    assert abs((side * gap).sum()) < 1e-3
    for slope, v in zip(g, w):
        assert abs(slope) <= 50 + 1e-3 if v == 0 else abs(slope + 50 * np.sign(v)) < 1e-3
    assert (w == 0).any() and (w != 0).any()
    scores = {r["trd_id"]: r["prob"] for r in fitted.score(df).collect()}
    assert np.mean(list(scores.values())) == pytest.approx(y.mean(), abs=0.03)
    fitted.save(str(tmp_path / "m"))
    again = models.Fitted.load(spark, str(tmp_path / "m"))
    assert {r["trd_id"]: r["prob"] for r in again.score(df).collect()} == scores
    plain = fitted.plain()(x)
    assert np.allclose(plain, [scores[i] for i in range(len(y))])


def test_search_over_penalties_shares_passes(spark, monkeypatch):
    x, y, _ = rows(400)
    df = spark.createDataFrame([("d", i, int(t), *[float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
                               "date_trd string, trd_id long, y int, " + ", ".join(f"x{i} double" for i in range(6))).repartition(3)
    passes = []
    look = Blocks._look
    monkeypatch.setattr(Blocks, "_look", lambda self, states, h: (passes.append(len(states)), look(self, states, h))[1])
    found = models.search_random("logit", df, [f"x{i}" for i in range(6)], draws=6, k=4)
    assert found.scores.count() == 6 and passes[0] == 24 and len(passes) < 40
    assert found.best_score > 0.6 and found.train_score >= found.best_score - 0.1
    folds = models.contiguous_folds(df, "y", 4)
    fold = {r["trd_id"]: r["fold"] for r in folds.collect()}
    own = np.array([fold[i] for i in range(len(y))])
    weights = lambda t: tuple(len(t) / (2 * (t == c).sum()) for c in (0, 1))
    for f in range(4):
        b = single(x[own != f], y[own != f], range(6), l1=1 / found.best["C"], weights=weights(y[own != f]))
        got = [r for r in found.rows if r[0] == int(found.scores.orderBy("mean_test", ascending=False).first()["draw"])][f][2]
        assert got == pytest.approx(area(y[own == f], x[own == f] @ b[:-1] + b[-1]), abs=1e-3)


def looked(monkeypatch):
    """(fits, whether cross-products were asked) of every pass."""
    passes = []
    look = Blocks._look
    monkeypatch.setattr(Blocks, "_look", lambda self, states, h: (passes.append((len(states), h)), look(self, states, h))[1])
    return passes


@pytest.fixture(scope="module")
def wide_blocks(spark):
    """Twenty-four columns, one of them empty and two alike."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (900, 24))
    x[:, 5], x[:, 9] = 0.0, x[:, 8] + 0.05 * x[:, 9]
    y = (x @ np.linspace(1.2, 0.01, 24) + rng.logistic(0, 1, 900) > 0).astype(int)
    df = spark.createDataFrame([(*[float(v) for v in r], int(a), i % 3) for i, (r, a) in enumerate(zip(x, y))],
                               ", ".join(f"x{i} double" for i in range(24)) + ", y int, fold int").repartition(3)
    return Blocks(df, [f"x{i}" for i in range(24)], "y", "fold")


def test_steps_near_a_solution_need_no_cross_products(wide_blocks, monkeypatch):
    fits = [Fit(tuple(range(24)), f, l1=2.0, balanced=True) for f in range(3)]
    passes = looked(monkeypatch)
    states = fit_all(wide_blocks, fits, tolerance=1e-9)
    curved, plain = (sum(n for n, h in passes if h is kind) for kind in (True, False))
    assert all(s.done and linear_fits.violation(s) <= 1e-9 * 900 for s in states)
    assert plain >= 3 and curved <= 21


def test_elimination_tries_many_removals_in_the_same_passes(wide_blocks, monkeypatch):
    passes = looked(monkeypatch)
    kept, areas = linear_fits.elimination(wide_blocks, 3, 14, l1=1.0)
    curved = sum(h for _, h in passes)
    monkeypatch.undo()
    assert curved <= 15                                      # fits one by one take two passes with them at least

    def one_by_one(held):
        s = fit_all(wide_blocks, [Fit(tuple(range(24)), held, l1=1.0)], tolerance=1e-6)[0]
        columns = list(range(24))
        while len(columns) > 14:
            least = min(columns, key=lambda c: (abs(s.beta[c]), c))
            columns.remove(least)
            if s.beta[least]:
                start = s.beta.copy()
                start[least] = 0.0
                s = fit_all(wide_blocks, [Fit(tuple(columns), held, l1=1.0)], [start], 1e-6)[0]
        return columns, s.auc

    assert kept == [f"x{c}" for c in one_by_one(None)[0]]
    assert areas[0] == pytest.approx(one_by_one(0)[1], abs=2e-4)


def test_elimination_of_columns_that_are_all_zero(wide_blocks):
    kept, areas = linear_fits.elimination(wide_blocks, 3, 5, l1=1e6)
    assert kept == [f"x{c}" for c in range(19, 24)] and areas == [0.5] * 3


def test_slopes_of_few_columns_are_those_of_all(wide_blocks):
    rng = np.random.default_rng(2)
    betas = np.zeros((6, 25))
    fits = [Fit((0, 3, 7 + i), i % 3, l2=1.0) for i in range(6)]
    for b, f in zip(betas, fits):
        b[[*f.columns, 24]] = rng.normal(0, 1, 4)
    assert linear_fits._shared_columns([np.array([*f.columns, 24]) for f in fits], 24)[1] is not None
    some = [linear_fits.State(f, b) for f, b in zip(fits, betas)]
    wide_blocks.look(some, hessians=True)
    for s in some:
        alone = linear_fits.State(Fit(tuple(range(24)), s.fit.held, l2=1.0), s.beta)
        wide_blocks.look([alone], hessians=True)
        at = [*s.fit.columns, 24]
        assert s.loss == pytest.approx(alone.loss) and s.auc == alone.auc and s.train_auc == alone.train_auc
        assert np.allclose(s.gradient[at], alone.gradient[at]) and np.allclose(s.hessian, alone.hessian[np.ix_(at, at)])


def test_blocks_and_counts_have_a_fixed_size(spark, monkeypatch):
    """Stored blocks are small whatever the number of rows, and scores are counted in one table, flush by flush."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (3000, 100)), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, y int").coalesce(1)
    made = Blocks(df.select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(100)]), [f"x{i}" for i in range(100)])
    sizes = [r[0] for r in made.table.selectExpr("length(x)").collect()]
    assert sum(sizes) == 8 * x.size and max(sizes) <= linear_fits.BLOCK_BYTES

    batch = made.table.toArrow().to_batches()
    beta = rng.normal(0, 0.3, (101, 20))
    none = np.full(20, np.iinfo(np.int64).min)
    plan = (beta, np.ones((20, 2)), none, none, ["logistic"] * 20, [np.arange(101)] * 20, False, 100)
    monkeypatch.setattr(linear_fits, "CODES", 5000)
    monkeypatch.setattr(linear_fits, "CELLS", 20 * 64)
    parts = list(linear_fits._scan(SimpleNamespace(value=plan), 8)(iter(batch)))
    assert [p.column("task").to_pylist() for p in parts] == [[0], [1], [2]] and max(p.num_rows for p in parts) == 1
    z = x @ beta[:100] + beta[100]
    for k, part in enumerate(parts):
        done = linear_fits._finished(pa.Table.from_batches([part]))
        own = range(8 * k, min(8 * k + 8, 20))
        assert done.column("auc")[0].as_py() == pytest.approx([float("nan")] * len(own), nan_ok=True)
        want = [linear_fits._area(*(np.bincount(np.unique(np.floor(z[:, t] * linear_fits.RESOLUTION), return_inverse=True)[1], y == c)
                                    for c in (1, 0))) for t in own]
        assert np.allclose(done.column("train_auc")[0].as_py(), want)
    # sums of two parts are those of twice the rows
    twice = linear_fits._added(pa.Table.from_batches([parts[0], parts[0]]))
    once = linear_fits._sums(pa.Table.from_batches([parts[0]]))
    assert np.array_equal(linear_fits._sums(twice)[1], 2 * once[1])


def test_few_rows_give_the_same_fits_in_tasks_and_in_passes(blocks, monkeypatch):
    fits = [Fit((0, 1, 2, 3, 4, 5), l2=1.0), Fit((0, 2), held=1, l2=0.5, balanced=True), Fit((1, 3, 5), only=2, l2=2.0),
            Fit((0, 1, 2, 3, 4, 5), l1=20.0), Fit((0, 1, 2, 3, 4), held=0, l1=3.0, loss="squared_hinge")]
    assert blocks.small
    monkeypatch.setattr(linear_fits, "MANY", 5)               # the four fits that all others start from take passes
    at_hand = fit_all(blocks, fits, tolerance=1e-9)
    dropped = linear_fits.backward(blocks, 4, keep=2)
    monkeypatch.setattr(linear_fits, "AT_HAND", 0)
    assert not blocks.small
    for a, b in zip(at_hand, fit_all(blocks, fits, tolerance=1e-9)):
        assert np.allclose(a.beta, b.beta, atol=1e-9)
        assert (a.done, a.auc, a.train_auc) == (b.done, pytest.approx(b.auc, nan_ok=True), pytest.approx(b.train_auc, nan_ok=True))
    again = linear_fits.backward(blocks, 4, keep=2)
    assert [c for c, _ in dropped] == [c for c, _ in again]
    assert np.allclose([v for _, v in dropped], [v for _, v in again], atol=1e-3)


def test_inverse_of_a_hundred_columns(spark):
    """On the driver, where the library's own inverse of such a matrix did not come back."""
    a = np.random.default_rng(1).normal(size=(130, 111))
    h = a.T @ a + np.eye(111)
    assert np.allclose(linear_fits._inverse(h) @ h, np.eye(111))


def test_backward_selection_starts_from_all_features(spark, monkeypatch):
    from tickflow.plans import modelling
    asked = {}
    monkeypatch.setattr(modelling, "_blocks", lambda spark, sf, k=5, columns=modelling.X: asked.update(columns=list(columns)))
    monkeypatch.setattr(linear_fits, "backward", lambda blocks, folds, keep, **own: asked.update(folds=folds, keep=keep) or [("a", 0.5)])
    modelling.sel_sequential(spark, "nowhere").collect()
    assert asked == {"columns": modelling.X, "folds": 5, "keep": 14}
