import numpy as np
import pytest

from tickflow.operators import boosting, models
from tickflow.operators.boosting import Boosting, fit_boosted


def rows(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.integers(0, 6, n), rng.normal(0, 1, n).round(1), np.ones(n), rng.normal(0, 1, n)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 3) | (rng.random(n) < 0.1)).astype(int)
    x[rng.random(n) < 0.15, 0] = np.nan
    x[:20, 2] = np.inf
    return x, y


NAMES = [f"x{i}" for i in range(5)]


def frame(spark, x, y):
    data = [("d", i, int(t), *[None if v != v else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data + [("d", 10**6, None, *[1.0] * 5)],
                                 "date_trd string, trd_id long, y int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(4)


def grown(codes, g, h, p, bins):
    """One tree by trying every split of every node, as nested dicts."""
    def quality(a, b):
        return (np.sign(a) * max(abs(a) - p.alpha, 0)) ** 2 / (b + p.penalty)

    def node(at, depth):
        G, H = g[at].sum(), h[at].sum()
        leaf = {"value": -p.rate * np.sign(G) * max(abs(G) - p.alpha, 0) / (H + p.penalty), "G": G, "H": H}
        best = None
        if depth < p.depth:
            for c in range(codes.shape[1]):
                own = codes[at, c]
                for b in range(bins):
                    for missing in (False, True):
                        left = np.where(own == 255, missing, own <= b)
                        gl, hl = g[at][left].sum(), h[at][left].sum()
                        gr, hr = G - gl, H - hl
                        if left.all() or not left.any() or min(hl, hr) < p.min_child_weight:
                            continue
                        gain = quality(gl, hl) + quality(gr, hr) - quality(G, H)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, c, b, missing, left)
        if best is None:
            return leaf
        gain, c, b, missing, left = best
        out = {**leaf, "gain": gain, "column": c, "code": b, "missing": missing,
               "left": node(at[left], depth + 1), "right": node(at[~left], depth + 1)}
        ends = [out[s] for s in ("left", "right")]
        return leaf if gain < p.gamma and not any("left" in e for e in ends) else out

    return node(np.arange(len(g)), 0)


def walk(tree, codes):
    if "left" not in tree:
        return np.full(len(codes), tree["value"])
    own = codes[:, tree["column"]]
    left = np.where(own == 255, tree["missing"], own <= tree["code"])
    out = np.empty(len(codes))
    out[left], out[~left] = walk(tree["left"], codes[left]), walk(tree["right"], codes[~left])
    return out


@pytest.mark.parametrize("p", [
    Boosting(trees=3, depth=3, rate=0.5, bins=12), Boosting(trees=2, depth=4, rate=0.3, alpha=2.0, penalty=0.5, gamma=3.0, bins=8),
    Boosting(trees=2, depth=2, rate=1.0, min_child_weight=25.0, positive_weight=2.5, bins=30)])
def test_trees_equal_brute_force(spark, p):
    x, y = rows()
    fitted = fit_boosted(frame(spark, x, y), NAMES, params=p)
    codes = boosting.coded(x, fitted.edges)
    bins = max(len(e) for e in fitted.edges) + 1
    score, weight = np.zeros(len(y)), np.where(y > 0, p.positive_weight, 1.0)
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-score))
        score += walk(grown(codes, weight * (prob - y), weight * prob * (1 - prob), p, bins), codes)
    got = {r["trd_id"]: r["prob"] for r in fitted.score(frame(spark, x, y)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-score)), atol=1e-9)


def test_leaf_sums_and_shares(spark):
    x, y = rows()
    fitted = fit_boosted(frame(spark, x, y), NAMES, params=Boosting(trees=1, depth=3, penalty=2.0, alpha=0.5, gamma=0.1, bins=10))
    nodes = fitted.nodes()
    leaves = [n for n in nodes if n[2] is None]
    assert sum(n[8] for n in leaves) == pytest.approx((0.5 - y).sum()) and sum(n[9] for n in leaves) == pytest.approx(len(y) / 4)
    for *_, g, h, value in leaves:
        assert value == pytest.approx(-0.3 * np.sign(g) * max(abs(g) - 0.5, 0) / (h + 2.0))
    shares = fitted.importances()
    assert sum(shares.values()) == pytest.approx(1) and shares["x3"] == 0


def test_sampling_and_written_scores(spark, monkeypatch):
    x, y = rows()
    df = frame(spark, x, y)
    p = Boosting(trees=6, depth=2, row_share=0.6, column_share=0.5, bins=10, seed=5)
    whole = fit_boosted(df, NAMES, params=p)
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)
    again = fit_boosted(df.repartition(7), NAMES, params=p)
    # neither the partitioning nor the scores kept with the rows change a tree
    for a, b in zip(whole.nodes(), again.nodes()):
        assert a[:7] == b[:7] and np.allclose(a[8:], b[8:])
    for t in whole.trees:
        assert len({int(f) for f in t.feature if f >= 0}) <= 2
    assert whole.trees[0].curvature[0] == pytest.approx(0.25 * 0.6 * len(y), rel=0.15)


def test_quality_and_saving(spark, tmp_path):
    x, y = rows()
    df = frame(spark, x, y).where("y is not null")
    train, test = df.where("trd_id < 500"), df.where("trd_id >= 500")
    fitted = models.fit_classifier("gbt", train, NAMES, trees=15, depth=3, bins=20, balanced=True)
    assert models.area(fitted.score(test)) > 0.8
    fitted.save(str(tmp_path / "m"))
    again = models.Fitted.load(spark, str(tmp_path / "m"))
    a, b = ({r["trd_id"]: r["prob"] for r in m.score(test).collect()} for m in (fitted, again))
    assert a == b


def test_no_rows(spark):
    x, y = rows(30)
    empty = fit_boosted(frame(spark, x, y).limit(0), NAMES, params=Boosting(trees=2))
    assert [len(t.feature) for t in empty.trees] == [1, 1]
    with pytest.raises(ValueError):
        fit_boosted(frame(spark, x, y), NAMES, params=Boosting(bins=300))
