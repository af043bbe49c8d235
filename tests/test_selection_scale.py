"""Selection steps at width: what a pass plans, writes and gives."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickflow.operators import neighbours, selection
from tickflow.plans import modelling


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mi_scores_counts_in_tasks(spark):
    rows = [(float(i % 7), None if i % 5 == 0 else float(i * i % 11), math.nan if i % 13 == 0 else 1.0 * i, i % 3 == 0) for i in range(300)]
    rows = [(*r[:3], int(r[3]) if i % 17 else None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y long").repartition(3)
    edges = selection.fit_quantile_bins(df, {c: 4 for c in "abc"})
    got = selection.mi_scores(df, list("abc"), "y", 4)
    assert "Generate" not in plan(got) and "Join" not in plan(got)          # rows are not multiplied by columns
    scores = {r["cols"]: r["importance"] for r in got.collect()}
    for i, c in enumerate("abc"):
        cells = Counter((sum(e < r[i] or math.isnan(r[i]) for e in edges[c][1:-1]), r[3]) for r in rows if r[i] is not None)
        n, x, y = sum(cells.values()), Counter(), Counter()
        for (bin_, label), k in cells.items():
            x[bin_] += k
            y[label] += k
        assert scores[c] == pytest.approx(sum(k / n * math.log(k * n / (x[b] * y[v])) for (b, v), k in cells.items()))


def test_noise_is_not_written(spark, monkeypatch):
    df = spark.createDataFrame([("d", i, i % 2) for i in range(200)], "date_trd string, trd_id long, y long")
    monkeypatch.setattr(selection, "written", None)
    got = {r["cols"]: r["importance"] for r in selection.mi_random(df, "y", 1).collect()}
    assert set(got) == {f"{c}_0" for c in ("uniform", "exp", "lognormal", "normal", "zero", "one")}
    assert got["zero_0"] == got["one_0"] == 0 < got["uniform_0"]


def test_rankings_are_computed_once(spark):
    table = modelling.rankings(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in plan(table)
    assert table.count() == 3 * len(modelling._RANKED)


def test_permutation_writes_no_row_per_variant(spark, monkeypatch):
    """Areas from packed ranges are those of the scored rows, with values of few and of many rows and a row without target."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(1500, 3)), 1)
    y = (x[:, 0] + rng.normal(size=1500) > 0.5).astype(int)
    rows = [(f"d{i % 3}", i, None if i == 7 else int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    df = selection.written(spark.createDataFrame(rows, "date_trd string, trd_id long, y int, a double, b double, c double"))

    class Plain:
        def plain(self):
            return lambda v: np.round(1 / (1 + np.exp(-v @ np.array([1.0, 0.3, 0.0]))), 2)

    def as_rows(frame):
        return frame.withColumn("prob", F.round(1 / (1 + F.exp(-(F.col("a") + 0.3 * F.col("b")))), 2))

    want = {r["cols"]: r["importance"] for r in selection.permutation_importance(df, ["a", "b", "c"], as_rows).collect()}
    sizes = []
    monkeypatch.setattr(selection, "written", lambda f, label="", real=selection.written: sizes.append(real(f, label)) or sizes[-1])
    for name, value in (("RANGE_ROWS", 200), ("HELD_ROWS", 600), ("PART_ROWS", 100)):
        monkeypatch.setattr(selection, name, value)
    for weighted in (False, True):
        got = {r["cols"]: r["importance"] for r in selection.permutation_importance(df, ["a", "b", "c"], Plain(), weighted=weighted).collect()}
        assert got == pytest.approx(want, abs=1e-12) and got["a"] > 0.1 and got["c"] == 0
    assert max(f.count() for f in sizes) < 1500


def test_family_query_ranks_by_all_families(spark, frame, monkeypatch):
    from tickflow.plans import modelling
    asked = []

    def ranked(df, columns, family, **own):
        asked.append(family)
        return frame("ranking string, cols string, importance double", [(family, "a", 1.0)])

    rows = frame("a double, y int", [(float(i), i % 2) for i in range(40)])
    monkeypatch.setattr(modelling, "X", ["a"])
    monkeypatch.setattr(modelling, "model_frame", lambda spark, sf: (rows, rows))
    monkeypatch.setattr(selection, "family_importances", ranked)
    found = {r["ranking"] for r in modelling.sel_family(spark, "nowhere").collect()}
    assert sorted(asked) == ["knn", "linear", "svm", "tree"] and found == {"mi", *asked}


def test_rows_in_reach_hold_the_nearest_of_every_variant():
    rng = np.random.default_rng(4)
    for width, k in ((1, 3), (12, 5), (40, 16)):
        t, few = rng.normal(size=(900, width)), 0
        for _ in range(20):
            x, other = rng.normal(size=width), rng.normal(size=width)
            terms = (x - t) ** 2
            own = neighbours._in_reach(terms, terms.sum(axis=1), other, t, k)
            few += len(own)
            for j in range(-1, width):
                at = x.copy()
                if j >= 0:
                    at[j] = other[j]
                d = ((at - t) ** 2).sum(axis=1)
                assert set(np.argsort(d)[:k]) <= set(own)
        assert few < 20 * 900 or width == 1
