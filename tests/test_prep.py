import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickflow.functions.quantiles import profile, quantiles, unpivot
from tickflow.functions.scalars import clip, ratio_or_zero, right_closed_bin, signed_log
from tickflow.operators import aggregates, prep
from tickflow.order import Order

PROBS = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


def test_quantile_refinement_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n = 3000
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 100, n))      # one value holds 40 %
    tiny = rng.random(n) * 1e-12 + 1.0
    flat = np.full(n, 3.0)
    rows = [(float(a), float(b), float(c), None if i % 5 else float(a))
            for i, (a, b, c) in enumerate(zip(hot, tiny, flat))]
    df = spark.createDataFrame(rows, "hot double, tiny double, flat double, holes double").repartition(6)
    columns = {"hot": hot, "tiny": tiny, "flat": flat,
               "holes": np.array([r[3] for r in rows if r[3] is not None])}
    refined = quantiles(df, {c: PROBS for c in columns}, buckets=4)
    direct = quantiles(df, {c: PROBS for c in columns})
    for c, values in columns.items():
        want = np.quantile(values, PROBS)
        assert np.allclose(refined[c], want, rtol=1e-13, atol=1e-13)
        assert np.allclose(direct[c], want, rtol=1e-13, atol=1e-13)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    for buckets in (2, None):
        assert quantiles(df, {"a": [0.5], "b": [0.5]}, buckets) == {"a": [1.5], "b": [None]}


def test_quantiles_leave_out_what_is_no_number(spark):
    rows = [(float(v), w) for v, w in zip([1, 2, math.inf, -math.inf, math.nan, 3], [1e308, -1e308, 5e-324, 0.0, 1.0, 1e300])]
    df = spark.createDataFrame(rows, "a double, b double")
    for buckets in (2, 3, None):
        got = quantiles(df, {"a": [0.0, 0.5, 1.0], "b": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]}, buckets)
        assert got["a"] == [1.0, 2.0, 3.0]
        assert got["b"] == [-1e308, 0.0, 5e-324, 1.0, 1e300, 1e308]


def test_statistics_of_capped_columns(spark):
    x = np.random.default_rng(1).standard_t(2, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    caps, found = prep.capped_statistics(df, {"x": 0.03}, {"x": [0.0, 0.02, 0.5, 0.985, 1.0]})
    low, high = np.quantile(x, [0.03, 0.97])
    assert np.allclose(caps["x"], (low, high))
    assert np.allclose(found["x"], np.quantile(np.clip(x, low, high), [0.0, 0.02, 0.5, 0.985, 1.0]))


def test_scalar_rules(frame):
    df = frame("x double, y double", [(1.0, 0.0), (0.0, 0.0), (None, 1.0), (-3.0, 2.0)])
    out = df.select(ratio_or_zero(F.col("x"), F.col("y")).alias("r"), F.expr(clip("x", -1, 0.5)).alias("c"),
                    F.expr(signed_log("x")).alias("l")).collect()
    assert [r["r"] for r in out] == [0.0, None, None, -1.5]
    assert [r["c"] for r in out] == [0.5, 0.0, None, -1.0]
    assert [None if r["l"] is None else round(r["l"], 9) for r in out] == [
        round(math.log(2), 9), 0.0, None, round(-math.log(4), 9)]


def test_bins_are_right_closed(frame):
    df = frame("x double", [(v,) for v in (0.0, 0.5, 1.0, 1.1, 2.0, 2.1, -0.1, None)])

    def bins(**kw):
        return [r["b"] for r in df.select(F.expr(right_closed_bin("x", [0, 1, 2], **kw)).alias("b")).collect()]
    assert bins() == [0, 0, 0, 1, 1, None, None, None]
    assert bins(lowest=False) == [None, 0, 0, 1, 1, None, None, None]
    assert bins(open_ends=True) == [0, 0, 0, 1, 1, 1, 0, None]


def test_duplicate_edges_collapse(frame):
    df = frame("x double", [(1.0,)] * 8 + [(2.0,), (3.0,)])
    edges = prep.fit_quantile_bins(df, {"x": 4})
    assert edges["x"] == [1.0, 3.0]
    assert {r["x"] for r in prep.apply_quantile_bins(df, edges).collect()} == {0}


def test_norms_and_scales(frame):
    values = [float(v) for v in range(11)]
    df = frame("x double, k double", [(v, 4.0) for v in values] + [(None, 4.0)])
    robust = prep.fit_robust_norm(df, ["x"], 0.1)
    out = [r["x"] for r in prep.apply_norm(df, robust).collect()]
    sd = np.std(values, ddof=1)
    assert out[:2] == [pytest.approx((1 - 5) / sd)] * 2 and out[-1] is None
    base = prep.fit_base_norm(df, ["x", "k"], 0.1)
    out = [(r["x"], r["k"]) for r in prep.apply_norm(df, base, zero_nulls=True).collect()]
    capped = np.clip(values, 1, 9)
    assert out[0][0] == pytest.approx((1 - 5) / np.std(capped, ddof=1))
    assert out[-1] == (0.0, 0.0)                       # NULL and zero spread become 0
    scale = prep.fit_robust_scale(df, ["x", "k"], 10, 90)
    assert scale["x"] == (5.0, 8.0) and scale["k"] == (4.0, 1.0)


def test_mean_encoding_of_unseen_and_join_path(frame):
    train = frame("date_trd string, trd_id long, c long, y double",
                  [("d", 0, 1, 0.0), ("d", 1, 1, 1.0), ("d", 2, 2, 1.0)])
    test = frame("date_trd string, trd_id long, c long, y double",
                 [("d", 0, 1, 0.0), ("d", 1, 2, 0.0), ("d", 2, 9, 0.0), ("d", 3, None, 0.0)])
    table = prep.fit_mean_encoding(train, ["c"])
    for literal_rows in (100, 0):
        got = prep.apply_mean_encoding(test, table, ["c"], Order(block_rows=2, broadcast_rows=0), literal_rows)
        assert [r["c"] for r in got.orderBy("trd_id").collect()] == [0.5, 1.0, None, None]


def test_mean_encoding_of_other_types_and_unknown_means(frame):
    rows = [("d", k, c, y) for k, (c, y) in enumerate([("a'b", 1.0), ("a'b", 0.0), ("z", None), (None, 1.0)])]
    train = frame("date_trd string, trd_id long, c string, y double", rows)
    for cast, kind, want in (("string", "string", [0.5, 0.5, None, None]), ("binary", "binary", [0.5, 0.5, None, None])):
        table = prep.fit_mean_encoding(train, ["c"], cast=cast)
        for literal_rows in (100, 0):
            got = prep.apply_mean_encoding(train.withColumn("c", F.col("c").cast(kind)), table, ["c"],
                                           Order(block_rows=2, broadcast_rows=0), literal_rows)
            assert [r["c"] for r in got.orderBy("trd_id").collect()] == want


@pytest.mark.parametrize("n,share", [(10, 0.2), (11, 0.2), (7, 0.15), (3, 0.5)])
def test_ordered_split(spark, n, share):
    df = spark.range(n).selectExpr("concat('d', id div 4) as date_trd", "id % 4 as trd_id", "id")
    train, test = prep.ordered_split(df, share, Order(block_rows=2))
    cut = n - math.ceil(n * share)
    assert sorted(r["id"] for r in train.collect()) == list(range(cut))
    assert sorted(r["id"] for r in test.collect()) == list(range(cut, n))


def test_class_weights_and_histogram(frame):
    df = frame("y long, x double", [(0, 0.0), (0, 1.0), (0, 2.0), (1, 10.0)])
    assert {r["y"]: r["weight"] for r in aggregates.class_weights(df).collect()} == {
        0: pytest.approx(4 / 6), 1: 2.0}
    counts = [r["n"] for r in aggregates.histogram(df, "x", 5).orderBy("bin").collect()]
    assert counts == np.histogram([0, 1, 2, 10], 5)[0].tolist()


def test_null_reports(frame):
    df = frame("a double, b double", [(1.0, None), (None, None)])
    assert [(r["column"], r["nulls"]) for r in aggregates.null_counts(df, ["a", "b"]).collect()] == [
        ("b", 2), ("a", 1)]
    assert {r["column"]: r["has_null"] for r in aggregates.any_null(df, ["a", "b"]).collect()} == {"a": 1, "b": 1}


def test_profile_is_that_of_spark_and_sends_a_row_per_column_and_task(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.5, 0.1, None, nan, 1e300, inf, 2.0), (-2.25, 0.1, None, 3.0, -1e300, 1.0, None), (7.0, 0.1, None, None, 0.0, 2.0, None)] * 9
    columns = list("abcdefg")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5).where("a is not null")
    got = profile(df, columns)
    want = unpivot(df, columns).groupBy("c").agg(
        F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    for r in want.collect():
        for name, value in r.asDict().items():
            own = got[r["c"]][name]
            assert own == value or str(own) == str(value) or own == pytest.approx(value, rel=1e-12), (r, name, own)
    assert got["b"]["std"] == 0.0 and got["c"]["low"] is None
    assert profile(df.where("a > 100"), columns) == {}
    one = profile(df.limit(1), ["a"])["a"]
    assert one["n"] == 1 and one["std"] is None
    plans = []
    real = type(df).collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
        profile(df, columns)
    assert plans and "Generate" not in plans[0]                      # no row per value
