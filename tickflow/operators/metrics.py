"""Confusion counts, F scores, AUC, threshold sweeps and result reports.

Scores are never sorted in one task: sweeps reduce to one row per threshold step, AUC to
one row per distinct score and then to range-partitioned running counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.functions.scalars import above
from tickflow.order import cumulative

# objective, beta and step of the sweeps in use; the first one is the default
SWEEPS = [("fbeta", 0.4, 0.01), ("fbeta", 1.0, 0.1), ("ap", None, 0.1), ("fbeta", 0.5, 0.1),
          ("fbeta", 0.3, 0.1), ("fbeta", 0.3, 0.025), ("fbeta", 0.5, 0.01)]


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    def cell(a: int, b: int) -> Column:
        return F.count(F.when((F.col(y) == a) & (F.col(yhat) == b), 1))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                               cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _over(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(0.0)


def fbeta(beta: float, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Column:
    b2 = beta * beta
    tp_, fp_, fn_ = F.col(tp), F.col(fp), F.col(fn)
    return _over((1 + b2) * tp_, (1 + b2) * tp_ + b2 * fn_ + fp_)


def f1_weighted() -> Column:
    """Support-weighted F1 of both classes."""
    negatives, positives = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    return _over(fbeta(1.0) * positives + fbeta(1.0, "tn", "fn", "fp") * negatives,
                 positives + negatives)


def average_precision_hard() -> Column:
    """Average precision of 0/1 predictions."""
    positives = F.col("tp") + F.col("fn")
    share = _over(positives, positives + F.col("tn") + F.col("fp"))
    recall, precision = _over(F.col("tp"), positives), _over(F.col("tp"), F.col("tp") + F.col("fp"))
    return F.when(F.col("tp") + F.col("fp") == 0, share).otherwise(
        recall * precision + (1 - recall) * share)


def auc(df: DataFrame, y: str = "y", prob: str = "prob", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """ROC AUC, ties counted half; with ``weight`` each row counts as much as that says."""
    by = list(by) or ["_one"]
    source = df if "_one" not in by else df.withColumn("_one", F.lit(1))
    positive = F.col(y).cast("long")
    up, down = (positive, 1 - positive) if weight is None else (positive * F.col(weight), (1 - positive) * F.col(weight))
    per_score = (source.where(F.col(y).isNotNull() & F.col(prob).isNotNull())
                 .groupBy(*by, F.col(prob).alias("_p")).agg(F.sum(up).alias("_pos"), F.sum(down).alias("_neg")))
    ranked = cumulative(per_score, by, "_p", ["_neg"])
    wins = F.sum(F.col("_pos") * (F.col("before__neg") + F.col("_neg") / 2))
    out = ranked.groupBy(*by).agg(wins.alias("_w"), F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nn"))
    out = out.withColumn("auc", F.when(F.col("_np") * F.col("_nn") > 0,
                                       F.col("_w") / (F.col("_np").cast("double") * F.col("_nn"))))
    return out.drop("_w", "_np", "_nn", *(["_one"] if "_one" in by else []))


def threshold_steps(start: float = 0.2, stop: float = 1.0, step: float = 0.01) -> int:
    return ceil((stop - start) / step)


def threshold_counts(df: DataFrame, y: str = "y", prob: str = "prob", start: float = 0.2,
                     stop: float = 1.0, step: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts for every threshold start + i * step (strictly above is positive)."""
    n = threshold_steps(start, stop, step)
    p = F.col(prob)

    def threshold(i: Column) -> Column:
        return F.lit(start) + i * F.lit(step)

    # number of thresholds below p; the quotient may be off by one in floating point
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((p - start) / step))).cast("int")
    passed = (F.when((guess < n) & (p > threshold(guess)), guess + 1)
              .when((guess > 0) & (p <= threshold(guess - 1)), guess - 1).otherwise(guess))
    per_step = df.groupBy(*by, passed.alias("_k")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"), F.count(F.when(F.col(y) == 0, 1)).alias("_neg"))
    listed = per_step.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    positive = F.col("_k") > F.col("i")

    def total(col: str, hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col(col))), F.lit(0))

    return (listed.groupBy(*by, "i")
            .agg(total("_neg", ~positive).alias("tn"), total("_neg", positive).alias("fp"),
                 total("_pos", ~positive).alias("fn"), total("_pos", positive).alias("tp"))
            .select(*by, threshold(F.col("i")).alias("th"), "tn", "fp", "fn", "tp"))


def objective(kind: str, beta: float | None) -> Column:
    return average_precision_hard() if kind == "ap" else fbeta(beta)


def best_threshold(df: DataFrame, y: str = "y", prob: str = "prob", kind: str = "fbeta",
                   beta: float | None = 0.4, step: float = 0.01, digits: int = 12) -> DataFrame:
    """One row: the lowest threshold with the highest objective."""
    scored = threshold_counts(df, y, prob, step=step).withColumn("score", objective(kind, beta))
    return scored.orderBy(F.round("score", digits).desc(), "th").limit(1)


def report(train: DataFrame, test: DataFrame, y: str = "y", prob: str = "prob",
           threshold: float = 0.0) -> DataFrame:
    """One row: AUC, F1, F0.4 and confusion counts of both splits at one threshold.

    With threshold 0 the best F0.4 threshold of the training split is used.
    """
    th = threshold or best_threshold(train, y, prob).first()["th"]
    both = (train.select(F.lit("train").alias("split"), y, prob)
            .unionByName(test.select(F.lit("test").alias("split"), y, prob)))
    cells = confusion(both.withColumn("yhat", above(F.col(prob), th)), y, by=["split"])
    areas = auc(both, y, prob, by=["split"])
    scores = cells.join(areas, "split").select(
        "split", "auc", fbeta(1.0).alias("f1"), fbeta(0.4).alias("fbeta"), "tn", "fp", "fn", "tp")
    measures = ["auc", "f1", "fbeta", "tn", "fp", "fn", "tp"]
    return scores.groupBy().agg(*[
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
        for m in measures for s in ("train", "test")]).select(
        "*", (F.col("train_auc") - F.col("test_auc")).alias("overfit_auc"),
        (F.col("train_f1") - F.col("test_f1")).alias("overfit_f1"),
        (F.col("train_fbeta") - F.col("test_fbeta")).alias("overfit_fbeta"),
        F.lit(float(th)).alias("th"))


def constant_baselines(df: DataFrame, y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Metrics of scorers that always say 0 or always 0.99."""
    scored = df.select(y, F.explode(F.array(F.lit(0.0), F.lit(0.99))).alias("prob"))
    cells = confusion(scored.withColumn("yhat", above(F.col("prob"), threshold)), y, by=["prob"])
    areas = auc(scored.withColumn("trial", F.col("prob")), y, "prob", by=["trial"])
    return cells.join(areas, cells["prob"] == areas["trial"]).select(
        "prob", "auc", fbeta(1.0).alias("f1"), fbeta(0.4).alias("fbeta"))


def random_baselines(df: DataFrame, y: str = "y", trials: int = 20, seed: int = 0) -> DataFrame:
    """Mean and maximum of each metric over random scorers, at 0.5 and at 1 - positive rate."""
    rate = df.agg(F.avg(y).alias("r")).first()["r"]
    # the score is a function of the key, so it is the same whenever a row is computed again
    digits = F.substring(F.md5(F.concat_ws("|", "date_trd", "trd_id", "trial", F.lit(seed)).cast("binary")), 1, 13)
    scored = df.select(
        y, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"),
        "date_trd", "trd_id").select(
        y, "trial", (F.conv(digits, 16, 10).cast("long") / float(1 << 52)).alias("prob"))
    areas = auc(scored, y, "prob", by=["trial"])
    both = scored.select(y, "trial", "prob", F.explode(F.array(
        F.lit(0.5), F.lit(1.0 - rate))).alias("th"))
    cells = confusion(both.withColumn("yhat", (F.col("prob") > F.col("th")).cast("long")), y,
                      by=["trial", "th"])
    joined = cells.join(areas, "trial").select(
        "th", "auc", fbeta(1.0).alias("f1"), fbeta(0.4).alias("fbeta"))
    return joined.groupBy("th").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in ("auc", "f1", "fbeta")],
        *[F.max(m).alias(f"max_{m}") for m in ("auc", "f1", "fbeta")])


def fold_estimate(scores: DataFrame, spread: float = 4.0, overfit: float = 3.0,
                  by: Sequence[str] = ()) -> DataFrame:
    """mean_test - std_test / spread - |mean_train - mean_test| / overfit over fold scores."""
    return scores.groupBy(*by).agg(
        F.avg("train_score").alias("mean_train"), F.avg("test_score").alias("mean_test"),
        F.stddev_pop("test_score").alias("std_test")).withColumn(
        "estimate", F.col("mean_test") - F.col("std_test") / spread
        - F.abs(F.col("mean_train") - F.col("mean_test")) / overfit)
