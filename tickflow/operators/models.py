"""Folds, classifiers, stacking, search and comparison.

Forests, plain logistic regression and dense networks are those of Spark ML, the RBF kernel is one of its linear
machines on random Fourier features. Boosted trees, L1 linear machines, nearest neighbours and searches over linear
models have their own modules.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import classification
from pyspark.ml.classification import (LinearSVC, LogisticRegression, LogisticRegressionModel,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.operators.aggregates import class_weights
from tickflow.operators.boosting import Boosted, Boosting, fit_boosted
from tickflow.operators.linear_fits import Blocks, Fit, State, fit_all
from tickflow.operators.metrics import auc, best_threshold, confusion, fbeta, fold_estimate, report
from tickflow.operators.neighbours import neighbour_table, share
from tickflow.order import DAY_ORDER, Order, before_key, keys_at
from tickflow.runtime import stored_bytes, together, written

KEY = ["date_trd", "trd_id"]
CLASSES = 100             # different targets, at most; more are a mistaken column
CALIBRATION_FOLDS = 3
KEPT_BYTES = 1 << 30      # rows of a machine up to which it is fitted to all rows and without each third at a time

# names of the boosting settings in use elsewhere
_BOOSTING_NAMES = {"maxIter": "trees", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "row_share"}


# --- folds and weights -------------------------------------------------------------------

def contiguous_folds(df: DataFrame, y: str, k: int, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``fold`` 0..k-1: per class, k consecutive and nearly equal stretches.

    The limits of the stretches are found from block counts; rows are not shuffled.
    """
    sizes = {r[y]: r["n"] for r in few_classes(df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n")), y)}
    ranks = {}
    for label, n in sizes.items():
        starts = [i * (n // k) + min(i, n % k) for i in range(1, k)]
        ranks[label] = [s for s in starts if s < n]
    limits = keys_at(df, ranks, group=y, order=order)
    fold = F.lit(None).cast("long")
    for label in sizes:
        position = F.lit(0).cast("long")
        for rank in ranks[label]:
            position = position + (~before_key(limits[label, rank], order)).cast("long")
        fold = F.when(F.col(y) == label, position).otherwise(fold)
    return df.withColumn("fold", fold)


def few_classes(table: DataFrame, y: str) -> list:
    """Rows of a table with one row per class, after a check that there are not too many."""
    rows = table.limit(CLASSES + 1).collect()
    if len(rows) > CLASSES:
        raise ValueError(f"{y} has more than {CLASSES} different values and is no class")
    return rows


def with_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """Balanced class weight as a column; one literal per class."""
    weight = F.lit(None).cast("double")
    for r in few_classes(class_weights(df, y), y):
        weight = F.when(F.col(y) == r[y], float(r["weight"])).otherwise(weight)
    return df.withColumn(out, weight)


# --- classifiers -------------------------------------------------------------------------

@dataclass(frozen=True)
class Features:
    """How named columns become the feature vector: as they are, or by random Fourier features."""

    columns: tuple[str, ...]
    gamma: float | None = None
    components: int = 64
    seed: int = 1

    def apply(self, df: DataFrame) -> DataFrame:
        if self.gamma is None:
            return VectorAssembler(inputCols=list(self.columns), outputCol="features").transform(df)
        return _fourier(self.columns, self.gamma, self.components, self.seed)(df)


@dataclass
class Fitted:
    """A trained classifier over named columns; ``score`` adds ``prob``."""

    columns: list[str]
    model: object
    features: Features
    calibration: object = None

    def score(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        out = self.model.transform(self.features.apply(df))
        if self.calibration is not None:
            out = self.calibration.transform(_margin(out).drop("rawPrediction", "prediction"))
        return out.select(*kept, vector_to_array("probability")[1].alias("prob"))

    def importances(self) -> dict[str, float]:
        """Tree importances, or coefficients of a linear model."""
        values = (self.model.featureImportances if hasattr(self.model, "featureImportances")
                  else self.model.coefficients)
        return dict(zip(self.columns, [float(v) for v in values.toArray()]))

    def save(self, path: str) -> None:
        """Write the model, its calibration and its feature rule below ``path``, which must not exist."""
        self.model.write().save(f"{path}/model")
        if self.calibration is not None:
            self.calibration.write().save(f"{path}/calibration")
        kind = type(self.model)
        rule = {"class": f"{kind.__module__}.{kind.__name__}", "columns": self.columns,
                "calibrated": self.calibration is not None, "gamma": self.features.gamma,
                "components": self.features.components, "seed": self.features.seed}
        write_note(SparkSession.active(), f"{path}/features", rule)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Fitted":
        """Any saved classifier."""
        rule = read_note(spark, f"{path}/features")
        if rule["class"] in _OWN:
            return _OWN[rule["class"]].of_note(spark, path, rule)
        module, name = rule["class"].rsplit(".", 1)
        if module != "pyspark.ml.classification":
            raise ValueError(f"{path} holds no classifier")
        model = getattr(classification, name).load(f"{path}/model")
        calibration = LogisticRegressionModel.load(f"{path}/calibration") if rule["calibrated"] else None
        features = Features(tuple(rule["columns"]), rule["gamma"], rule["components"], rule["seed"])
        return Fitted(rule["columns"], model, features, calibration)


    def plain(self):
        """Function from an array of feature rows to probabilities, without Spark; None where there is no such form."""
        if not hasattr(self.model, "coefficients"):
            return None
        weights, intercept = self.model.coefficients.toArray(), self.model.intercept
        slope, offset = 1.0, 0.0
        if self.calibration is not None:
            slope, offset = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        rule = self.features

        def prob(x: np.ndarray) -> np.ndarray:
            if rule.gamma is not None:
                w, b, scale = _fourier_terms(len(rule.columns), rule.gamma, rule.components, rule.seed)
                x = scale * np.cos(x @ w + b)
            return 1 / (1 + np.exp(-(slope * (x @ weights + intercept) + offset)))
        return prob


@dataclass
class LinearFitted:
    """A linear classifier from shared passes; the probability is a logistic of slope * margin + offset."""

    columns: list[str]
    weights: list[float]
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self) -> str:
        """SQL text of the margin."""
        terms = [f"`{c}` * {float(w)!r}D" for c, w in zip(self.columns, self.weights) if w]
        return " + ".join([f"{float(self.intercept)!r}D", *terms])

    def score(self, df: DataFrame) -> DataFrame:
        z = f"{float(self.slope)!r}D * ({self.margin()}) + {float(self.offset)!r}D"
        return df.select("*", F.expr(f"1 / (1 + exp(-({z})))").alias("prob"))

    def importances(self) -> dict[str, float]:
        return dict(zip(self.columns, self.weights))

    def save(self, path: str) -> None:
        write_note(SparkSession.active(), f"{path}/features", {"class": "linear", **vars(self)})

    @staticmethod
    def of_note(spark: SparkSession, path: str, note: dict) -> "LinearFitted":
        return LinearFitted(**{k: v for k, v in note.items() if k != "class"})

    def plain(self):
        weights, intercept, slope, offset = np.array(self.weights), self.intercept, self.slope, self.offset
        return lambda x: 1 / (1 + np.exp(-(slope * (x @ weights + intercept) + offset)))


@dataclass
class BoostedFitted:
    """Second-order boosted trees as a classifier."""

    model: Boosted

    @property
    def columns(self) -> list[str]:
        return self.model.columns

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.score(df)

    def importances(self) -> dict[str, float]:
        return self.model.importances()

    def save(self, path: str) -> None:
        write_note(SparkSession.active(), f"{path}/features", {"class": "boosted", "model": self.model.note()})

    @staticmethod
    def of_note(spark: SparkSession, path: str, note: dict) -> "BoostedFitted":
        return BoostedFitted(Boosted.of_note(note["model"]))

    def plain(self):
        return self.model.plain()


@dataclass
class NeighbourFitted:
    """Votes of the nearest rows of a written table; rows to score are known by KEY."""

    columns: list[str]
    k: int
    weights: str
    metric: str
    rows: DataFrame

    def score(self, df: DataFrame) -> DataFrame:
        asked = df.select(*KEY, F.array(*self.columns).alias("_v"))
        table = neighbour_table(self.rows, asked, self.k, KEY, "_v", "y", self.metric)
        return df.join(table.select(*KEY, share(self.k, self.weights).alias("prob")), KEY, "left").select(*df.columns, "prob")

    def save(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        write_note(SparkSession.active(), f"{path}/features", {"class": "neighbours", "columns": self.columns, "k": self.k,
                                                               "weights": self.weights, "metric": self.metric})

    @staticmethod
    def of_note(spark: SparkSession, path: str, note: dict) -> "NeighbourFitted":
        own = {k: v for k, v in note.items() if k != "class"}
        return NeighbourFitted(**own, rows=spark.read.parquet(f"{path}/rows"))


_OWN = {"linear": LinearFitted, "boosted": BoostedFitted, "neighbours": NeighbourFitted}


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """A few settings as one JSON line, written where the models are."""
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(path)


def read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def _fourier(columns: Sequence[str], gamma: float, components: int,
             seed: int) -> Callable[[DataFrame], DataFrame]:
    """Random features whose inner products approximate exp(-gamma |a - b|^2)."""
    w, b, scale = _fourier_terms(len(columns), gamma, components, seed)

    # as expressions the terms outgrow one generated method; here a batch is one matrix product
    @F.pandas_udf("array<double>")
    def project(*xs: pd.Series) -> pd.Series:
        return pd.Series(list(scale * np.cos(np.column_stack(xs) @ w + b)))

    return lambda df: df.withColumn("features", array_to_vector(project(*columns)))


def _fourier_terms(columns: int, gamma: float, components: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (columns, components))
    return w, rng.uniform(0.0, 2 * math.pi, components), math.sqrt(2.0 / components)


def _margin(df: DataFrame) -> DataFrame:
    return df.withColumn("_margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))


def _binary(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn("label", F.col(y).cast("double"))


def fit_classifier(family: str, df: DataFrame, columns: Sequence[str], y: str = "y",
                   balanced: bool = False, seed: int = 1, **params):
    """Train one of: logit, rf, gbt, svm (RBF), linear_svm (L1, squared hinge), mlp, knn.

    ``C`` weighs the summed loss against the penalty; Spark averages the loss, so it becomes
    a regularisation of 1 / (C * rows). The probabilities of the machines come from margins of rows that
    the machine was not fitted on.
    """
    columns = list(columns)
    if family == "knn":
        return _fit_neighbours(df, columns, y, **params)
    if family == "gbt":
        settings = {_BOOSTING_NAMES.get(k, k): v for k, v in params.items()}
        if balanced:
            n = {r[y]: r["count"] for r in few_classes(df.groupBy(y).count(), y)}
            settings["positive_weight"] = n.get(0, 0) / max(n.get(1, 0), 1) or 1.0
        return BoostedFitted(fit_boosted(df, columns, y, Boosting(**{"seed": seed, **settings})))
    if family == "linear_svm":
        return _fit_linear_svm(df, columns, y, balanced, **params)
    if "C" in params:
        params["regParam"] = 1.0 / (params.pop("C") * df.count())
    components = params.pop("components", 64)
    gamma = params.pop("gamma", 1.0 / max(len(columns), 1))
    features = Features(tuple(columns), gamma if family == "svm" else None, components, seed)
    data = features.apply(_binary(with_weights(df, y) if balanced else df, y))
    weight = {"weightCol": "weight"} if balanced and family != "mlp" else {}
    if family == "logit":
        model = LogisticRegression(**weight, **params)
    elif family == "rf":
        model = RandomForestClassifier(seed=seed, **weight, **params)
    elif family == "svm":
        model = LinearSVC(**weight, **params)
    elif family == "mlp":
        hidden = list(params.pop("hidden", (8,)))
        model = MultilayerPerceptronClassifier(layers=[len(columns), *hidden, 2], seed=seed, **params)
    else:
        raise ValueError(f"unknown family {family!r}")
    if family != "svm":
        return Fitted(columns, model.fit(data), features)
    # each third is judged by a machine that has not seen it
    data = written(data.select("label", "features", *weight.values()).withColumn("_part", _part("features")), "svm-rows")

    def held(i: int | None):
        fitted = model.fit(data if i is None else data.where(F.col("_part") != i))
        return fitted, None if i is None else _margin(fitted.transform(data.where(F.col("_part") == i))).select("label", "_margin")

    # each fit keeps its rows on the executors' disks while it lasts, so that large ones follow each other
    (fitted, _), *parts = together(held, [None, *range(CALIBRATION_FOLDS)], 4 if stored_bytes(data) <= KEPT_BYTES else 1)
    margins = parts[0][1]
    for _, m in parts[1:]:
        margins = margins.unionByName(m)
    calibration = LogisticRegression(featuresCol="_margin").fit(written(margins, "margins"))
    return Fitted(columns, fitted, features, calibration)


def _part(*columns: str):
    """Third of a row by a hash of its features, so that equal rows stay together."""
    return F.pmod(F.xxhash64(*columns), F.lit(CALIBRATION_FOLDS)).cast("int")


def _fit_linear_svm(df: DataFrame, columns: list[str], y: str, balanced: bool, C: float | None = None,
                    regParam: float | None = None, maxIter: int = 60) -> LinearFitted:
    """Squared hinge with an L1 penalty of 1 / C on the summed loss; all rows and the three thirds share passes."""
    parted = df.select(y, *columns).withColumn("_part", _part(*columns))
    blocks = Blocks(parted, columns, y, "_part")
    l1 = 1.0 / C if C is not None else (0.01 if regParam is None else regParam) * sum(blocks.counts.values())
    everything = tuple(range(len(columns)))
    fits = [Fit(everything, held, l1=l1, balanced=balanced, loss="squared_hinge") for held in [None, *range(CALIBRATION_FOLDS)]]
    whole, *parts = fit_all(blocks, fits, most=maxIter)
    out = linear_model(columns, whole)
    margin = F.lit(None).cast("double")
    for i, s in enumerate(parts):
        margin = F.when(F.col("_part") == i, F.expr(linear_model(columns, s).margin())).otherwise(margin)
    found = fit_all(Blocks(parted.select(y, margin.alias("_margin")), ["_margin"], y), [Fit((0,), l2=0.01)])[0]
    out.slope, out.offset = float(found.beta[0]), float(found.beta[1])
    return out


def linear_model(columns: Sequence[str], state: State) -> LinearFitted:
    return LinearFitted(list(columns), [float(v) for v in state.beta[:-1]], float(state.beta[-1]))


def _fit_neighbours(df: DataFrame, columns: list[str], y: str, n_neighbors: int = 5, weights: str = "uniform",
                    metric: str = "euclidean") -> NeighbourFitted:
    rows = written(df.where(F.col(y).isNotNull()).select(*KEY, F.array(*columns).alias("_v"), F.col(y).cast("double").alias("y")),
                   "knn-train")
    return NeighbourFitted(columns, n_neighbors, weights, metric, rows)


def area(df: DataFrame, y: str = "y", prob: str = "prob") -> float:
    """Exact ROC AUC, ties counted half; NaN where only one class is present."""
    scores = df.select(F.col(y).cast("long").alias("y"), F.col(prob).alias("prob"))
    value = auc(written(scores, "scores")).first()
    return float("nan") if value is None or value["auc"] is None else value["auc"]


def importance_table(spark: SparkSession, fitted: Fitted, absolute: bool = False) -> DataFrame:
    """(cols, importance), largest first; coefficients are ordered by size."""
    rows = sorted(fitted.importances().items(), key=lambda r: (-(abs(r[1]) if absolute else r[1]), r[0]))
    return spark.createDataFrame(rows, "cols string, importance double")


def principal_components(df: DataFrame, vector: str, k: int, out: str = "components") -> DataFrame:
    """Scores on the first k principal components of a centred vector column."""
    centred = StandardScaler(inputCol=vector, outputCol="_centred", withMean=True, withStd=False).fit(df)
    data = centred.transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol=out).fit(data)
    return model.transform(data).drop("_centred")


# --- validation and search ---------------------------------------------------------------

def qualities(scored: DataFrame, by: Sequence[str], y: str = "y", scoring: str | tuple = "auc") -> DataFrame:
    """(by..., quality) of a written table of scores: AUC, or ("fbeta", beta) of the predictions above 0.5."""
    if scoring == "auc":
        return auc(scored.withColumn(y, F.col(y).cast("long")), y, "prob", by).withColumnRenamed("auc", "quality")
    kind, beta = scoring
    if kind != "fbeta":
        raise ValueError(f"unknown scoring {scoring!r}")
    cells = confusion(scored.withColumn("yhat", (F.col("prob") > 0.5).cast("int")), y, by=by)
    return cells.select(*by, fbeta(beta).alias("quality"))


def quality(df: DataFrame, y: str = "y", scoring: str | tuple = "auc") -> float:
    """One number for a frame of scores; NaN where only one class is present and the area is asked."""
    if scoring == "auc":
        return area(df, y)
    value = qualities(df.select(y, "prob", F.lit(0).alias("_one")), ["_one"], y, scoring).first()
    return float("nan") if value is None else value["quality"]


def cross_validate(family: str, folds: DataFrame, columns: Sequence[str], k: int, y: str = "y",
                   train_scores: bool = True, scoring: str | tuple = "auc", **params) -> list[tuple[float | None, float]]:
    """(train, test) quality per fold; ``folds`` has ``fold`` and should be a written table."""
    def one(i: int) -> tuple[float | None, float]:
        train, test = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        fitted = fit_classifier(family, train, columns, y, **params)
        return (quality(fitted.score(train), y, scoring) if train_scores else None,
                quality(fitted.score(test), y, scoring))
    return together(one, range(k))


def _validate_linear(folds: DataFrame, columns: Sequence[str], k: int, y: str, tried: list[dict]) -> list[tuple]:
    """(draw, train AUC, test AUC) per draw and fold of logistic models; all of them share their passes."""
    blocks = Blocks(folds, columns, y, "fold")
    everything = tuple(range(len(columns)))
    fits = [Fit(everything, fold, l1=p.get("elasticNetParam", 1.0) / p["C"], l2=(1 - p.get("elasticNetParam", 1.0)) / p["C"],
                balanced=p.get("balanced", False)) for p in tried for fold in range(k)]
    states = fit_all(blocks, fits, tolerance=1e-6, most=max(p.get("maxIter", 30) for p in tried))
    return [(i // k, s.train_auc, s.auc) for i, s in enumerate(states)]


def _validate_neighbours(folds: DataFrame, columns: Sequence[str], k: int, y: str, tried: list[dict],
                         scoring: str | tuple = "auc") -> list[tuple]:
    """(draw, train, test quality) per draw and fold of neighbour votes, from one search per metric and fold.

    Every row is held against every other row once: its nearest rows within each fold give those that are nearest when a
    fold is left out, for test and training rows alike; all numbers of neighbours and both weightings read from them.
    """
    rows = written(folds.select(*KEY, F.col(y).alias("y"), "fold", F.array(*columns).alias("_v")), "knn-known")
    groups = [F.col("fold") == f for f in range(k)] + [F.col("fold").isNull()] * (not rows.where("fold is null").isEmpty())
    out = {}
    for metric in sorted({p.get("metric", "euclidean") for p in tried}):
        draws = [(i, p) for i, p in enumerate(tried) if p.get("metric", "euclidean") == metric]
        most = max(p["n_neighbors"] for _, p in draws)

        def within(f: int) -> DataFrame:
            table = neighbour_table(rows.where(groups[f]), rows, most, KEY, "_v", "y", metric)
            return table.select(*KEY, F.struct(F.lit(f).alias("of"), "neighbours").alias("near"))

        parts = together(within, range(len(groups)))
        near = parts[0]
        for part in parts[1:]:
            near = near.unionByName(part)
        found = near.groupBy(*KEY).agg(F.collect_list("near").alias("near")).select(
            *KEY, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("left_out"), "near").select(*KEY, "left_out", F.expr(
                f"slice(sort_array(flatten(transform(filter(near, n -> n.of <> left_out), n -> n.neighbours))), 1, {most})").alias("neighbours"))
        probs = F.array(*[F.struct(F.lit(i).alias("draw"), share(p["n_neighbors"], p.get("weights", "uniform")).alias("prob"))
                          for i, p in draws])
        scored = found.join(rows.select(*KEY, "y", "fold"), KEY).withColumn("test", F.col("fold") == F.col("left_out"))
        scored = written(scored.select("left_out", "y", "test", F.explode(probs).alias("p")).select(
            "left_out", "y", "test", "p.draw", "p.prob"), "knn-scored")
        for r in qualities(scored, ["draw", "left_out", "test"], "y", scoring).collect():      # draws x folds x 2
            out[r["draw"], r["left_out"], r["test"]] = r["quality"]
    return [(i, out.get((i, f, False)), out.get((i, f, True))) for i in range(len(tried)) for f in range(k)]


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def draw_params(family: str, rng: random.Random) -> dict:
    """One draw from the family's search range."""
    if family not in C.SEARCH_SPACES:
        raise ValueError(f"unknown family {family!r}")
    out = {}
    for name, space in C.SEARCH_SPACES[family].items():
        if isinstance(space, list):
            out[name] = rng.choice(space)
        elif isinstance(space, tuple):
            out[name] = _log_uniform(rng, *space)
        else:
            out[name] = space
    if family == "mlp":
        out["hidden"] = tuple(2 ** rng.randint(*C.MLP_LAYER_POWERS) for _ in range(rng.randint(*C.MLP_LAYERS)))
    return out


@dataclass
class Search:
    family: str
    scores: DataFrame
    best: dict
    best_score: float
    rows: list = field(default_factory=list)
    train_score: float | None = None


def search_random(family: str, df: DataFrame, columns: Sequence[str], y: str = "y", draws: int = 10,
                  k: int = 5, seed: int = 0, fixed: dict | None = None, order: Order = DAY_ORDER,
                  scoring: str | tuple = "auc") -> Search:
    """Random search: ``draws`` parameter sets by k-fold AUC, or by another ``scoring``.

    ``scores`` has one row per draw with mean, deviation and the penalised estimate. Logistic models are all
    fitted in shared passes, neighbours are searched once for all draws; other families fit fold by fold.
    """
    rng = random.Random(seed)
    folds = written(contiguous_folds(df.select(*KEY, y, *columns), y, k, order), "folds")
    tried = [{**draw_params(family, rng), **(fixed or {})} for _ in range(draws)]
    if family == "knn":
        rows = _validate_neighbours(folds, columns, k, y, tried, scoring)
    elif family == "logit" and scoring == "auc":
        rows = _validate_linear(folds, columns, k, y, tried)
    else:
        rows = [(i, a, b) for i, params in enumerate(tried)
                for a, b in cross_validate(family, folds, columns, k, y, scoring=scoring, **params)]
    table = df.sparkSession.createDataFrame([(i, a, b) for i, a, b in rows], "draw int, train_score double, test_score double")
    named = df.sparkSession.createDataFrame(
        [(i, str(sorted(p.items()))) for i, p in enumerate(tried)], "draw int, params string")
    scores = fold_estimate(table, 3.0, 2.0, by=["draw"]).join(named, "draw")
    top = scores.orderBy(F.desc("mean_test"), "draw").first()
    return Search(family, scores, tried[top["draw"]], top["mean_test"], rows, top["mean_train"])


def model_compare(train: DataFrame, test: DataFrame, columns: Sequence[str], families: Sequence[str],
                  y: str = "y", draws: int = 10, k: int = 5, seed: int = 0,
                  fixed: dict[str, dict] | None = None) -> DataFrame:
    """One row per family: search, refit with the best parameters, report on both splits.

    Besides the report: the features, the best draw's cross-validated quality on training and held rows, and
    `th_test`, the best threshold of the test split itself.
    """
    out = None
    for family in families:
        found = search_random(family, train, columns, y, draws, k, seed, (fixed or {}).get(family))
        best = fit_classifier(family, train, columns, y, **found.best)
        scored = [written(best.score(part).select(y, "prob"), "scored") for part in (train, test)]
        row = report(*scored, y).select(
            F.lit(family).alias("model_type"), F.lit(",".join(columns)).alias("features"),
            F.lit(found.train_score).cast("double").alias("score_train_cv"), F.lit(found.best_score).alias("score_test_cv"), "*",
            F.lit(best_threshold(scored[1], y).first()["th"]).alias("th_test"),
            F.lit(str(sorted(found.best.items()))).alias("best_params"))
        out = row if out is None else out.unionByName(row)
    return out


# --- stacking and scoring by regime --------------------------------------------------------

@dataclass(frozen=True)
class Base:
    """One member of a stack."""

    name: str
    family: str
    columns: tuple
    params: dict


@dataclass
class Stack:
    bases: list[tuple[str, object]]
    meta: object

    def score(self, df: DataFrame) -> DataFrame:
        return self.meta.score(base_scores(df, self.bases))

    def save(self, path: str) -> None:
        for name, base in self.bases:
            base.save(f"{path}/{name}")
        self.meta.save(f"{path}/meta-model")
        write_note(SparkSession.active(), f"{path}/stack", {"bases": [name for name, _ in self.bases]})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Stack":
        names = read_note(spark, f"{path}/stack")["bases"]
        return Stack([(n, Fitted.load(spark, f"{path}/{n}")) for n in names], Fitted.load(spark, f"{path}/meta-model"))


def base_scores(df: DataFrame, bases: Sequence[tuple[str, object]]) -> DataFrame:
    """One column per base. Bases that work row by row share a pass; neighbour bases join theirs."""
    out = df
    for name, base in bases:
        out = base.score(out).withColumnRenamed("prob", name)
    return out


def out_of_fold(folds: DataFrame, bases: Sequence[Base], y: str, k: int) -> DataFrame:
    """KEY, y and one column per base: scores of each row by bases that were fitted without its fold.

    All bases of a fold score in one pass; a neighbour base needs one search for all folds.
    """
    fitted_bases = [b for b in bases if b.family != "knn"]
    # fits of all folds are submitted together: most of their time is the start of small jobs
    fits = together(lambda own: fit_classifier(own[1].family, folds.where(F.col("fold") != own[0]), own[1].columns, y, **own[1].params),
                    [(i, b) for i in range(k) for b in fitted_bases])
    out = None
    for i in range(k):
        own = [(b.name, fits[i * len(fitted_bases) + j]) for j, b in enumerate(fitted_bases)]
        part = base_scores(folds.where(F.col("fold") == i), own).select(*KEY, F.col(y).alias("y"), *[b.name for b in fitted_bases])
        out = part if out is None else out.unionByName(part)
    for b in bases:
        if b.family == "knn":
            own = {"n_neighbors": 5, "weights": "uniform", "metric": "euclidean", **b.params}
            rows = folds.select(*KEY, F.col(y).alias("y"), "fold", F.array(*b.columns).alias("_v"))
            table = neighbour_table(rows, rows, own["n_neighbors"], KEY, "_v", "y", own["metric"], fold="fold")
            out = out.join(table.select(*KEY, share(own["n_neighbors"], own["weights"]).alias(b.name)), KEY)
    return out.select(*KEY, "y", *[b.name for b in bases])


def fit_meta(oof: DataFrame, names: Sequence[str], meta: str = "logit", meta_params: dict | None = None):
    """The model on top. With ``C`` it is the L1 logistic regression of the shared passes."""
    params = meta_params or {"regParam": 0.01, "elasticNetParam": 1.0, "balanced": True}
    if meta == "logit" and "C" in params:
        fit = Fit(tuple(range(len(names))), l1=1.0 / params["C"], balanced=params.get("balanced", True))
        return linear_model(names, fit_all(Blocks(oof, names, "y"), [fit])[0])
    return fit_classifier(meta, oof, names, "y", **params)


def fit_stack(train: DataFrame, bases: Sequence[Base], y: str = "y", k: int = 3, meta: str = "logit",
              meta_params: dict | None = None, order: Order = DAY_ORDER) -> Stack:
    """Out-of-fold probability of each base as one column, a meta model on top, and the
    bases refitted on all training rows."""
    folds = written(contiguous_folds(train, y, k, order), "folds")
    oof = written(out_of_fold(folds, bases, y, k), "oof")
    top = fit_meta(oof, [b.name for b in bases], meta, meta_params)
    refits = together(lambda b: fit_classifier(b.family, folds, b.columns, y, **b.params), bases)
    return Stack([(b.name, fitted) for b, fitted in zip(bases, refits)], top)


def nested_scores(train: DataFrame, bases: Sequence[Base], y: str = "y", outer: int = 4, inner: int = 3,
                  order: Order = DAY_ORDER) -> DataFrame:
    """Written (outer, role, y, one column per base): what a cross-validation of the whole stack needs of its bases.

    For each outer fold: `fit` rows have out-of-fold scores within the other folds, `train` rows the scores of bases
    refitted on those, `test` rows the scores of the same bases on the fold itself.
    """
    names = [b.name for b in bases]
    whole = written(contiguous_folds(train, y, outer, order).withColumnRenamed("fold", "outer"), "outer-folds")
    parts = []
    for o in range(outer):
        rest, held = whole.where(F.col("outer") != o).drop("outer"), whole.where(F.col("outer") == o).drop("outer")
        folds = written(contiguous_folds(rest, y, inner, order), "inner-folds")
        refits = [(b.name, fit_classifier(b.family, folds, b.columns, y, **b.params)) for b in bases]
        sides = [("fit", out_of_fold(folds, bases, y, inner)),
                 *[(role, base_scores(rows, refits).select(*KEY, F.col(y).alias("y"), *names))
                   for role, rows in (("train", rest), ("test", held))]]
        parts += [part.select(F.lit(o).alias("outer"), F.lit(role).alias("role"), F.col("y").cast("long").alias("y"), *names)
                  for role, part in sides]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return written(out, "nested")


def search_stack(train: DataFrame, bases: Sequence[Base], y: str = "y", draws: int = 10, seed: int = 0, outer: int = 4,
                 inner: int = 3, scoring: str | tuple = ("fbeta", 0.5), order: Order = DAY_ORDER,
                 nested: DataFrame | None = None) -> Search:
    """Random search for the meta model's penalty by cross-validating the whole stack.

    The scores of the bases are computed once; all draws are fitted on them in shared passes and judged in one
    aggregation. The estimate is mean - std / 4 - |train - test| / 3.
    """
    names = [b.name for b in bases]
    stored = nested if nested is not None else nested_scores(train, bases, y, outer, inner, order)
    rng = random.Random(seed)
    tried = [{"C": _log_uniform(rng, *C.SEARCH_SPACES["logit"]["C"]), "balanced": True} for _ in range(draws)]
    blocks = Blocks(stored.where("role = 'fit'"), names, "y", "outer")
    everything = tuple(range(len(names)))
    states = fit_all(blocks, [Fit(everything, only=o, l1=1.0 / p["C"], balanced=True) for p in tried for o in range(outer)])
    spark = train.sparkSession
    table = spark.createDataFrame(
        [(i // outer, i % outer, [float(v) for v in s.beta[:-1]], float(s.beta[-1])) for i, s in enumerate(states)],
        "draw int, outer int, w array<double>, b double")                     # draws x folds rows
    margin = F.col("b")
    for i, name in enumerate(names):
        margin = margin + F.col(name) * F.col("w")[i]
    scored = written(stored.where("role <> 'fit'").join(F.broadcast(table), "outer").select(
        "draw", "outer", "role", "y", (1 / (1 + F.exp(-margin))).alias("prob")), "stack-scored")
    found = {(r["draw"], r["outer"], r["role"]): r["quality"]
             for r in qualities(scored, ["draw", "outer", "role"], "y", scoring).collect()}
    rows = [(i, found.get((i, o, "train")), found.get((i, o, "test"))) for i in range(draws) for o in range(outer)]
    folds = spark.createDataFrame(rows, "draw int, train_score double, test_score double")
    named = spark.createDataFrame([(i, str(sorted(p.items()))) for i, p in enumerate(tried)], "draw int, params string")
    scores = fold_estimate(folds, by=["draw"]).join(named, "draw")
    top = scores.orderBy(F.desc("estimate"), "draw").first()
    return Search("stack", scores, tried[top["draw"]], top["mean_test"], rows, top["mean_train"])


@dataclass
class RegimeModels:
    """One classifier and threshold per traded regime, fitted on one set of trades to score another."""

    models: dict[str, Fitted]
    thresholds: dict[str, float]

    def score(self, trades: DataFrame) -> DataFrame:
        """All trades with ``prob``; NULL where the regime has no model."""
        named = F.col("model").isin(list(self.models))
        out = trades.where(~named | F.col("model").isNull()).withColumn("prob", F.lit(None).cast("double"))
        for regime, fitted in self.models.items():
            out = out.unionByName(fitted.score(trades.where(F.col("model") == regime)))
        return out

    def save(self, path: str) -> None:
        for regime, fitted in self.models.items():
            fitted.save(f"{path}/{regime}")
        write_note(SparkSession.active(), f"{path}/thresholds",
                   {"thresholds": self.thresholds, "models": list(self.models)})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RegimeModels":
        note = read_note(spark, f"{path}/thresholds")
        return RegimeModels({m: Fitted.load(spark, f"{path}/{m}") for m in note["models"]}, note["thresholds"])


def fit_by_regime(train: DataFrame, columns: Sequence[str], y: str = "y", family: str = "logit",
                  params: dict | None = None, k: int = 5, order: Order = DAY_ORDER) -> RegimeModels:
    """One model per traded regime; its threshold is the best one on scores of held-out folds.

    A regime with one class, or with fewer rows of a class than folds, gets no model and the threshold 0.5.
    """
    found = RegimeModels({}, {m: 0.5 for m in C.REGIMES})
    for regime in C.TRADED_UP + C.TRADED_DOWN:
        rows = train.where((F.col("model") == regime) & F.col(y).isNotNull())
        sizes = [r["count"] for r in rows.groupBy(y).count().collect()]
        if len(sizes) < 2 or min(sizes) < k:
            continue
        folds = written(contiguous_folds(rows, y, k, order), "folds")
        held = None
        for i in range(k):
            fitted = fit_classifier(family, folds.where(F.col("fold") != i), columns, y, **(params or {}))
            part = fitted.score(folds.where(F.col("fold") == i)).select(y, "prob")
            held = part if held is None else held.unionByName(part)
        found.thresholds[regime] = best_threshold(written(held, "held"), y).first()["th"]
        found.models[regime] = fit_classifier(family, folds, columns, y, **(params or {}))
    return found


def predict_by_regime(train: DataFrame, test: DataFrame, columns: Sequence[str], y: str = "y",
                      family: str = "logit", params: dict | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Scores of the test trades by models that never saw them, and the threshold of each regime."""
    found = fit_by_regime(train, columns, y, family, params)
    return found.score(test), found.thresholds
