"""Fitted preprocessing: ``fit_*`` learns a few numbers per column, ``apply_*`` projects.

The learned state is a small dictionary, so applying is a pure projection that Catalyst
folds into the scan's stage; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.functions.quantiles import between, order_statistics, profile, quantiles, unpivot
from tickflow.functions.scalars import (clip, inverse_power, number, replace_columns,
                                         right_closed_bin)
from tickflow.operators.features import difference_features, duplicate, log_volume
from tickflow.order import DAY_ORDER, Order, before_key, keys_at, lookup
from tickflow.runtime import written

NOT_FEATURES = [*C.KEY, "model", "y"]


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


# --- split -----------------------------------------------------------------------------

def split_key(df: DataFrame, test_share: float = 0.2, order: Order = DAY_ORDER) -> tuple | None:
    """(day, position) of the first test row of the ordered split without shuffling."""
    n = df.count()
    test = -int(-(n * test_share) // 1)
    if test == 0:
        return None
    return keys_at(df, {0: [n - test]}, order=order)[0, n - test]


def ordered_split(df: DataFrame, test_share: float = 0.2,
                  order: Order = DAY_ORDER) -> tuple[DataFrame, DataFrame]:
    key = split_key(df, test_share, order)
    if key is None:
        return df, df.where(F.lit(False))
    return df.where(before_key(key, order)), df.where(~before_key(key, order))


# --- imputation ------------------------------------------------------------------------

def impute_proportions(df: DataFrame) -> DataFrame:
    """1 / 14^exponent for the resting-order columns that are present."""
    return replace_columns(df, {c: f"coalesce(`{c}`, {inverse_power(14, e)})"
                                for key, e in C.PROP_EXPONENTS.items() for c in C.prop_names(key)})


def fit_median(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in quantiles(df, {c: [0.5] for c in columns}).items()}


def fill(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return replace_columns(df, {c: f"coalesce(`{c}`, {number(v)})"
                                for c, v in values.items() if v is not None})


# --- caps and scales -------------------------------------------------------------------

def cap_folds(columns: Sequence[str]) -> dict[str, float]:
    """Fold per column: the listed groups, and the default for all others."""
    special = {c: fold for fold, cs in C.CAP_FOLDS.items() for c in cs}
    return {c: special.get(c, C.CAP_DEFAULT) for c in columns}


def fit_caps(df: DataFrame, folds: dict[str, float]) -> dict[str, tuple[float, float]]:
    found = quantiles(df, {c: [f, 1 - f] for c, f in folds.items()})
    return {c: (q[0], q[1]) for c, q in found.items() if q[0] is not None}


def capped_statistics(df: DataFrame, folds: dict[str, float],
                      probs: dict[str, list[float]]) -> tuple[dict[str, tuple[float, float]], dict[str, list[float]]]:
    """Caps, and quantiles of the capped columns, from one set of scans.

    Capping is monotone, so the order statistics of a capped column are the capped ones of the raw column.
    """
    found = order_statistics(df, {c: [f, 1 - f, *probs.get(c, [])] for c, f in folds.items()})
    caps, inside = {}, {}
    for c, stats in found.items():
        if stats is None:
            continue
        low, high = caps[c] = between(*stats[0]), between(*stats[1])
        inside[c] = [between(min(max(a, low), high), min(max(b, low), high), share) for a, b, share in stats[2:]]
    return caps, inside


def apply_caps(df: DataFrame, caps: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(df, {c: clip(c, *b) for c, b in caps.items()})


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {c: (s["mean"], s["std"]) for c, s in profile(df, list(columns)).items()}


def z_score(column: str, mean: float | None, std: float | None) -> str:
    """(x - mean) / std; NULL when the spread is zero or unknown."""
    if mean is None or not std:
        return "cast(null as double)"
    return f"(`{column}` - {number(mean)}) / {number(std)}"


@dataclass(frozen=True)
class Norm:
    caps: dict[str, tuple[float, float]]
    moments: dict[str, tuple[float, float]]


def fit_robust_norm(df: DataFrame, columns: Sequence[str], fold: float = 0.001) -> Norm:
    """Caps at the tail quantiles; mean and deviation of the uncapped values."""
    return Norm(fit_caps(df, {c: fold for c in columns}), _moments(df, columns))


def fit_base_norm(df: DataFrame, columns: Sequence[str], fold: float = 0.001) -> Norm:
    """Caps at the tail quantiles; mean and deviation of the capped values."""
    caps = fit_caps(df, {c: fold for c in columns})
    return Norm(caps, _moments(apply_caps(df, caps), columns))


def apply_norm(df: DataFrame, norm: Norm, zero_nulls: bool = False) -> DataFrame:
    exprs = {c: z_score(c, *m) for c, m in norm.moments.items()}
    if zero_nulls:
        exprs = {c: f"coalesce({e}, 0D)" for c, e in exprs.items()}
    return replace_columns(apply_caps(df, norm.caps), exprs)


def fit_robust_scale(df: DataFrame, columns: Sequence[str], low: float = 0.10,
                     high: float = 0.90) -> dict[str, tuple[float, float]]:
    """Centre and width per column; the range is given in percent (0.10 is 0.1 %)."""
    found = quantiles(df, {c: [0.5, low / 100, high / 100] for c in columns})
    return {c: (q[0], (q[2] - q[1]) or 1.0) for c, q in found.items() if q[0] is not None}


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {c: (s["low"], (s["high"] - s["low"]) or 1.0)
            for c, s in profile(df, list(columns)).items() if s["n"]}


def apply_scale(df: DataFrame, scale: dict[str, tuple[float, float]], low: float = 0.0,
                high: float = 1.0) -> DataFrame:
    """(x - centre) / width, stretched to [low, high]."""
    def scaled(c: str, centre: float, width: float) -> str:
        unit = f"(`{c}` - {number(centre)}) / {number(width)}"
        return unit if (low, high) == (0.0, 1.0) else f"{unit} * {number(high - low)} + {number(low)}"
    return replace_columns(df, {c: scaled(c, *s) for c, s in scale.items()})


# --- bins and encodings ----------------------------------------------------------------

def fit_quantile_bins(df: DataFrame, bins: dict[str, int]) -> dict[str, list[float]]:
    """Distinct equal-frequency edges per column."""
    found = quantiles(df, {c: [k / q for k in range(q + 1)] for c, q in bins.items()})
    return {c: sorted(set(e)) for c, e in found.items() if e[0] is not None}


def apply_quantile_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    return replace_columns(df, {c: right_closed_bin(c, e, open_ends=True) for c, e in edges.items()})


def apply_arbitrary_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    return replace_columns(df, {c: right_closed_bin(c, e, lowest=False) for c, e in edges.items()})


def fit_mean_encoding(df: DataFrame, columns: Sequence[str], y: str = "y",
                      cast: str = "long") -> DataFrame:
    """(c, x, mean): mean target per column and category."""
    return (unpivot(df, list(columns), keep=[y], cast=cast).where("x is not null")
            .groupBy("c", "x").agg(F.avg(y).alias("mean")))


def apply_mean_encoding(df: DataFrame, encoding: DataFrame, columns: Sequence[str],
                        order: Order = DAY_ORDER, literal_rows: int = 5000) -> DataFrame:
    """Replace categories by their mean; unseen ones, and those whose mean is unknown, become NULL.

    The means of a short table travel in the projection, as one map per column; those of a longer one are
    joined per column. Either way a category has the same value, whatever its type.
    """
    known = encoding.where(F.col("c").isin(list(columns)) & F.col("x").isNotNull() & F.col("mean").isNotNull())
    head = known.limit(literal_rows + 1).collect()
    if len(head) <= literal_rows:
        key = dict(known.dtypes)["x"]
        exprs = {}
        for c in columns:
            pairs = [F.lit(v) for r in head if r["c"] == c for v in (r["x"], r["mean"])]
            exprs[c] = (F.try_element_at(F.create_map(*pairs), F.col(f"`{c}`").cast(key)) if pairs
                        else F.lit(None).cast("double"))
        return df.select(*[exprs[n].alias(n) if n in exprs else F.col(f"`{n}`") for n in df.columns])
    out = df
    for c in columns:
        table = known.where(F.col("c") == c).select(F.col("x").alias(c), F.col("mean").alias("_mean"))
        joined = lookup(out, table, [c], order)
        out = joined.select(*[F.col("_mean").alias(c) if n == c else F.col(f"`{n}`") for n in out.columns])
    return out


# --- composed steps --------------------------------------------------------------------

def dropped_columns(regime: str) -> list[str]:
    """One-sided columns; the weak regimes also lose the run-scoped ones."""
    common = C.SIDE_COLUMNS + ["smart_price", "sspread"]
    if regime.startswith("mw"):
        return common + C.AUX_SIDE_COLUMNS + C.AUX_OTHER_COLUMNS + C.AUX_DIFFERENCES
    return common + C.AUX_SIDE_COLUMNS + ["s_run", "n_p_aux"]


@dataclass(frozen=True)
class Preparation:
    """Impute, difference, take logarithms and drop; only the medians are learned."""

    regime: str
    medians: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fit(train: DataFrame, regime: str) -> "Preparation":
        return Preparation(regime, fit_median(train, C.MEDIAN_IMPUTED))

    def apply(self, df: DataFrame) -> DataFrame:
        out = fill(impute_proportions(df), self.medians)
        out = fill(out, {c: 0.0 for c in C.ZERO_IMPUTED})
        return log_volume(difference_features(out), C.LOG_COLUMNS).drop(*dropped_columns(self.regime))


@dataclass(frozen=True)
class ScaledView:
    """Cap, centre and scale by quantiles, stretch to [0, 1]."""

    caps: dict
    robust: dict
    minmax: dict

    @staticmethod
    def fit(train: DataFrame, low: float = 0.10, high: float = 0.90) -> "ScaledView":
        """Centre, width (between `low` and `high` percent) and ends of the capped columns, in one set of scans."""
        names = feature_names(train)
        caps, found = capped_statistics(train, cap_folds(names),
                                        {c: [0.5, low / 100, high / 100, 0.0, 1.0] for c in names})
        robust, minmax = {}, {}
        for c, (middle, left, right, least, most) in found.items():
            robust[c] = centre, spread = middle, (right - left) or 1.0
            # the ends of a column move with it under (x - centre) / width
            minmax[c] = (least - centre) / spread, ((most - least) or 1.0) / spread
        return ScaledView(caps, robust, minmax)

    def apply(self, df: DataFrame) -> DataFrame:
        return apply_scale(apply_scale(apply_caps(df, self.caps), self.robust), self.minmax)


def _renamed(state: dict, suffix: str) -> dict:
    return {c + suffix: v for c, v in state.items()}


@dataclass(frozen=True)
class BinnedView:
    """Drop, duplicate, cap and bin; with ``encoding`` the quantile bins become target means.

    As studied, only the quantile bins are mean-encoded; ``encode_all`` includes the
    hand-set bins.
    """

    caps: dict
    arbitrary: dict
    edges: dict
    encoding: DataFrame | None = None
    encoded: tuple = ()

    @staticmethod
    def start(df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return duplicate(df.drop(*C.NOT_BINNED), [c for c in C.DUPLICATED if c in present])

    @staticmethod
    def fit(train: DataFrame, mean_encode: bool = False, encode_all: bool = False) -> "BinnedView":
        start = BinnedView.start(train)
        names = feature_names(start)
        arbitrary = {c: e for c, e in C.ARBITRARY_BINS.items() if c in names}
        wanted = {c: q for q, cs in C.QUANTILE_BINS.items() for c in cs if c in names}
        caps, found = capped_statistics(start, {c: C.CAP_DEFAULT for c in names},
                                        {c: [k / q for k in range(q + 1)] for c, q in wanted.items()})
        edges = {c: sorted(set(found[c])) for c in wanted if c in found}
        view = BinnedView(caps, arbitrary, edges)
        if not mean_encode:
            return view
        encoded = tuple(edges) + (tuple(arbitrary) if encode_all else ())
        means = written(fit_mean_encoding(view.apply(train), encoded), "means")
        return BinnedView(caps, arbitrary, edges, means, encoded)

    def without_means(self) -> "BinnedView":
        return BinnedView(self.caps, self.arbitrary, self.edges)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.apply_started(self.start(df))

    def apply_started(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Steps after drop and duplicate, on the columns with ``suffix``."""
        capped = apply_caps(df, _renamed(self.caps, suffix))
        binned = apply_quantile_bins(apply_arbitrary_bins(capped, _renamed(self.arbitrary, suffix)),
                                     _renamed(self.edges, suffix))
        if self.encoding is None:
            return binned
        table = self.encoding.withColumn("c", F.concat("c", F.lit(suffix)))
        return apply_mean_encoding(binned, table, [c + suffix for c in self.encoded])


def wide_views(df: DataFrame, scaled: ScaledView, encoded: BinnedView, binned: BinnedView) -> DataFrame:
    """The three feature views side by side, ``_me`` and ``_d`` on clashing names.

    All views come from the same rows, so this is one projection where a join of the views
    on the key would shuffle every row twice.
    """
    names = df.columns
    members = feature_names(BinnedView.start(df))
    source = {c: c if c in names else c.removesuffix("_2") for c in members}
    wide = df.selectExpr(
        *[f"`{c}`" for c in names],
        *[f"`{source[c]}` as `{c}{suffix}`" for suffix in ("_me", "_d") for c in members])
    wide = binned.apply_started(encoded.apply_started(scaled.apply(wide), "_me"), "_d")
    return wide.selectExpr(*[f"`{c}` as `{c.removesuffix('_me')}`"
                             if c.endswith("_me") and c.removesuffix("_me") not in names else f"`{c}`"
                             for c in wide.columns])
