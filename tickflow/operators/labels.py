"""Forward-looking labels per directional run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow import constants as C
from tickflow.operators.regimes import without_first_update
from tickflow.order import DAY_ORDER, Order, group_edges, lookup, previous_row


@dataclass(frozen=True)
class LabelSpec:
    """kind: ``c_binary`` or ``regression``; dist: measure the move that is still to come;
    threshold: share of the day's frequency (percent) or points."""

    kind: str = "c_binary"
    dist: bool = False
    threshold: float = 0.6
    percent: bool = True
    custom_direction: bool = False

    def __post_init__(self):
        if self.kind not in ("c_binary", "regression"):
            raise ValueError(f"label type {self.kind!r} is not available")
        if not self.percent and self.threshold < 1:
            raise ValueError("a threshold below 1 needs percent=True; give the run size in points")

    def limit(self) -> Column:
        return F.col("freq") * self.threshold if self.percent else F.lit(int(self.threshold))

    def name(self, prefix: str) -> str:
        return (f"prefix_{prefix}_type_{self.kind}_th_{self.threshold}_dist_{self.dist}"
                f"_percent_{self.percent}_custom_{self.custom_direction}")


def run_high(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    return group_edges(df, "id_run", last={"run_high": "max_run"}, order=order)


def run_direction(df: DataFrame, spec: LabelSpec, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``run_high`` and ``d_run`` (1 when the whole run is directional)."""
    if spec.custom_direction:
        size = spec.limit() * (2 if spec.dist else 1)
        reached = F.coalesce(F.abs("run_high") >= size, F.lit(False))
        return run_high(df, order).withColumn("d_run", reached.cast("long"))
    return group_edges(df, "id_run", last={"run_high": "max_run", "d_run": "flag_d"}, order=order)


def _at_extreme() -> Column:
    return (F.col("s_run") != 0) & ((F.col("chg_max") == F.col("max_run"))
                                    | (F.col("chg_max_mp") == -F.col("max_run")))


def first_leg(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Add ``id_first_p``: the leg on which a directional run ideally starts."""
    starts = (F.col("d_run") == 1) & (F.col("id_run") > F.col("prev_id_run"))
    leg = F.when(starts, F.when(_at_extreme(), F.col("id_p")).otherwise(F.col("id_p") - 2))
    return previous_row(df, ["id_run"], order).withColumn("id_first_p", leg).drop("prev_id_run")


def first_leg_any_row(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """Exit-study variant: every row at the extreme counts, directional or not."""
    leg = (F.when(_at_extreme(), F.col("id_p"))
           .when(F.col("id_run") > F.col("prev_id_run"), F.col("id_p") - 2))
    return previous_row(df, ["id_run"], order).withColumn("id_first_p", leg).drop("prev_id_run")


def leg_highs(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    """One row per (day, first leg): the run extreme of its earliest row."""
    return (df.where("id_first_p is not null")
            .groupBy(order.part, F.col("id_first_p").alias("id_p"))
            .agg(F.min_by("run_high", order.pos).alias("run_high_dir")))


def join_leg_highs(df: DataFrame, order: Order = DAY_ORDER) -> DataFrame:
    return lookup(df, leg_highs(df, order), [order.part, "id_p"], order)


def label_frame(df: DataFrame, spec: LabelSpec, order: Order = DAY_ORDER) -> DataFrame:
    """Rows with run extreme, direction and leg extreme; the first update is dropped last."""
    return without_first_update(
        join_leg_highs(first_leg(run_direction(df, spec, order), order), order), order)


def _still_to_come() -> Column:
    """Run extreme minus where the run stands, which depends on the larger of two legs."""
    leg, previous_leg = F.abs("chg_max"), F.abs("chg_max_mp")
    reached = (F.when(leg >= previous_leg, F.col("max_run"))
               .when(leg < previous_leg,
                     F.col("max_run") + F.col("chg_max_mp") + F.col("chg_max")))
    return F.col("run_high") - reached


def expected_move(spec: LabelSpec) -> Column:
    """Price move the label is about: from an ideal start, or inside a running swing."""
    at_start = F.col("run_high_dir") - F.col("chg_max") if spec.dist else F.col("run_high_dir")
    on_the_way = _still_to_come() if spec.dist else F.col("run_high")
    running = (F.col("chg_max") * F.col("s_run") > 0) & (F.col("d_run") == 1)
    return F.when(F.col("run_high_dir").isNotNull(), at_start).when(running, on_the_way)


def label_value(spec: LabelSpec) -> Column:
    move = expected_move(spec)
    if spec.kind == "c_binary":
        y = (F.abs(move) >= spec.limit()).cast("double")
    elif spec.percent:
        y = F.when(F.col("freq") != 0, move / F.col("freq"))
    else:
        y = move
    return F.when(F.col("model").isNotNull(), F.coalesce(y, F.lit(0.0)))


def apply_label(df: DataFrame, spec: LabelSpec, order: Order = DAY_ORDER) -> DataFrame:
    return label_frame(df, spec, order).withColumn("y", label_value(spec))


def export_label(labelled: DataFrame, regime: str | None = None) -> DataFrame:
    """Key, ``model`` and ``y`` of the rows with a regime."""
    out = labelled.where("model is not null").select(*C.KEY, "model", "y")
    return out.where(F.col("model") == regime) if regime else out


def exit_label(df: DataFrame, order: Order = DAY_ORDER,
               spec: LabelSpec | None = None) -> DataFrame:
    """Exit-study label: distance to the run extreme for every row with a regime."""
    spec = spec or LabelSpec("regression", dist=True, threshold=0.3)
    framed = join_leg_highs(first_leg_any_row(run_direction(df, spec, order), order), order)
    y = F.when(F.col("run_high_dir").isNotNull(), F.col("run_high_dir") - F.col("chg_max")) \
        .otherwise(_still_to_come())
    return framed.withColumn("y", F.when(F.col("model").isNotNull(), y))
