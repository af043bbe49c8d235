"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickflow.operators.regimes import regime_counts, tag_regimes, without_first_update
from tickflow.plans import labelling, modelling, preparation, storage, study, windows  # noqa: F401
from tickflow.plans.registry import ORACLES, QUERIES  # noqa: F401
from tickflow.plans.ticks import ticks


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime_counts(without_first_update(tag_regimes(ticks(spark, sf_dir))))
