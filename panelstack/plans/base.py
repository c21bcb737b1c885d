"""Wide panels and the flagship plan (naive forecast quality by region type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import model_family, region_scale
from ..operators.features import add_lags, drop_missing, interpolate, lag_name, require_history
from ..operators.metrics import metrics_by_region_type
from ..operators.reshape import pivot_variables
from ..sources import panels

KEYS = list(panels.KEYS)
VARS = [v.lower() for v in panels.VARIABLES]
TARGETS = [v.lower() for v in panels.TARGETS]
INPUTS = [v.lower() for v in panels.INPUTS]
POP = panels.POPULATION.lower()


def yearly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_variables(panels.panel_yearly(spark, sf_dir), panels.VARIABLES, KEYS)


def quarterly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_variables(panels.panel_quarterly(spark, sf_dir), panels.VARIABLES, KEYS)


def ragged_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_variables(panels.panel_ragged(spark, sf_dir), panels.VARIABLES, KEYS)


def with_dims(wide: DataFrame) -> DataFrame:
    """Add model family and region scale."""
    return wide.select("*", model_family("model").alias("model_family"),
                       region_scale("region").alias("region_scale"))


def naive_forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good is last year's value as a forecast of this year's, by region type?

    panel -> family -> interpolate targets -> lag 1 -> drop first row ->
    drop rows without targets -> metrics overall and per region type.
    """
    wide = with_dims(yearly_wide(spark, sf_dir))
    filled = interpolate(wide, TARGETS, KEYS)
    lagged = require_history(add_lags(filled, TARGETS, 1, KEYS), 1, KEYS)
    prevs = [lag_name(t, 1) for t in TARGETS]
    clean = drop_missing(lagged, TARGETS + prevs)
    return metrics_by_region_type(clean, TARGETS, prevs)
