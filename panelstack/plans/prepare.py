"""Feature preparation pipelines (tabular and sequence models)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import features as D


def prepare_tabular(panel: DataFrame, targets: Sequence[str], keys: Sequence[str],
                    time: str = "year", n_lags: int = 2, lag_required: bool = True,
                    population: str | None = None, normalise_by_population: bool = False,
                    interpolate_targets: bool = True) -> DataFrame:
    """(population ->) interpolate -> lags -> drop rows without history -> drop missing targets."""
    df = panel
    if normalise_by_population and population:
        df = D.interpolate(df, [population], keys, time)
        df = D.per_capita(df, targets, population)
    if interpolate_targets:
        df = D.interpolate(df, targets, keys, time)
    df = D.add_lags(df, targets, n_lags, keys, time)
    if lag_required:
        df = D.require_history(df, n_lags, keys, time)
    return D.drop_missing(df, targets)


def prepare_sequence(panel: DataFrame, targets: Sequence[str], keys: Sequence[str],
                     time: str = "year", n_lags: int = 2, lag_required: bool = True,
                     min_context_length: int = 0, **kw) -> DataFrame:
    """prepare_tabular + step and delta time on the kept rows (+ minimum context)."""
    df = prepare_tabular(panel, targets, keys, time, n_lags, lag_required, **kw)
    df = D.add_step_and_delta(df, keys, time)
    if lag_required and min_context_length > 0:
        df = D.min_context(df, min_context_length)
    return df
