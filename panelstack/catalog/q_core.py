"""Flagship query: naive forecast quality by region type."""

from __future__ import annotations

from ..plans.base import naive_forecast_metrics
from ..sources.panels import with_panels
from . import register
from .sqlfrag import KEYS, TARGETS, METRIC_DOUBLES, interp_select, lags_select, \
    metrics_by_region_type_sql

ALL_WIDE = list(KEYS) + ["year", "economy", "large", "medium", "promo", "small", "standard"]

_prevs = [f"prev_{t}" for t in TARGETS]
FLAGSHIP_SQL = with_panels("yearly_wide") + f""",
filled AS ({interp_select('yearly_wide', TARGETS, ALL_WIDE)}),
lagged AS ({lags_select('filled', TARGETS, 1)}),
hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, scenario, region ORDER BY year) AS _rn
         FROM lagged) WHERE _rn > 1),
clean AS (SELECT * FROM hist WHERE {' AND '.join(f'{c} IS NOT NULL' for c in list(TARGETS) + _prevs)})
{metrics_by_region_type_sql('clean', TARGETS, _prevs)}
"""


@register("flagship_naive_forecast", FLAGSHIP_SQL, doubles=METRIC_DOUBLES)
def flagship(spark, sf_dir):
    """panel -> C16 -> D1 -> D4 -> D5 -> D6 -> H2 (naive forecast by region type)."""
    return naive_forecast_metrics(spark, sf_dir)
