"""Queries whose rows lie in branches that the plain ones do not reach: population, short series, absent regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counterfactual as Kf
from ..operators import features as D
from ..operators import windows as W
from ..plans.base import KEYS, POP, TARGETS, VARS
from ..plans.prepare import prepare_tabular
from ..session import stored
from . import register
from .q_cf import CACHE, CATS, MODEL_COLS, NAMES, REGION, cache
from .q_features import PART, RP, RP_COLS, _LAG_DOUBLES, rp
from .q_windows import _EARLY, _LATE, SEQ_DOUBLES, SQ, sq
from .sqlfrag import interp_select, lags_select, nn

#: Longer than most series of the ragged panel.
LONG = 17
_EARLY_LONG = _EARLY.replace("_dr <= 4 AND _nd >= 4", f"_dr <= {LONG} AND _nd >= {LONG}")
_LATE_LONG = _LATE.replace("_m - 4) b WHERE _c = 4", f"_m - {LONG}) b WHERE _c = {LONG}")


@register("f5_early_window_long", SQ + f", {_EARLY_LONG} SELECT * FROM early", doubles=SEQ_DOUBLES)
def f5_early_window_long(spark, sf_dir):
    """Only series of at least LONG steps have an early window."""
    return W.early_window(sq(spark, sf_dir), KEYS, LONG)


@register("f6_late_window_long", SQ + f", {_LATE_LONG} SELECT * FROM late", doubles=SEQ_DOUBLES)
def f6_late_window_long(spark, sf_dir):
    return W.late_window(sq(spark, sf_dir), KEYS, LONG)


_PER_CAPITA = ", ".join(f"CASE WHEN {POP} > 0 THEN {t} / {POP} END AS {t}" for t in TARGETS)
_POPULATION = RP + f""",
pop AS ({interp_select('rp', [POP], RP_COLS)}),
pc AS (SELECT * REPLACE ({_PER_CAPITA}) FROM pop),
filled AS ({interp_select('pc', TARGETS, RP_COLS)}),
lagged AS ({lags_select('filled', TARGETS, 2)}),
hist AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER ({PART}) AS _rn FROM lagged) WHERE _rn > 2),
kept AS (SELECT * FROM hist WHERE {nn(TARGETS)})"""


def _population(spark, sf_dir):
    return prepare_tabular(rp(spark, sf_dir), TARGETS, KEYS, n_lags=2, population=POP, normalise_by_population=True)


@register("d18_prepare_tabular_population", _POPULATION + " SELECT * FROM kept", doubles=_LAG_DOUBLES)
def d18_prepare_tabular_population(spark, sf_dir):
    """Population filled, targets per head before they are interpolated and lagged."""
    return _population(spark, sf_dir)


@register("d18_population_and_back", _POPULATION + f" SELECT * REPLACE ({', '.join(f'{t} * {POP} AS {t}' for t in TARGETS)}) FROM kept", doubles=_LAG_DOUBLES)
def d18_population_and_back(spark, sf_dir):
    """The prepared targets back in totals (D3), as after a prediction."""
    return D.from_per_capita(_population(spark, sf_dir), TARGETS, POP)


#: A region that no series has: nothing is observed there, so every fallback counts.
NOWHERE = "Nowhere"
_AWAY = CACHE.replace(f"= '{REGION}'", f"= '{NOWHERE}'").replace(f"'{REGION}' AS region", f"'{NOWHERE}' AS region")


def _scenarios(c):
    return Kf.resolve_scenarios(c, NOWHERE, NAMES, CATS)[0]


@register("k3_template_model_global", _AWAY + " SELECT * FROM tm")
def k3_template_model_global(spark, sf_dir):
    c = cache(spark, sf_dir)
    return Kf.template_model(c, NOWHERE, _scenarios(c))


@register("k4_feature_lookup_all_regions", _AWAY + " SELECT * FROM lookup", doubles=MODEL_COLS)
def k4_feature_lookup_all_regions(spark, sf_dir):
    """No model has a value in the region: medians of all regions."""
    c = cache(spark, sf_dir)
    return Kf.feature_lookup(c, Kf.representatives(c, 200), MODEL_COLS, NOWHERE)


@register("k6_synthesise_fallback_region", _AWAY + " SELECT * FROM allrows", doubles=VARS)
def k6_synthesise_fallback_region(spark, sf_dir):
    """All rows come from the template model's first region."""
    c = stored(cache(spark, sf_dir), "panel")
    scenarios, reps = _scenarios(c), Kf.representatives(c, 200)
    template = Kf.template_model(c, NOWHERE, scenarios).first()["model"]  # one row
    made = Kf.synthesise(c, NOWHERE, scenarios, template, reps, Kf.feature_lookup(c, reps, MODEL_COLS, NOWHERE), MODEL_COLS, TARGETS)
    return made.select(*[F.col(x) for x in c.columns])
