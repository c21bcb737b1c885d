"""Column expressions (all built-in Spark functions, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region scale prefixes, checked in this order, first match wins.
REGION_SCALE_PREFIXES = (("World", "World"), ("R5", "R5"), ("R6", "R6"), ("R10", "R10"))
REGION_SCALE_DEFAULT = "ISO3"
REGION_SCALE_ORDER = ("World", "R5", "R6", "R10", "ISO3")

# Region types used by the evaluation tables, checked in this order.
REGION_TYPE_PREFIXES = (("R10", "R10"), ("R6", "R6"), ("R5", "R5"), ("World", "World"))
REGION_TYPE_DEFAULT = "ISO"

# Option order of region filters (dashboard).
REGION_OPTION_ORDER = ("ISO", "R10", "R6", "R5", "World")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, NULL when the denominator is zero or NULL (ANSI-safe)."""
    d = col(den)
    return F.when(d != 0, col(num) / d)


def model_family(model) -> Column:
    """Text before the first of ``_``, ``-``, ``/`` or a space."""
    return F.regexp_extract(col(model), r"^[^_/ -]*", 0)


def _prefix_chain(c: Column, prefixes, default: str) -> Column:
    expr = None
    for prefix, label in prefixes:
        cond = c.startswith(prefix)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def region_scale(region) -> Column:
    return _prefix_chain(col(region), REGION_SCALE_PREFIXES, REGION_SCALE_DEFAULT)


def region_type(region) -> Column:
    return _prefix_chain(col(region), REGION_TYPE_PREFIXES, REGION_TYPE_DEFAULT)


def group_key(*keys) -> Column:
    return F.concat_ws("_", *[col(k) for k in keys])


def any_null(cols: Iterable) -> Column:
    out = None
    for c in cols:
        e = col(c).isNull()
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


def all_not_null(cols: Iterable) -> Column:
    return ~any_null(cols)


# How feature names are built, and the texts of their labels.
FEATURE_NAME = r"^(timestep_([0-9]+)_)?(prev([0-9]*)_)?(.+?)(_is_missing)?$"
YEARS_PER_STEP = 5
NOW, FLAG = " (current)", " N/A"


def feature_label(feature) -> Column:
    """Label of a feature name: stem, how far it looks back, and a note for missing flags.

    A ``prev`` name looks back its number of steps (1 if none is given), else a ``timestep`` name its own
    number; no step back is ``(current)``. Steps are shown in years.
    """
    at, step, back, lag, stem, flag = (F.regexp_extract(col(feature), FEATURE_NAME, i) for i in range(1, 7))
    steps = F.when(back != "", F.coalesce(F.nullif(lag, F.lit("")), F.lit("1"))).when((at != "") & (step != "0"), step)
    ago = F.concat(F.lit(" (last "), (steps.cast("int") * YEARS_PER_STEP).cast("string"), F.lit("y)"))
    return F.concat(stem, F.coalesce(ago, F.lit(NOW)), F.when(flag != "", FLAG).otherwise(""))


def short_number(x) -> Column:
    """1.5M / 2k / 0 / 3.4 style text for report tables."""
    v = col(x).cast("double")

    def fmt(val: Column, suffix: str) -> Column:
        # one decimal, rounded half-up on the decimal value (6 places)
        tenth = F.round(val.cast("decimal(38,6)"), 1).cast("double")
        return F.when(val == F.floor(val), F.concat(F.format_string("%.0f", val), F.lit(suffix))) \
                .otherwise(F.concat(F.format_string("%.1f", tenth), F.lit(suffix)))

    return (F.when(F.abs(v) >= 1e6, fmt(v / 1e6, "M"))
             .when(F.abs(v) >= 1e3, fmt(v / 1e3, "k"))
             .when(v == 0, F.lit("0"))
             .otherwise(fmt(v, "")))
