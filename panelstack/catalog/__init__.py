"""Registry of named queries: a Spark builder plus its DuckDB oracle text.

Every Spark result gets its DOUBLE columns rounded to 6 decimals (and -0.0
folded into 0.0); the oracle text is wrapped with the same rounding for the
columns listed in ``doubles``.  Both sides read the same driver tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = ()
    notes: str = ""
    double_arrays: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            out.append(F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def wrap_sql(sql: str, doubles=(), double_arrays=(), digits: int = 6) -> str:
    parts = [f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles]
    parts += [f'list_transform("{c}", lambda x: round(x, {digits}) + 0.0) AS "{c}"' for c in double_arrays]
    if not parts:
        return sql
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) AS q"


def register(name: str, sql: str | None = None, doubles=(), double_arrays=(), notes: str = ""):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build,
                               wrap_sql(sql, doubles, double_arrays) if sql else None,
                               tuple(doubles), notes, tuple(double_arrays))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every catalog module (registration happens at import)."""
    from . import q_core, q_clean, q_features, q_encode, q_eval, q_windows, q_models, q_linear, q_attr, q_cf, q_infer, q_branches, q_fallbacks  # noqa: F401
    return REGISTRY
