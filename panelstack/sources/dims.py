"""Small metadata dimensions (fixed values of the fixture panels).

These are lookup tables of a size fixed by their definition (a handful of
rows), so they are safe to broadcast.  Each also has a DuckDB ``VALUES``
text for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Scenario category per scenario (MACHINERY is deliberately absent).
SCENARIO_CATEGORY = (("AUTOMOBILE", "C1"), ("BUILDING", "C2"), ("FURNITURE", "C3"),
                     ("HOUSEHOLD", "C3"))

# Variable classification (variable, type, model type).
VARIABLE_CLASS = (("ECONOMY", "output", "energy"), ("LARGE", "output", "transport"),
                  ("MEDIUM", "output", "transport"), ("PROMO", "input", "economy"),
                  ("SMALL", "input", "economy"), ("STANDARD", "intermediate", "demography"))

# Declared base year per model family ('' = not declared).
BASE_YEAR_BY_FAMILY = (("F0", "1997"), ("F1", "2010"), ("F2", ""), ("F3", "1990"), ("F4", "1996"))

# SSP family rows with their file order (first row of a key wins).
SSP_FAMILY = (("F0-Brand#10 1.0", "AUTOMOBILE", "SSP1", 1),
              ("F0-Brand#10 1.0", "AUTOMOBILE", "SSP2", 2),
              ("F1-Brand#1 1.0", "BUILDING", "SSP3", 3),
              ("F2-Brand#12 1.0", "FURNITURE", "SSP5", 4))

# Region vocabulary of the fixtures, in code order (World left out).
REGION_VOCAB = ("R10AFRICA", "R5LAM", "R6ASIA", "EU")

# Unit conversion rules (unit, factor, new unit).
UNIT_RULES = (("EJ/yr", 1000.0, "PJ/yr"), ("Million tkm", 0.001, "bn tkm/yr"),
              ("Million pkm", 0.001, "bn pkm/yr"))


def _df(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def scenario_category(spark):
    return _df(spark, SCENARIO_CATEGORY, "scenario string, scenario_category string")


def variable_class(spark):
    return _df(spark, VARIABLE_CLASS, "variable string, type string, model_type string")


def base_year_by_family(spark):
    return _df(spark, BASE_YEAR_BY_FAMILY, "model_family string, base_year string")


def ssp_family(spark):
    return _df(spark, SSP_FAMILY, "model string, scenario string, ssp_family string, file_order int")


def region_vocab(spark):
    return _df(spark, [(r, i) for i, r in enumerate(REGION_VOCAB)], "region string, code int")


def unit_rules(spark):
    return _df(spark, UNIT_RULES, "unit string, factor double, new_unit string")


def values_sql(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


SCENARIO_CATEGORY_SQL = values_sql(SCENARIO_CATEGORY, ["scenario", "scenario_category"])
VARIABLE_CLASS_SQL = values_sql(VARIABLE_CLASS, ["variable", "type", "model_type"])
BASE_YEAR_BY_FAMILY_SQL = values_sql(BASE_YEAR_BY_FAMILY, ["model_family", "base_year"])
SSP_FAMILY_SQL = values_sql(SSP_FAMILY, ["model", "scenario", "ssp_family", "file_order"])
REGION_VOCAB_SQL = values_sql([(r, i) for i, r in enumerate(REGION_VOCAB)], ["region", "code"])
UNIT_RULES_SQL = values_sql(UNIT_RULES, ["unit", "factor", "new_unit"])


def base_years_for_models(spark, models: DataFrame) -> DataFrame:
    """Expand the family base years to every model of ``models`` (model column)."""
    from ..functions.columns import model_family
    fam = models.select("model").distinct().withColumn("model_family", model_family("model"))
    return fam.join(F.broadcast(base_year_by_family(spark)), "model_family", "left") \
              .select("model", "base_year")
