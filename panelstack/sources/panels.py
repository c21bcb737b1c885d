"""Long panels derived from the star-schema driver tables.

The reference works on long scenario panels (one value per model, scenario,
region, variable and year).  These builders derive such panels from the
TPC-H-like tables so that every operator's work grows with the data:

* ``panel_yearly``    model = brand family, scenario = market segment,
                      region = customer region, variable = part type,
                      year = ship year, value = summed quantity.
* ``panel_quarterly`` same shape with a running quarter number as time.
* ``panel_ragged``    quarterly panel cut to uneven lengths with holes.

All joins are equi-joins; ``nation`` and ``region`` are fixed-size TPC-H
dimensions (25 and 5 rows by specification) and are broadcast.  The large
joins (lineitem/orders/customer/part) are left to AQE, which picks the
strategy from runtime sizes.  Spark adds a partial (map-side) aggregate
before the final exchange, so only one row per group and partition is
shuffled after the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import table

# Fixed values of the fixture panels (region labels, units, roles).
REGION_LABELS = {
    "AFRICA": "R10AFRICA",
    "AMERICA": "R5LAM",
    "ASIA": "R6ASIA",
    "EUROPE": "EU",
}
REGION_DEFAULT = "World"
UNIT_BY_TYPE = {"ECONOMY": "EJ/yr", "LARGE": "Million tkm", "MEDIUM": "Million pkm"}
UNIT_DEFAULT = "u/yr"
VARIABLES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TARGETS = ("ECONOMY", "LARGE", "MEDIUM")
INPUTS = ("PROMO", "SMALL")
POPULATION = "STANDARD"
KEYS = ("model", "scenario", "region")


def _case(col: Column, mapping: dict, default: str) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its part and to its order's customer, nation and region.

    Orders are first joined to customers (an orders-sized join), so the
    lineitem-sized side takes part in two joins only (part, order info);
    at scale that is one lineitem-sized shuffle less than chaining
    lineitem -> part -> orders -> customer.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"))
    region = F.broadcast(table(spark, sf_dir, "region", "r_regionkey", "r_name"))
    order_info = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                        .join(nation, cust.c_nationkey == nation.n_nationkey)
                        .join(region, nation.n_regionkey == region.r_regionkey)
                        .select("o_orderkey", "o_orderpriority", "c_mktsegment", "r_name"))
    # Hash-partition lineitem by order key: at scale this is the shuffle the
    # order join needs anyway (sort-merge), and it spreads the work over all
    # cores when a file has few row groups.
    li = li.repartition("l_orderkey")
    return (li.join(order_info, li.l_orderkey == order_info.o_orderkey)
              .join(part, li.l_partkey == part.p_partkey))


def region_label(col: Column) -> Column:
    return _case(col, REGION_LABELS, REGION_DEFAULT)


def panel_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long yearly panel with units: model, scenario, region, variable, unit, year, value.

    Grouping runs on the raw columns; the derived labels are computed on
    the aggregated rows only.
    """
    f = _facts(spark, sf_dir)
    agg = (f.groupBy("p_brand", "c_mktsegment", "r_name", "p_type",
                     F.year("l_shipdate").cast("int").alias("year"))
             .agg(F.round(F.sum("l_quantity"), 4).alias("value")))
    brand_no = F.substring(F.col("p_brand"), 7, 100).cast("int")
    return agg.select(
        F.concat(F.lit("F"), (brand_no % 5).cast("string"), F.lit("-"),
                 F.col("p_brand"), F.lit(" 1.0")).alias("model"),
        F.col("c_mktsegment").alias("scenario"),
        region_label(F.col("r_name")).alias("region"),
        F.col("p_type").alias("variable"),
        _case(F.col("p_type"), UNIT_BY_TYPE, UNIT_DEFAULT).alias("unit"),
        "year", "value")


def panel_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long quarterly panel: model, scenario, region, variable, year (running quarter), value."""
    f = _facts(spark, sf_dir)
    quarter_no = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    agg = (f.groupBy("c_mktsegment", "o_orderpriority", "r_name", "p_type", quarter_no.alias("year"))
             .agg(F.round(F.sum("l_quantity"), 4).alias("value")))
    return agg.select(F.col("c_mktsegment").alias("model"),
                      F.col("o_orderpriority").alias("scenario"),
                      region_label(F.col("r_name")).alias("region"),
                      F.col("p_type").alias("variable"), "year", "value")


def panel_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly panel with uneven series lengths and missing values."""
    q = panel_quarterly(spark, sf_dir)
    hole = ((F.col("year") + F.length("scenario") + F.length("variable")) % 4) == 0
    cut = F.lit(7988) + (F.length("model") * 3 + F.length("scenario") * 5
                         + F.length("region") * 7) % 21
    return (q.where(F.col("year") < cut)
             .select("model", "scenario", "region", "variable", "year",
                     F.when(hole, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value")))


# DuckDB text of the same panels, used by the oracle queries.
REGION_CASE_SQL = ("CASE r_name WHEN 'AFRICA' THEN 'R10AFRICA' WHEN 'AMERICA' THEN 'R5LAM' "
                   "WHEN 'ASIA' THEN 'R6ASIA' WHEN 'EUROPE' THEN 'EU' ELSE 'World' END")

PANEL_YEARLY_SQL = f"""
SELECT concat('F', cast(cast(substr(p_brand,7) AS int) % 5 AS varchar), '-', p_brand, ' 1.0') AS model,
       c_mktsegment AS scenario,
       {REGION_CASE_SQL} AS region,
       p_type AS variable,
       CASE p_type WHEN 'ECONOMY' THEN 'EJ/yr' WHEN 'LARGE' THEN 'Million tkm'
                   WHEN 'MEDIUM' THEN 'Million pkm' ELSE 'u/yr' END AS unit,
       cast(year(l_shipdate) AS int) AS year,
       round(sum(l_quantity), 4) AS value
FROM lineitem JOIN part ON p_partkey=l_partkey JOIN orders ON o_orderkey=l_orderkey
JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey
JOIN region ON r_regionkey=n_regionkey
GROUP BY p_brand, c_mktsegment, r_name, p_type, year(l_shipdate)
"""

PANEL_QUARTERLY_SQL = f"""
SELECT c_mktsegment AS model, o_orderpriority AS scenario,
       {REGION_CASE_SQL} AS region,
       p_type AS variable,
       cast(year(l_shipdate)*4 + quarter(l_shipdate) - 1 AS int) AS year,
       round(sum(l_quantity), 4) AS value
FROM lineitem JOIN part ON p_partkey=l_partkey JOIN orders ON o_orderkey=l_orderkey
JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey
JOIN region ON r_regionkey=n_regionkey
GROUP BY c_mktsegment, o_orderpriority, r_name, p_type, year(l_shipdate)*4 + quarter(l_shipdate) - 1
"""

PANEL_RAGGED_SQL = """
SELECT model, scenario, region, variable, year,
       CASE WHEN (year + length(scenario) + length(variable)) % 4 = 0 THEN NULL ELSE value END AS value
FROM panel_quarterly
WHERE year < 7988 + (length(model)*3 + length(scenario)*5 + length(region)*7) % 21
"""


def wide_sql(source: str, keys=KEYS, variables=VARIABLES, extra_keys=()) -> str:
    """DuckDB pivot of a long panel into one column per variable (mean of duplicates)."""
    cols = ",\n  ".join(
        f"avg(value) FILTER (WHERE variable = '{v}') AS {v.lower()}" for v in variables)
    k = ", ".join(list(keys) + list(extra_keys) + ["year"])
    nn = " AND ".join(f"{c} IS NOT NULL" for c in list(keys) + list(extra_keys) + ["year", "value"])
    return (f"SELECT {k},\n  {cols}\nFROM {source} WHERE {nn} "
            f"AND variable IN ({', '.join(repr(v) for v in variables)})\nGROUP BY {k}")


def with_panels(*names: str) -> str:
    """WITH clause that defines the requested fixture panels (and their prerequisites)."""
    parts = []
    want = set(names)
    if "panel_ragged" in want or "ragged_wide" in want:
        want.add("panel_quarterly")
    if "yearly_wide" in want or "raw_wide" in want:
        want.add("panel_yearly")
    if "quarterly_wide" in want:
        want.add("panel_quarterly")
    if "ragged_wide" in want:
        want.add("panel_ragged")
    if "panel_yearly" in want:
        parts.append(f"panel_yearly AS ({PANEL_YEARLY_SQL})")
    if "panel_quarterly" in want:
        parts.append(f"panel_quarterly AS ({PANEL_QUARTERLY_SQL})")
    if "panel_ragged" in want:
        parts.append(f"panel_ragged AS ({PANEL_RAGGED_SQL})")
    if "yearly_wide" in want:
        parts.append(f"yearly_wide AS ({wide_sql('panel_yearly')})")
    if "quarterly_wide" in want:
        parts.append(f"quarterly_wide AS ({wide_sql('panel_quarterly')})")
    if "ragged_wide" in want:
        parts.append(f"ragged_wide AS ({wide_sql('panel_ragged')})")
    if "raw_wide" in want:
        parts.append(f"raw_wide AS ({raw_wide_sql(FIXTURE_YEARS)})")
    return "WITH " + ",\n".join(parts)


def raw_wide_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw wide table as the source files have it: text year columns, 'n/a' junk.

    One row per (model, scenario, region, variable, unit); one text column per
    year; the text 'n/a' where (year + length(variable)) % 11 = 0.

    The long panel is stored first: the pivot reads it twice (years, then values) and callers read the wide table
    several times, but the fact tables are joined once.
    """
    long = stored(panel_yearly(spark, sf_dir), "panel-yearly")
    text = F.when((F.col("year") + F.length("variable")) % 11 == 0, F.lit("n/a")) \
            .otherwise(F.col("value").cast("string"))
    return (long.groupBy("model", "scenario", "region", "variable", "unit")
                .pivot("year").agg(F.first(text)))


def raw_wide_sql(years) -> str:
    cols = ", ".join(
        f"first(CASE WHEN (year + length(variable)) % 11 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END) "
        f"FILTER (WHERE year = {y}) AS \"{y}\"" for y in years)
    return (f"SELECT model, scenario, region, variable, unit, {cols} FROM panel_yearly "
            f"GROUP BY model, scenario, region, variable, unit")


FIXTURE_YEARS = tuple(range(1995, 2002))
