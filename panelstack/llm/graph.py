"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstack.session import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    Every round replaces edges by edges to smaller nodes without changing what is connected; it ends when
    the edges are stars. Hubs are aggregated before the shuffle and their join may be split as skewed.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    stars = materialize(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            # nodes without a larger neighbour keep the edge to their smallest one
            least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi != lo").distinct()
        stars = materialize(small)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
