"""Exact order statistics without collecting a group into one task.

``exact_median`` finds the middle value(s) of every group with a bucketed
selection: approximate splitters (``percentile_approx``) cut each group
into ordered buckets, bucket counts give each bucket's rank offset, and
only the one or two buckets that hold the middle ranks go on.  A second
level cuts those buckets again, so the final exact ranking sees about
1/4096 of a group.  Equal values are pre-aggregated before that ranking, so
a hot value (even a third of all rows) is one row.  The result is exact
whatever the splitters are; they only decide how much work the last step
does.

``grouped_medians`` does so for several columns, and for the total beside the
groups, without a row per column: approximate percentiles close to the half
of every column bound the values that can be its median, one aggregate
counts how many lie below, and only the few between are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, checked_broadcast, materialize, stored


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where NULL keys match (group keys may be NULL)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"_r_{c}"])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{c}" for c in cols])


def exact_median(long: DataFrame, group: Sequence[str], value: str = "value",
                 buckets: int = 64, levels: int = 2, accuracy: int = 10000) -> DataFrame:
    """Median (mean of the two middle values) of ``value`` per ``group``.

    NULL values are ignored; groups without values are absent.  Each level
    cuts the rows still in play into ``buckets`` ordered buckets and keeps
    only the bucket(s) holding the middle ranks, so after ``levels`` levels a
    group of n rows is ranked exactly over about n / buckets**levels rows.
    Returns ``group`` columns + ``median``.
    """
    group = list(group)
    # every level reads the rows twice (splitters, then bucket counts): write
    # them once so the passes never recompute the input's lineage
    v = materialize(long.select(*group, F.col(value).cast("double").alias("_v"))
                        .where(F.col("_v").isNotNull()))
    fracs = [i / buckets for i in range(1, buckets)]
    k1 = F.floor((F.col("_n") - 1) / 2)
    k2 = F.ceil((F.col("_n") - 1) / 2)
    path: list[str] = []
    cur = v
    wanted = None
    for lvl in range(levels):
        b = f"_b{lvl}"
        keys = group + path
        # splitters per current bucket (bounded: groups x wanted buckets rows)
        aggs = [F.percentile_approx("_v", fracs, accuracy).alias("_s")]
        if lvl == 0:
            aggs.append(F.count("*").alias("_n"))
        splits = cur.groupBy(*keys).agg(*aggs)
        if lvl == 0:
            wanted = splits.select(*group, "_n", F.lit(0).cast("long").alias("_off"))
            splits = splits.drop("_n")
        # a row per group: broadcast if few, so that rows are not dealt out by a handful of keys
        tagged = null_safe_join(cur, checked_broadcast(splits), keys).select(
            *keys, "_v", F.size(F.filter("_s", lambda x: x < F.col("_v"))).alias(b))
        per = tagged.groupBy(*keys, b).agg(F.count("*").alias("_c"))
        per = null_safe_join(per, wanted.select(*keys, "_n", F.col("_off").alias("_poff")), keys)
        wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("_off", F.col("_poff") + F.coalesce(F.sum("_c").over(wb), F.lit(0)))
        hit = lambda k: (k >= F.col("_off")) & (k < F.col("_off") + F.col("_c"))
        path = path + [b]
        # the chosen buckets (a few rows per group) and the rows still in play
        # (about 1/buckets of the previous level) are cut from the lineage too
        wanted = checked_broadcast(per.where(hit(k1) | hit(k2)).select(*group, *path, "_n", "_off"))
        cur = materialize(null_safe_join(tagged, wanted.select(*group, *path), group + path, "left_semi"))
    # exact ranks inside the wanted leaf buckets only, equal values collapsed
    leaf = group + path
    vals = cur.groupBy(*leaf, "_v").agg(F.count("*").alias("_m"))
    wv = Window.partitionBy(*leaf).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (null_safe_join(vals, wanted, leaf)
              .withColumn("_hi", F.col("_off") + F.sum("_m").over(wv))
              .withColumn("_lo", F.col("_hi") - F.col("_m")))
    covers = lambda k: (k >= F.col("_lo")) & (k < F.col("_hi"))
    picked = ranked.select(*group, F.when(covers(k1), F.col("_v")).alias("_a"),
                           F.when(covers(k2), F.col("_v")).alias("_z"))
    return picked.groupBy(*group).agg(((F.max("_a") + F.max("_z")) / 2).alias("median"))


def grouped_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str], total: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Medians of ``cols`` for each value of ``by`` and, with ``total``, of all rows: (by..., _all, feature, median).

    NULL values are ignored, columns without values give no row, NULL groups are groups like others. Three passes
    over the stored rows, each an aggregate with a column for each feature: percentiles at 0.5 -+ 5 / ``accuracy``,
    whose ranks are known to 1 / ``accuracy``; the counts below and between them, those of the total being the sums
    of the groups' counts; and the values between, about a thousandth of the rows. Should a median lie outside,
    all values of its column are ranked.
    """
    by, cols = list(by), list(cols)
    rows = stored(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), "medians")
    near = [0.5 - 5 / accuracy, 0.5 + 5 / accuracy]
    bounds = lambda name: [F.struct(F.get(r, F.lit(0)).alias("lo"), F.get(r, F.lit(1)).alias("hi")).alias(f"{name}_{i}")
                           for i, c in enumerate(cols) for r in [F.percentile_approx(c, near, accuracy)]]
    whole = F.broadcast(rows.agg(*bounds("_t")))  # one row
    small = materialize(rows.groupBy(*by).agg(*bounds("_g")))
    hint = F.broadcast if not by or small.count() <= BROADCAST_ROWS else (lambda x: x)  # a row a group, here and below
    marked = null_safe_join(rows, hint(small), by) if by else rows.crossJoin(hint(small))
    kinds = ["_g", "_t"] if total else ["_g"]
    if total:
        marked = marked.crossJoin(whole)

    def count(c: str, place: str):
        v, low, high = F.col(c), F.col(f"{place}.lo"), F.col(f"{place}.hi")
        return F.struct(F.count(v).alias("n"), F.count(F.when(v < low, 1)).alias("below"), F.count(F.when((v >= low) & (v <= high), 1)).alias("inside"),
                        F.min(low).alias("lo"), F.max(high).alias("hi"))

    counted = marked.groupBy(*by).agg(*[count(c, f"{k}_{i}").alias(f"{k}_{i}") for k in kinds for i, c in enumerate(cols)])
    counted = materialize(counted)  # a row a group
    cells = lambda k: F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"{k}_{i}").alias("_x")) for i in range(len(cols))]))
    ranges = counted.select(*by, F.lit(False).alias("_all"), cells("_g")).select(*by, "_all", "_c", "_x.*")
    if total:
        of_all = counted.select(cells("_t")).groupBy("_c").agg(*[F.sum(f"_x.{x}").alias(x) for x in ("n", "below", "inside")], F.min("_x.lo").alias("lo"), F.max("_x.hi").alias("hi"))
        ranges = ranges.unionByName(of_all.select(*[F.lit(None).cast(df.schema[b].dataType).alias(b) for b in by], F.lit(True).alias("_all"), "_c", "n", "below", "inside", "lo", "hi"))
    k1, k2 = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    held = (F.col("below") <= k1) & (F.col("below") + F.col("inside") > k2)
    ranges = ranges.where("n > 0").select(*by, "_all", "_c", k1.alias("_k1"), k2.alias("_k2"), F.when(held, F.col("below")).otherwise(0).alias("_below"),
                                          F.when(held, F.col("lo")).otherwise(float("-inf")).alias("_lo"), F.when(held, F.col("hi")).otherwise(float("inf")).alias("_hi"))
    named = lambda k: [F.max(F.when(F.col("_c") == i, F.struct("_lo", "_hi"))).alias(f"{k}_{i}") for i in range(len(cols))]
    per = hint(ranges.where("not _all").groupBy(*by).agg(*named("_g")))
    between = null_safe_join(rows, per, by) if by else rows.crossJoin(per)
    if total:
        between = between.crossJoin(F.broadcast(ranges.where("_all").agg(*named("_t"))))
    value = lambda k, i, c: F.struct(F.lit(k == "_t").alias("_all"), F.lit(i).alias("_c"), F.when((F.col(c) >= F.col(f"{k}_{i}._lo")) & (F.col(c) <= F.col(f"{k}_{i}._hi")), F.col(c)).alias("_v"))
    inside = F.filter(F.array(*[value(k, i, c) for k in kinds for i, c in enumerate(cols)]), lambda x: x["_v"].isNotNull())
    values = between.select(*by, F.inline(inside)).select(*[F.when(~F.col("_all"), F.col(b)).alias(b) for b in by], "_all", "_c", "_v").groupBy(*by, "_all", "_c", "_v").agg(F.count("*").alias("_m"))
    ranked = null_safe_join(values, ranges, [*by, "_all", "_c"])
    wv = Window.partitionBy(*by, "_all", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_top", F.col("_below") + F.sum("_m").over(wv)).withColumn("_low", F.col("_top") - F.col("_m"))
    covers = lambda k: F.max(F.when((F.col(k) >= F.col("_low")) & (F.col(k) < F.col("_top")), F.col("_v")))
    picked = ranked.groupBy(*by, "_all", "_c").agg(((covers("_k1") + covers("_k2")) / 2).alias("median"))
    return picked.select(*by, "_all", F.get(F.array(*[F.lit(c) for c in cols]), F.col("_c")).alias("feature"), "median")
