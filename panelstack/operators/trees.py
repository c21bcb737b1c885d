"""Tree ensembles as tables: predictions, recursive forecasts and contributions by expressions.

A fitted MLlib ensemble is a table of nodes, as long as its number of trees and their depth. Sent along as one
short row it lets a column expression walk the trees, so a whole recursive forecast is one ``aggregate`` over the
rows of a series: one exchange, no step-by-step jobs. The same table gives exact path-dependent contributions:
each leaf shares its value among the features of its path, by the shares of training rows on the way where a
feature is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .rollout import _lag_spec, _ordered, _points, _recursion

NODE = "struct<feature:int,threshold:double,left:int,right:int,value:double>"
LEAF = "struct<value:double,path:array<struct<feature:int,share:double,low:double,high:double>>>"


def let(value: Column, body) -> Column:
    """``body`` of a value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def node_table(spark: SparkSession, models: dict) -> DataFrame:
    """(target, tree, node, feature, threshold, left, right, value, cover) of fitted ensembles, node 0 a tree's root.

    ``value`` is a leaf's prediction times its tree's weight; left and right are -1 in leaves; numbers at most
    ``threshold`` go left; ``cover`` counts the training rows. The models are saved once in the shared folder
    and their node data read back.
    """
    out = None
    for target, model in models.items():
        path = shared_dir(spark, "ensemble")
        model.write().save(path)
        weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
        n = F.col("nodeData")
        rows = spark.read.parquet(f"{path}/data").select(
            F.lit(target).alias("target"), F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
            (n["prediction"] * F.get(weights, F.col("treeID"))).alias("value"), n["rawCount"].alias("cover"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _trees(nodes: DataFrame) -> dict[str, list[dict[int, object]]]:
    """The nodes by target and tree (bounded by the models' parameters)."""
    out: dict = {}
    for r in nodes.orderBy("target", "tree", "node").collect():
        out.setdefault(r.target, {}).setdefault(r.tree, {})[r.node] = r
    return {t: list(trees.values()) for t, trees in out.items()}


def ensemble_row(nodes: DataFrame, targets: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """One row with ``_n_<target>`` (all nodes) and ``_r_<target>`` (the places of roots), and each target's depth."""
    spark, values, depths = nodes.sparkSession, [], {}
    trees = _trees(nodes)
    for t in targets:
        flat, roots, depth = [], [], 0
        for tree in trees[t]:
            names = list(tree)
            place = {name: len(flat) + i for i, name in enumerate(names)}
            roots.append(place[0])
            level = {0: 0}
            for name in names:  # parents come before their children
                r = tree[name]
                if r.left >= 0:
                    level[r.left] = level[r.right] = level[name] + 1
            depth = max(depth, *level.values())
            flat += [(r.feature, r.threshold, place.get(r.left, -1), place.get(r.right, -1), r.value) for r in tree.values()]
        values += [flat, roots]
        depths[t] = depth
    schema = ", ".join(f"`_n_{t}` array<{NODE}>, `_r_{t}` array<int>" for t in targets)
    return spark.createDataFrame([tuple(values)], schema), depths


def tree_sum(x: Column, nodes: Column, roots: Column, depth: int) -> Column:
    """The ensemble's prediction for the feature array ``x``."""
    def down(at: Column, _: Column) -> Column:
        return let(F.get(nodes, at), lambda n: F.when(n["left"] < 0, at).when(F.get(x, n["feature"]) <= n["threshold"], n["left"]).otherwise(n["right"]))

    leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), root, down)
    return F.aggregate(roots, F.lit(0.0), lambda s, root: s + F.get(nodes, leaf(root))["value"])


def predict_trees(df: DataFrame, nodes: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """``df`` with ``pred_<target>``."""
    row, depth = ensemble_row(nodes, targets)
    x = F.array(*[F.col(f).cast("double") for f in features])
    held = [c for t in targets for c in (f"_n_{t}", f"_r_{t}")]
    of = lambda t: let(x, lambda v: tree_sum(v, F.col(f"_n_{t}"), F.col(f"_r_{t}"), depth[t]))
    made = [of(t).alias(f"pred_{t}") for t in targets]
    return df.crossJoin(F.broadcast(row)).select("*", *made).drop(*held)  # one short row


def rollout_trees(df: DataFrame, keys: Sequence[str], step: str, targets: Sequence[str], nodes: DataFrame,
                  features: Sequence[str], lag_cols: dict[str, tuple[str, int]]) -> DataFrame:
    """Recursive forecast of tree ensembles: what ``rollout_stepwise`` gives, as one fold over each series."""
    row, depth = ensemble_row(nodes, targets)
    grouped = df.groupBy(*keys).agg(_ordered(step, features).alias("_rows")).crossJoin(F.broadcast(row))

    def predict(t, feature):
        return let(F.array(*[feature(f) for f in features]), lambda x: tree_sum(x, F.col(f"_n_{t}"), F.col(f"_r_{t}"), depth[t]))

    return _points(grouped, keys, step, targets, _recursion(list(targets), _lag_spec(lag_cols), {}, predict))


def leaf_table(nodes: DataFrame) -> DataFrame:
    """(target, base, leaves): the mean prediction by training rows, and every leaf's value and path.

    A path has each of its features once: the range (low, high] that leads to the leaf, and the share of training
    rows that would go there at the feature's nodes. One row a target.
    """
    rows = []
    for target, trees in _trees(nodes).items():
        leaves, base = [], 0.0
        for tree in trees:
            stack = [(0, {})]
            while stack:
                name, path = stack.pop()
                r = tree[name]
                if r.left < 0:
                    leaves.append((r.value, [(f, *x) for f, x in sorted(path.items())]))
                    base += r.value * math.prod(x[0] for x in path.values())
                    continue
                share, low, high = path.get(r.feature, (1.0, -math.inf, math.inf))
                for child, lo, hi in ((r.left, low, min(high, r.threshold)), (r.right, max(low, r.threshold), high)):
                    part = tree[child].cover / r.cover if r.cover else 0.5
                    stack.append((child, {**path, r.feature: (share * part, lo, hi)}))
        rows.append((target, base, leaves))
    return nodes.sparkSession.createDataFrame(rows, f"target string, base double, leaves array<{LEAF}>")


def tree_attribution(rows: DataFrame, keep: Sequence[str], features: Sequence[str], leaves: DataFrame) -> DataFrame:
    """(keep..., target, feature, x, contribution): exact path-dependent Shapley values of each prediction.

    They sum to the prediction less ``base`` of ``leaf_table``. The value of a set of features is the mean of the
    leaves reached if splits on other features are followed both ways, weighted by training rows. A leaf's part
    needs only the features of its path: with z their shares and o whether x is in range, feature j gets
    value * (o_j - z_j) * sum over s of s! (m - 1 - s)! / m! times the t^s term of the product of (z_k + o_k t)
    over the other features k. NULL features go right, like numbers above every threshold.
    """
    features = list(features)
    most = max([len(leaf.path) for r in leaves.select("leaves").collect() for leaf in r.leaves] + [1])  # bounded by the models' depth
    weight = F.array(*[F.array(*[F.lit(math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m)) for s in range(m)]) for m in range(1, most + 1)])

    def times(poly: Column, k: Column) -> Column:
        return F.zip_with(F.concat(F.transform(poly, lambda c: c * k["z"]), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(poly, lambda c: c * k["o"])), lambda a, b: a + b)

    def parts(leaf: Column, x: Column) -> Column:
        def seen(p: Column) -> Column:
            v = F.coalesce(F.get(x, p["feature"]), F.lit(float("inf")))
            return F.struct(p["feature"].alias("f"), p["share"].alias("z"), F.when((v > p["low"]) & (v <= p["high"]), 1.0).otherwise(0.0).alias("o"))

        def shared(path: Column) -> Column:
            row = F.get(weight, F.size(path) - 1)

            def one(j: Column, at: Column) -> Column:
                others = F.filter(path, lambda _, i: i != at)
                poly = F.aggregate(others, F.array(F.lit(1.0)), times)
                total = F.aggregate(F.zip_with(poly, row, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
                return F.struct(j["f"].alias("f"), (leaf["value"] * (j["o"] - j["z"]) * total).alias("v"))

            return F.transform(path, one)

        return let(F.transform(leaf["path"], seen), shared)

    def added(sums: Column, leaf: Column, x: Column) -> Column:
        return let(parts(leaf, x), lambda got: F.transform(sums, lambda s, i: s + F.aggregate(F.filter(got, lambda g: g["f"] == i), F.lit(0.0), lambda a, g: a + g["v"])))

    x = F.array(*[F.col(f).cast("double") for f in features])
    zeros = F.array(*[F.lit(0.0) for _ in features])
    named = rows.select(*keep, x.alias("_x")).crossJoin(F.broadcast(leaves.select("target", "leaves")))  # one row a target
    sums = named.select(*keep, "target", "_x", F.aggregate("leaves", zeros, lambda s, leaf: added(s, leaf, F.col("_x"))).alias("_c"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("_x", F.lit(i)).alias("x"), F.get("_c", F.lit(i)).alias("contribution")) for i, f in enumerate(features)])
    return sums.select(*keep, "target", F.inline(cells))
