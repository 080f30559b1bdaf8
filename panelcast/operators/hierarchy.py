"""A summing hierarchy of stores, and forecasts made to add up over it.

The tree is a table of nodes (``node``, ``parent``, ``depth``): the total at depth 0, prefectures,
wards, stores as leaves. Stores without a known area hang under ``unknown`` nodes. Node names are
paths, so equal ward names in two prefectures stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.entities import store_metadata
from panelcast.schema import DATE, STORE, TARGET
from panelcast.session import stage

ROOT = "total"
LEVELS = ("total", "prefecture", "ward", "store")


def _paths(prefecture: Column, ward: Column) -> list[Column]:
    parts = [F.lit(ROOT), F.coalesce(prefecture, F.lit("unknown")), F.coalesce(ward, F.lit("unknown")), F.col(STORE).cast("string")]
    return [F.concat_ws("/", *parts[: i + 1]) for i in range(len(parts))]


def store_paths(panel: DataFrame, stores: DataFrame | None) -> DataFrame:
    """``store_id`` and its ancestors from the root to itself as an array ``path``."""
    own = panel.select(STORE).distinct()
    if stores is None:
        return own.select(STORE, F.array(*_paths(F.lit(None), F.lit(None))).alias("path"))
    known = own.join(store_metadata(stores), STORE, "left")
    for name in ("area_prefecture", "area_ward"):
        if name not in known.columns:
            known = known.withColumn(name, F.lit(None).cast("string"))
    return known.select(STORE, F.array(*_paths(F.col("area_prefecture"), F.col("area_ward"))).alias("path"))


def tree_of(paths: DataFrame) -> DataFrame:
    """One row per node: ``node``, ``parent`` (null for the root) and ``depth``."""
    nodes = paths.select("path", F.posexplode("path").alias("depth", "node"))
    return nodes.select("node", F.get("path", F.col("depth") - 1).alias("parent"), "depth").distinct()


def level_panels(visits: DataFrame, paths: DataFrame) -> DataFrame:
    """The panel of all nodes, ``store_id`` being the node: targets summed per node and day.

    Each row is repeated once per level before a partial sum, so a node with a large part of all
    stores arrives as one row per day and task.
    """
    rows = visits.join(paths, STORE).select(F.explode("path").alias("node"), DATE, TARGET)
    return rows.groupBy("node", DATE).agg(F.sum(TARGET).alias(TARGET)).withColumnRenamed("node", STORE)


def level_variances(scored: DataFrame, tree: DataFrame) -> DataFrame:
    """``depth`` and ``variance``: the mean squared error of past forecasts of each level's nodes."""
    error = F.col("y_true") - F.col("y_pred")
    rows = scored.join(tree, F.col(STORE) == F.col("node"))
    return rows.groupBy("depth").agg(F.avg(error * error).alias("variance"))


def reconcile(base: DataFrame, tree: DataFrame, variances: DataFrame, depth: int = len(LEVELS) - 1) -> DataFrame:
    """``node, depth, date, y_pred, y_reconciled``: the weighted least-squares forecasts that add up.

    Minimises the squared changes of all base forecasts (``node, date, y_pred``), each over its
    level's variance, so that every node is the sum of its children. On a tree the solution needs no
    matrix: going up, a node's own forecast is merged with its children's sum in inverse
    proportion to their variances; going down, what a parent gained is shared among its children in
    proportion to theirs. So it takes one aggregation and one join per level.

    A node without its own forecast takes its children's sum. Levels of zero variance are given a
    very small one, so they are matched as far as rounding allows.
    """
    own = base.join(tree, "node").join(F.broadcast(variances), "depth", "left")  # one row per level
    spread = F.greatest(F.coalesce("variance", F.lit(1.0)), F.lit(1e-9))
    own = own.select("node", "parent", "depth", DATE, "y_pred", spread.alias("v"))
    own = stage(own, "hierarchy-base")
    leaf = own.where(F.col("depth") == depth)
    merged = {depth: leaf.select("node", "parent", DATE, "y_pred", F.col("y_pred").alias("m"), F.col("v").alias("u"))}
    for d in range(depth - 1, -1, -1):
        children = merged[d + 1].groupBy("parent", DATE).agg(F.sum("m").alias("s"), F.sum("u").alias("w"))
        names = tree.where(F.col("depth") == d).select("node", "parent")
        children = children.withColumnRenamed("parent", "node").join(names, "node")
        mine = own.where(F.col("depth") == d).select("node", DATE, "y_pred", "v")
        both = children.join(mine, ["node", DATE], "left")
        known = F.col("y_pred").isNotNull()
        joint = (F.col("s") * F.col("v") + F.col("y_pred") * F.col("w")) / (F.col("v") + F.col("w"))
        merged[d] = stage(
            both.select(
                "node", "parent", DATE, "y_pred", "s", "w",
                F.when(known, joint).otherwise(F.col("s")).alias("m"),
                F.when(known, F.col("v") * F.col("w") / (F.col("v") + F.col("w"))).otherwise(F.col("w")).alias("u"),
            ),
            f"hierarchy-{d}",
        )
    settled = merged[0].select("node", DATE, "y_pred", F.col("m").alias("y"), "s", "w")
    out = settled.select("node", F.lit(0).alias("depth"), DATE, "y_pred", F.col("y").alias("y_reconciled"))
    for d in range(1, depth + 1):
        above = settled.select(F.col("node").alias("parent"), DATE, ((F.col("y") - F.col("s")) / F.col("w")).alias("gain"))
        below = merged[d].join(above, ["parent", DATE]).withColumn("y", F.col("m") + F.col("u") * F.col("gain"))
        if d < depth:
            settled = below.select("node", DATE, "y_pred", "y", "s", "w")
        out = out.unionByName(
            below.select("node", F.lit(d).alias("depth"), DATE, "y_pred", F.col("y").alias("y_reconciled"))
        )
    return out
