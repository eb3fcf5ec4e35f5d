"""Fitted tree ensembles as tables, and their predictions as a walk of joins.

``tree_nodes`` gives one row per node, which other engines can read too. ``walk`` takes rows down every tree, one join per
level; ``regression`` and ``classes`` put the leaves together as the ensembles do. Both equal the model's own ``transform``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.operators.joining import broadcast_if_small, stored
from weatherloom.sources.writers import scratch_dir


def tree_nodes(model, spark) -> DataFrame:
    """``(tree, node, feature, threshold, left, right, value, stats, weight)`` of a fitted forest or boosted ensemble.

    Node 0 is the root; a leaf has ``feature`` -1. Values at or below the threshold go left. ``stats`` are the class counts
    of a classifier's node (moments for a regressor), ``weight`` is that of the tree in the ensemble. Categorical splits
    are not supported (the features here are plain numbers).
    """
    path = scratch_dir(spark, "trees")
    model.write().overwrite().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        n["split"]["featureIndex"].alias("feature"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["prediction"].alias("value"),
        n["impurityStats"].alias("stats"),
    )
    return nodes.join(weights, "tree")


def prepared(front: PipelineModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, x)``: the features as an array, assembled and scaled by the pipeline's own first two stages."""
    for stage in front.stages[:2]:
        df = stage.transform(df)
    return df.select(*keys, vector_to_array("_features").alias("x"))


def walk(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """The leaf of every row in every tree: the rows' columns but ``x``, and ``tree, value, stats, weight``.

    ``rows`` has an array ``x``; ``depth`` is that of the deepest tree. The nodes are broadcast where their counted size allows.
    """
    nodes = stored(nodes, "tree-nodes")
    small = broadcast_if_small(nodes)
    table = nodes if small is None else small
    split = table.select("tree", F.col("node").alias("_at"), "feature", "threshold", "left", "right")
    roots = nodes.filter("node = 0").select("tree")
    placed = rows.crossJoin(F.broadcast(roots)).withColumn("_at", F.lit(0))  # one row per tree
    for _ in range(depth):
        met = placed.join(split, ["tree", "_at"])
        to = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        step = F.when(F.col("feature") < 0, F.col("_at")).otherwise(to)
        placed = met.withColumn("_at", step).drop("feature", "threshold", "left", "right")
    leaves = table.select("tree", F.col("node").alias("_at"), "value", "stats", "weight")
    return placed.join(leaves, ["tree", "_at"]).drop("x", "_at")


def regression(leaves: DataFrame, keys: Sequence[str], boosted: bool) -> DataFrame:
    """``(keys, prediction)``: the mean over a forest's trees, the weighted sum over a boosted ensemble's."""
    found = F.sum(F.col("value") * F.col("weight")) if boosted else F.avg("value")
    return leaves.groupBy(*keys).agg(found.alias("prediction"))


def classes(leaves: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``(keys, prediction)``: the class with the largest sum of shares over the trees; of equal ones the first label."""
    shares = leaves.select(*keys, F.posexplode("stats").alias("class", "n"), F.aggregate("stats", F.lit(0.0), lambda a, x: a + x).alias("all"))
    votes = shares.groupBy(*keys, "class").agg(F.sum(F.try_divide("n", "all")).alias("votes"))
    best = votes.groupBy(*keys).agg(F.max_by("class", F.struct("votes", -F.col("class"))).alias("class"))
    return best.select(*keys, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("class") + 1).alias("prediction"))
