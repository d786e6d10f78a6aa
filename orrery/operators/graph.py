"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stash


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Each round lets a node take the smallest label among its neighbours and then the label
    of its label (pointer jumping), so rounds grow with the logarithm of a component's
    diameter. Both joins read two written tables, which lets adaptive execution split the
    shuffle partition of a hub or of a label that many nodes share. Null ends and loops are
    ignored; no edges give no rows. Tables of
    earlier rounds are deleted. Only a count returns to the driver.
    """
    half = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = stash(half.union(half.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label")
        heard = stash(
            near.unionByName(labels)
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        root = heard.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = stash(heard.join(root, "label").select("node", F.least("label", "root").alias("label")))
        changed = not after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        discard(heard, labels)
        if not changed:
            discard(both)
            return after.select("node", F.col("label").alias("component"))
        labels = after
