"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.staging import Workspace


def components(pairs: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, component`` for each node of ``pairs`` (columns ``a, b``); a component is named after its smallest node.

    Every node, and the node it is labelled with, takes the smallest label among itself and its neighbours, then the label of
    that, until nothing changes. Minima fold within tasks; both sides of each join are stored tables, so
    that Spark splits a node with very many neighbours. Pairs with a null are left out; repeated
    pairs and pairs of a node with itself are allowed; no pairs give no rows.
    """
    pairs = pairs.where("a is not null and b is not null")
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = workspace.stage(edges, "edges")
    labels = workspace.stage(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    before = None
    while True:
        state = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).head()[0]
        if state == before:
            return labels.withColumnRenamed("label", "component")
        before = state
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        seen = labels.join(near, labels["node"] == near["a"])
        # a node's label moves on with it, so that long chains close up
        own = seen.select("node", F.least("label", "low").alias("label"))
        moved = seen.select(F.col("label").alias("node"), F.col("low").alias("label"))
        lowest = own.unionByName(moved).groupBy("node").agg(F.min("label").alias("label"))
        lowest = workspace.stage(lowest, "labels")
        there = lowest.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = workspace.stage(lowest.join(there, "label").select("node", F.col("far").alias("label")), "labels")
