"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditspark.operators.joins import fits_broadcast, lookup_join

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for edges with columns a and b.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so labels travel twice as far as before; all steps are
    aggregates and joins.  A node with many links and the root of a large
    component are hot keys: both joins look up in a table of one row per node,
    broadcast if it is small, else with such keys spread over tasks.  Rounds end
    when no label changes.  Nulls never link.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = store(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = store(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        heard = lookup_join(edges, labels.withColumnRenamed("node", "b"), ["b"], "inner", ["a"])
        heard = heard.select(F.col("a").alias("node"), "root")
        near = labels.unionByName(heard).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if not fits_broadcast(up):
            near = store(near, "near")  # read again to find the hot roots
        fresh = store(
            lookup_join(near, up, ["root"], "inner", ["node"]).join(labels.withColumnRenamed("root", "old"), "node")
            .select("node", F.col("above").alias("root"), (F.col("above") != F.col("old")).alias("changed")),
            "labels",
        )
        labels = fresh.select("node", "root")
        if fresh.where("changed").isEmpty():
            return labels
