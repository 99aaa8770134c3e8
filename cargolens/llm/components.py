"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut


def _step(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component): the smallest label among a node, its neighbours and, once, the label of that label."""
    around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
    least = around.unionByName(labels).groupBy("node").agg(F.min("component").alias("label"))
    of_label = labels.select(F.col("node").alias("label"), F.col("component").alias("jump"))
    return least.join(of_label, "label", "left").select("node", F.least("label", F.coalesce("jump", "label")).alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    A step takes the smallest label among the neighbours (a join and a minimum that is
    combined before the shuffle) and then the label of that label, so that the number of
    steps grows with the logarithm of a component's diameter. Labels are kept in reliable
    storage after every second step; joins deal both sides anew, which lets adaptive
    execution split a node with very many neighbours. Edges with a null end are ignored.
    """
    e = edges.select(F.col("a"), F.col("b")).filter("a is not null and b is not null and a <> b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = cut(first.select("node", F.least("node", "m").alias("component")))
    while True:
        new = _step(both, _step(both, labels))
        old = labels.withColumnRenamed("component", "old")
        new = cut(new.join(old, "node").select("node", "component", (F.col("component") != F.col("old")).alias("moved")))
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels
