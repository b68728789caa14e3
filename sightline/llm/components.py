"""Connected components of an edge table by least labels, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least node that links reach from ``node``.

    Each round takes the least label among a node's neighbours and then the label of that
    label, so paths shorten by doubling. Nodes without an edge to another node do not appear.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        roots = step.select(F.col("node").alias("root"), F.col("component").alias("further"))
        step = step.join(roots, step["component"] == roots["root"], "left")
        step = materialize(step.select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "before"))
        labels = step.select("node", "component")
        if step.filter(F.col("component") != F.col("before")).isEmpty():
            return labels
