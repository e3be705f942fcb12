"""Connected components of an edge table by minimum labels and pointer jumping.

Each round takes the smallest label among a node's neighbours (a map-side
aggregate, so a node with very many edges is one row a task) and then the label
of its label; rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> node, component (the component's smallest node)."""
    both = kept(edges.select("a", "b").where("a <> b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "cc-edges")
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                  .withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = kept(step.join(jump, F.col("label") == F.col("n2"), "left").select(
            "node", "old", F.least("label", F.coalesce("l2", "label")).alias("label")), "cc-labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
