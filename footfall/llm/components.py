"""Connected components by smallest label, with shortcuts, as joins over edge and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from footfall.session import materialize


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it is linked to.

    Each round takes over the smallest label among a node's neighbours and then its label's own
    label, so that long chains shrink by halves; it ends when no label changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias(label)), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col(label).alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        taken = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col(label).alias("old"), F.least(label, "m").alias(label))
        taken = materialize(taken, "labels")
        short = taken.select(F.col("node").alias(label), F.col(label).alias("further"))
        seen = Observation()
        labels = materialize(taken.join(short, label).select(
            "node", F.least(label, "further").alias(label), (F.least(label, "further") < F.col("old")).alias("moved")
        ).observe(seen, F.max("moved").alias("moved")), "labels").drop("moved")
        if not seen.get["moved"]:
            return labels
