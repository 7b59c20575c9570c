"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, label): every node that has an edge, labelled by one node of its component.

    Each round sends every node to the smallest of itself and its neighbours, and contracts the edges along it, until no
    edge is left. Minima are combined before the shuffle, so a node with very many edges costs no more than its edges.
    Rounds are written to the shared folder, so that a lost executor costs one round at most.
    """
    edges = cut_lineage(edges.filter("a != b").select("a", "b"))
    labels = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = cut_lineage(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("least")).select("child", F.least("child", "least").alias("parent")))
        labels = cut_lineage(labels.join(parents, labels["label"] == parents["child"], "left").select("node", F.coalesce("parent", "label").alias("label")))
        a = parents.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a != b").distinct())
    return labels
