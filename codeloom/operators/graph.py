"""Circles in the graph of factors: its strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import storage


def lowest_source(edges: DataFrame) -> DataFrame:
    """(node, low): for each node of edges(src, dst) the smallest node from which it can be reached, itself included.

    In each round a node takes the smallest of its own label, its predecessors' labels, and the label of its label, as what
    reaches the label's node reaches the node too; so labels travel along paths in strides that double. Minima are
    combined before the shuffle, so hubs cost no more than other nodes.
    """
    labels = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("low", F.col("node"))
    labels = storage.written(labels, "labels")
    while True:
        met = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("low").alias("met"))
        step = labels.join(met, labels["node"] == met["dst"], "left").select("node", "low", F.least("low", "met").alias("next"))
        step = storage.written(step, "labels")
        ahead = step.select(F.col("node").alias("next"), F.col("next").alias("ahead"))
        out = storage.written(step.join(ahead, "next").select("node", F.least("next", "ahead").alias("low"), (F.col("low") != F.least("next", "ahead")).alias("moved")), "labels")
        labels = out.select("node", "low")
        if out.where("moved").isEmpty():
            return labels


def trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """edges without some that can't be in a circle: those that leave a node without predecessors or enter one without successors."""
    for _ in range(rounds):
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst")
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes of edges(src, dst) that lie on a circle with others: the component is named by its smallest node.

    Each round labels nodes with the smallest node that reaches them. A component has one label, so edges between
    labels go. Within a label, its own node reaches all; the nodes that reach it in turn are its component. These go, and the rest is labelled anew, until
    no edge is left. The driver only counts. An edge from a node to itself is no circle, and null ends are none.
    """
    left, found = storage.written(edges.where("src <> dst").select("src", "dst").distinct(), "edges"), None
    while True:
        left = storage.written(trimmed(left), "edges")
        if left.isEmpty():
            break
        colour = lowest_source(left)
        of = lambda side: colour.select(F.col("node").alias(side), F.col("low").alias(f"{side}_colour"))
        left = left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst")
        left = storage.written(left, "edges")
        back = lowest_source(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node", F.col("low").alias("back"))
        part = storage.written(colour.join(back, "node").where("low = back").select("node", F.col("low").alias("component")), "components")
        found = part if found is None else found.unionAll(part)
        gone = part.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    if found is None:
        found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "component").select("node", "component", "size")
