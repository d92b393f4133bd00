"""Connected components of a graph too large for one task.

Alternating stars: every edge is first hung from the smallest neighbour of
its larger ends, then from that of its smaller ends, until each node hangs
from the smallest node of its component. Hubs are joined, not grouped, so a
node with very many edges is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import drop, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = both.join(low, "a")
    if large:
        hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs from one other, which hangs from none."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    hung = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a")
    return twice.unionByName(hung).isEmpty()


def components(edges: DataFrame, made: list) -> DataFrame:
    """``a`` and the smallest node ``b`` that it is linked with, for every
    node but the smallest of its component. Edges are (a, b), any order.
    ``made`` gets the path of the result's table."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "component-edges", made)
    while not is_forest_of_stars(now):
        before = [made.pop()]
        now = written(star(star(now, True), False), "component-edges", made)
        drop(now.sparkSession, before)
    return now


def merged_labels(labels: DataFrame | None, links: DataFrame, made: list) -> DataFrame | None:
    """``a`` and its component's smallest node ``b`` (as ``components``) after
    further links: only the links between components found before are walked,
    with each component as one node."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links, made)
    for end in ("a", "b"):
        root = labels.select(F.col("a").alias(end), F.col("b").alias("root"))
        links = links.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    top = components(links, made)
    moved = labels.join(top.select(F.col("a").alias("b"), F.col("b").alias("root")), "b", "left") \
        .select("a", F.coalesce("root", "b").alias("b"))
    return written(moved.unionByName(top), "component-labels", made)
