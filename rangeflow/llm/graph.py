"""Connected components by hooking to the smallest neighbour and contracting the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's name is its smallest node.

    Each round hooks every node to its smallest neighbour, follows one hook further, and keeps only edges between different
    hooks, so the nodes still open at least halve.  Labels and edges of a round are written tables.
    """
    open_ = scratch.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}_edges")
    both = open_.select("a").union(open_.select("b")).distinct()
    labels = scratch.write(both.select(F.col("a").alias("node"), F.col("a").alias("component")), f"{name}_labels")
    k = 0
    while not open_.isEmpty():
        ends = open_.union(open_.select("b", "a"))
        hook = ends.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        hook = scratch.write(hook, f"{name}_hook{k}")
        further = hook.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        hook = scratch.write(hook.join(further, "to", "left").select("a", F.coalesce("beyond", "to").alias("to")), f"{name}_jump{k}")
        labels = scratch.write(
            labels.join(hook.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")),
            f"{name}_labels{k}",
        )
        open_ = scratch.write(
            open_.join(hook.select("a", F.col("to").alias("left_end")), "a")
            .join(hook.select(F.col("a").alias("b"), F.col("to").alias("right_end")), "b")
            .select(F.least("left_end", "right_end").alias("a"), F.greatest("left_end", "right_end").alias("b"))
            .where("a <> b")
            .distinct(),
            f"{name}_edges{k}",
        )
        k += 1
    return labels
