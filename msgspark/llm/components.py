"""Connected components of an edge table by contraction, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    Each round maps a node to the smallest of itself and its neighbours and puts the edges between the mapped nodes;
    nothing but partial minima, equi-joins and distinct rows, so hubs are split like any other skewed key. Rounds
    grow with the logarithm of the longest shortest path. The maps of the rounds are followed at the end.
    """
    maps, current = [], written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"), "map")
        maps.append(step)
        ends = [step.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b")]
        current = written(current.join(ends[0], "a").join(ends[1], "b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct(), "edges")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].select("node", F.col("to").alias("component"))
    for step in maps[1:]:
        next_ = step.select(F.col("node").alias("component"), "to")
        found = found.join(next_, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(found, "components")
