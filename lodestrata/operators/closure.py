"""Reachability over edges, with set semantics: cycles and diamonds end by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import Scratch


def reach(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """node, distance of everything reachable from the nodes of `start` (column node), these included at 0.

    A frontier is joined with the edges, made distinct and rid of what was seen; each round is written to the shared folder.
    Rounds are as many as the longest shortest path.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    e = scratch.table(edges.select(F.col(source).alias("node"), F.col(target).alias("to")).filter("node is not null and to is not null").distinct())
    frontier = scratch.table(start.select("node").filter("node is not null").distinct().withColumn("distance", F.lit(0)))
    seen, n = frontier, 0
    while not frontier.isEmpty():
        n += 1
        step = e.join(frontier.select("node"), "node", "left_semi").select(F.col("to").alias("node")).distinct()
        frontier = scratch.table(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(n)))
        seen = seen.unionByName(frontier)
    return seen


def descendants(edges: DataFrame, roots: DataFrame, child: str, parent: str) -> DataFrame:
    """reach from the roots downwards."""
    return reach(edges, roots, parent, child)


def ancestors(edges: DataFrame, nodes: DataFrame, child: str, parent: str) -> DataFrame:
    """reach from the nodes upwards."""
    return reach(edges, nodes, child, parent)


def missing(required: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The required values that are not known."""
    return required.select(column).distinct().join(known.select(column), column, "left_anti")
