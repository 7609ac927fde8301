"""Vertices, edges and the simple measures on them. An edge table has ``src`` and ``dst``; loops count twice in degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import cut


def edges_of(merged: DataFrame) -> DataFrame:
    """Directed edges with title, label, weight and thickness, from ``rendered`` merged edges."""
    return merged.select(
        F.col("source").alias("src"), F.col("target").alias("dst"), F.col("description").alias("title"), "label", "weight", F.col("weight").alias("value")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    """Every end of an edge once."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def last_written(rows: DataFrame, first: str = "node_1", second: str = "node_2", scale: float = 4.0, title: str = "edge", weight: str = "count") -> DataFrame:
    """Undirected edges ``(src, dst, title, weight)`` of a table with one row per direction.

    Writing the rows in key order, the row with ``first`` > ``second`` comes last and gives title and weight. Weights
    are not summed over directions; they are divided by ``scale``.
    """
    ends = rows.select(F.least(first, second).alias("src"), F.greatest(first, second).alias("dst"), F.col(first).alias("_first"), F.struct(F.col(title).alias("title"), (F.col(weight) / scale).alias("weight")).alias("_v"))
    return ends.groupBy("src", "dst").agg(F.max_by("_v", "_first").alias("_v")).select("src", "dst", "_v.title", "_v.weight")


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of ends once, least first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` on the undirected graph."""
    ends = undirected(edges)
    return ends.select(F.col("src").alias("id")).union(ends.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def in_degree_centrality(edges: DataFrame) -> DataFrame:
    """``(id, centrality)``: incoming edges over the number of other nodes (1 for a single node)."""
    ends = edges.select("src", "dst").distinct()
    counted = ends.select(F.col("dst").alias("id"), F.lit(1).alias("n")).union(ends.select("src", F.lit(0))).groupBy("id").agg(F.sum("n").alias("n"))
    others = counted.agg((F.count("*") - 1).alias("others"))  # one row
    ratio = F.when(F.col("others") > 0, F.col("n") / F.col("others")).otherwise(1.0)
    return counted.join(F.broadcast(others)).select("id", ratio.alias("centrality"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, least and largest weight. The edges are written once and read for both."""
    once = cut(edges.select("src", "dst", "weight"), "edges")
    totals = once.agg(F.count("*").alias("edges"), F.min("weight").alias("least_weight"), F.max("weight").alias("largest_weight"))
    return totals.join(F.broadcast(nodes_of(once).agg(F.count("*").alias("nodes"))))
