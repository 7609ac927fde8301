"""Core numbers by iterated h-indices (Lue, Zhou, Zhang and Stanley 2016).

The core number of a node is the largest k for which it is in a part of the graph where every node has k neighbours or more. Beginning with degrees, each node
takes the h-index of its neighbours' values, until none changes: no node is peeled off one by one, and the number of rounds is far below that of nodes.
A node's neighbours are counted by value, so a hub is as many rows as its neighbours have different values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph.build import undirected
from weftgraph.storage import cut, drop


def core_numbers(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(id, core)`` on the undirected graph without loops and repeated edges; nodes without another neighbour are left out.

    After so many ``rounds``, where given, values are upper bounds.
    """
    plain = undirected(edges).where("src <> dst")
    both = cut(plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "neighbours")
    now = cut(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")), "cores")
    at_least = Window.partitionBy("id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = 0
    while rounds is None or k < rounds:
        k += 1
        heard = both.join(now.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.col("core").alias("other")).join(now, "id")
        counted = heard.groupBy("id", F.least("other", "core").alias("value")).agg(F.count("*").alias("n"), F.first("core").alias("core"))
        ranked = counted.withColumn("h", F.least("value", F.sum("n").over(at_least)))
        step = cut(ranked.groupBy("id").agg(F.max("h").alias("core"), F.first("core").alias("before")), "cores")
        settled = step.where("core <> before").isEmpty()
        drop(now)
        now = step.select("id", "core")
        if settled:
            break
    return now
