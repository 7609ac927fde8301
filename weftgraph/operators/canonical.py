"""Concepts that are spelt differently become one, and a graph is contracted to such concepts.

Names are sets of short runs of characters; similar ones are linked (``similar``), linked ones are one concept, and its name is the one that is
mentioned most. The contracted graph has an edge for each pair of concepts, with the sums of the edges between their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph.components import connected_components
from weftgraph.operators.similar import grams, similar_sets
from weftgraph.storage import cut


def canonical_names(names: DataFrame, percent: int = 75, q: int = 4) -> DataFrame:
    """``(name, canonical, mentions, n_names)`` of ``(name, mentions)``: every name once, its concept's name, and how many names that has.

    Mentions of rows that repeat a name are summed, null ones count nothing; null names are left out. Of names mentioned as often the least is the concept's.
    """
    once = cut(names.where("name is not null").groupBy("name").agg(F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions")), "names")
    links = similar_sets(once.select(F.col("name").alias("id"), grams("name", q).alias("tokens")), percent)
    parts = connected_components(links, "a", "b").withColumnRenamed("id", "name")
    members = cut(once.join(parts, "name", "left").withColumn("component", F.coalesce("component", "name")), "concepts")
    best = members.groupBy("component").agg(F.min(F.struct(-F.col("mentions"), "name")).alias("best"), F.count("*").alias("n_names"))
    return members.join(best, "component").select("name", F.col("best.name").alias("canonical"), "mentions", "n_names")


def contract(edges: DataFrame, canonical: DataFrame, loops: bool = False) -> DataFrame:
    """``(src, dst, weight, n_edges)`` between concepts: the sums and numbers of edges ``(src, dst, weight)`` between their names.

    A name that ``canonical`` doesn't hold is its own concept. Edges within a concept are left out unless ``loops``. Edges with a null end are left out.
    """
    rows = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_edges"))
    for end in ("src", "dst"):
        names = canonical.select(F.col("name").alias(end), F.col("canonical").alias(f"{end}_concept"))
        rows = rows.join(names, end, "left").withColumn(end, F.coalesce(f"{end}_concept", end)).drop(f"{end}_concept")
    summed = rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n_edges").alias("n_edges"))
    return summed if loops else summed.where("src <> dst")
