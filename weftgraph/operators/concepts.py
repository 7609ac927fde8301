"""Concept co-occurrence with importance (the legacy mode).

The filter on importance looks at left mentions only, so the two sides of the self-join differ. Both are first
summed to one row per chunk and entity; means over the pairs of mentions follow from counts and sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summed(concepts: DataFrame, side: str) -> DataFrame:
    own = concepts.where("chunk_id is not null and entity is not null").groupBy("chunk_id", F.col("entity").alias(f"entity_{side}"))
    return own.agg(F.count("*").alias(f"n_{side}"), F.count("importance").alias(f"c_{side}"), F.coalesce(F.sum("importance"), F.lit(0)).alias(f"s_{side}"))


def cooccurrence(concepts: DataFrame, least_importance: int = 2, chunks: bool = True) -> DataFrame:
    """``(entity_L, entity_R, importance_L, importance_R, count[, chunks])`` of pairs of different entities in a chunk."""
    left = _summed(concepts.where((F.col("importance") >= least_importance) | F.col("importance").isNull()), "L")
    joined = left.join(_summed(concepts, "R"), "chunk_id").where("entity_L <> entity_R").withColumn("n", F.col("n_L") * F.col("n_R"))
    mean = lambda s, c: F.sum(F.expr(s)) / F.nullif(F.sum(F.expr(c)), F.lit(0))
    out = [mean("s_L * n_R", "c_L * n_R").alias("importance_L"), mean("n_L * s_R", "n_L * c_R").alias("importance_R"), F.sum("n").alias("count")]
    if chunks:
        each = F.array_sort(F.collect_list(F.struct("chunk_id", "n")))
        out.append(F.array_join(F.flatten(F.transform(each, lambda x: F.array_repeat(x["chunk_id"], x["n"].cast("int")))), ",").alias("chunks"))
    return joined.groupBy("entity_L", "entity_R").agg(*out)


def importance(edges: DataFrame) -> DataFrame:
    """Nodes with the mean of their edges' left importance (each edge counts once)."""
    return edges.groupBy(F.col("entity_L").alias("entity")).agg(F.avg("importance_L").alias("importance"))


def coloured(nodes: DataFrame, colours: DataFrame, key: str = "entity") -> DataFrame:
    """Nodes with their community's group and colour, which stay null for nodes in none."""
    return nodes.join(colours.withColumnRenamed("node", key), key, "left")
