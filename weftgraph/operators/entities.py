"""Counts of named entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_chunk(entities: DataFrame) -> DataFrame:
    """``(name, entity, chunk_id, count)``; rows with a null key are not counted."""
    return entities.na.drop(subset=["name", "entity", "chunk_id"]).groupBy("name", "entity", "chunk_id").agg(F.count("*").alias("count"))


def totals(counted: DataFrame) -> DataFrame:
    """``(name, entity, count, chunk_id)``: sums, and the chunks in order, joined by commas."""
    return counted.groupBy("name", "entity").agg(F.sum("count").alias("count"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunk_id"))


def top(counted: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` entities with the largest sums; ties in order of name and entity. Chunks are listed for those only."""
    summed = counted.groupBy("name", "entity").agg(F.sum("count").alias("count"))
    return summed.orderBy(F.desc("count"), "name", "entity").limit(n)
