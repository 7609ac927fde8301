"""Sizes, groups and colours of nodes."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import hls_hex

DEFAULT_COLOUR = "#aaaaaa"


def colours(communities: DataFrame, seed: int | None = None, palette: str = "even") -> DataFrame:
    """``(node, group, color)``: hues spread evenly over the groups, in order, or permuted by ``seed``.

    ``even`` is the directed mode's palette; ``soft`` is that of the other modes: hues begin at 0.01, colours are paler
    and lighter, and the first group takes the last of them. The permutation steps through the places by a stride that has
    no factor in common with their number, so it needs no list of the groups.
    """
    groups = communities.select("group").distinct()
    total = groups.agg(F.count("*").alias("total"))  # one row
    place: Column = F.col("group") - 1
    if palette == "soft":
        place = F.col("total") - F.col("group")
    if seed is not None:
        n = max(1, groups.count())
        draw = random.Random(seed)
        stride = next(k for k in iter(lambda: draw.randrange(1, n + 1), None) if math.gcd(k, n) == 1)
        place = F.pmod(place.cast("long") * stride + draw.randrange(n), F.lit(n))
    hue = F.pmod(place, F.col("total")) / F.col("total")
    made = hls_hex(hue) if palette == "even" else hls_hex(F.pmod(hue + 0.01, F.lit(1.0)), 0.6, 0.65, rounded=True)
    coloured = groups.join(F.broadcast(total)).select("group", made.alias("color"))
    return communities.join(coloured, "group").select("node", "group", "color")


def pipeline_size(rank: Column | str) -> Column:
    """At least 10; 1000 times the rank, truncated."""
    return F.greatest(F.lit(10), (F.col(rank) * 1000).cast("int")) if isinstance(rank, str) else F.greatest(F.lit(10), (rank * 1000).cast("int"))


def directed_size(rank: str, least: str, largest: str) -> Column:
    """10 to 60 by where the rank stands between the least and the largest (a range of 0 counts as 1)."""
    span = F.col(largest) - F.col(least)
    return (10 + 50 * ((F.col(rank) - F.col(least)) / F.when(span == 0, 1.0).otherwise(span))).cast("int")


def concept_size(importance: str) -> Column:
    return F.col(importance) * 6


def styled(nodes: DataFrame, ranks: DataFrame, communities: DataFrame, mode: str = "directed") -> DataFrame:
    """``(id, group, color, size)`` for every node; nodes without community or rank get group 0, grey, and the least rank."""
    bounds = ranks.agg(F.min("pagerank").alias("least"), F.max("pagerank").alias("largest"))  # one row
    joined = nodes.select("id").join(communities.withColumnRenamed("node", "id"), "id", "left").join(ranks, "id", "left").join(F.broadcast(bounds))
    rank = joined.withColumn("pagerank", F.coalesce("pagerank", "least"))
    size = directed_size("pagerank", "least", "largest") if mode == "directed" else pipeline_size("pagerank")
    return rank.select("id", F.coalesce("group", F.lit(0)).alias("group"), F.coalesce("color", F.lit(DEFAULT_COLOUR)).alias("color"), size.alias("size"))
