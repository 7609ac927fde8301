"""The backbone of a weighted graph by the disparity filter (Serrano, Boguna and Vespignani 2009).

A node's weights are compared with a random division of their sum among its edges: an edge whose share would be as large with a probability under ``level``
is significant for that end, and stays if it is for one end. So light edges of light nodes stay and heavy edges of heavy nodes may go, which a threshold of weight can't do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import cut


def _chance(weight: str, strength: str, degree: str):
    """The probability of a share as large; 1 at the only edge of an end, which tells nothing."""
    return F.when(F.col(degree) > 1, F.pow(1 - F.col(weight) / F.col(strength), F.col(degree) - 1)).otherwise(1.0)


def disparity(edges: DataFrame, directed: bool = True, single: bool = False) -> DataFrame:
    """``(src, dst, weight, chance)`` of ``(src, dst, weight)``: the less of an edge's chances at its ends.

    Parallel edges add up. Edges with a null end, a null weight or one of 0 and less are left out. A directed edge is tested among those that leave its source
    and those that reach its target; an undirected one, given in either direction, among all at each end (a loop once).
    ``single`` edges are known to have no parallels (in their direction, if directed), and aren't shuffled to be added up.
    """
    ends = ["src", "dst"]
    rows = edges.where("src is not null and dst is not null and weight > 0")
    if not directed:
        rows = rows.select(F.least(*ends).alias("src"), F.greatest(*ends).alias("dst"), "weight")
    weight = F.col("weight").cast("double")
    once = cut(rows.select(*ends, weight.alias("weight")) if single else rows.groupBy(*ends).agg(F.sum(weight).alias("weight")), "weights")
    sums = [F.sum("weight").alias("strength"), F.count("*").alias("degree")]
    if directed:
        of_end = {end: once.groupBy(end).agg(*sums) for end in ends}
    else:
        both = once.select(F.col("src").alias("id"), "weight").unionByName(once.where("src <> dst").select(F.col("dst").alias("id"), "weight"))
        every = cut(both.groupBy("id").agg(*sums), "strengths")
        of_end = {end: every.withColumnRenamed("id", end) for end in ends}
    for end in ends:
        once = once.join(of_end[end].withColumnsRenamed({"strength": f"strength_{end}", "degree": f"degree_{end}"}), end)
    chances = [_chance("weight", f"strength_{end}", f"degree_{end}") for end in ends]
    return once.select(*ends, "weight", F.least(*chances).alias("chance"))


def backbone(edges: DataFrame, level: float = 0.05, directed: bool = True, single: bool = False) -> DataFrame:
    """The edges of ``disparity`` whose chance is under ``level``."""
    return disparity(edges, directed, single).where(F.col("chance") < level)
