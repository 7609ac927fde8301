"""Weighted PageRank by a driver loop; each round is one join and one aggregation, written to the shared folder.

Written rounds keep the plan short and survive lost executors. Ranks are co-partitioned with their own edges
only through the join key; the mass of nodes without outgoing edges is a one-row table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph.build import in_degree_centrality, nodes_of
from weftgraph.storage import cut, drop


def pagerank(edges: DataFrame, weight: str | None = "weight", alpha: float = 0.85, max_iter: int = 200, tol: float = 1e-6, fixed: int | None = None) -> tuple[DataFrame, bool]:
    """``(id, pagerank)``, and whether the sum of changes fell under ``tol`` times the number of nodes within ``max_iter`` rounds.

    Parallel edges add up. With ``fixed``, so many rounds run whatever the change. An empty graph has no ranks and counts as converged.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    summed = edges.select("src", "dst", w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = summed.groupBy("src").agg(F.sum("w").alias("total")).where("total > 0")
    share = cut(summed.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "shares")
    nodes = cut(nodes_of(edges).join(out.select(F.col("src").alias("id"), F.lit(True).alias("gives")), "id", "left"), "vertices")
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank")), True
    now = cut(nodes.select("id", F.coalesce("gives", F.lit(False)).alias("gives"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")), "ranks")
    for round_ in range(fixed if fixed is not None else max_iter):
        lost = now.agg(F.coalesce(F.sum(F.when(~F.col("gives"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        got = share.join(now.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n
        step = now.join(got, "id", "left").join(F.broadcast(lost)).withColumn("new", rank)
        step = cut(step.select("id", "gives", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("change")), "ranks")
        drop(now)
        now = step
        if fixed is None and now.agg(F.sum("change")).first()[0] < tol * n:
            return now.select("id", F.col("rank").alias("pagerank")), True
    return now.select("id", F.col("rank").alias("pagerank")), fixed is not None


#: By mode, the attempts before in-degree centrality: label, rounds and tolerance.
ATTEMPTS = {"directed": (("pagerank", 100, 1e-6), ("pagerank (loose)", 500, 1e-5)), "pipeline": (("pagerank", 200, 1e-6),)}


def rank_or_fall_back(edges: DataFrame, weight: str | None = "weight", mode: str = "directed") -> tuple[DataFrame, str]:
    """PageRank as the mode tries it; if that doesn't converge, in-degree centrality. The label says which."""
    for label, rounds, tol in ATTEMPTS[mode]:
        ranks, converged = pagerank(edges, weight, max_iter=rounds, tol=tol)
        if converged:
            return ranks, label
    return in_degree_centrality(edges).withColumnRenamed("centrality", "pagerank"), "in-degree centrality"
