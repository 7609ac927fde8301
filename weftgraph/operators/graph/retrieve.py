"""Nodes near many seeds at once: personalised PageRank by forward push.

Every seed begins with a residual of 1 at its own node. In a round each entry (seed, node) whose residual is over ``eps`` times the node's degree is pushed: a share
``alpha`` of it becomes score and the rest goes to the neighbours by weight. Only entries that hold something are rows, and their number for a seed is bounded by
1 / (alpha * eps) whatever the size of the graph. Once none is over its limit, a score is less than the true one by at most ``eps`` times the node's degree. At the
end every residual gives its node the share ``alpha`` that it would get by a push, which brings scores nearer to the true ones from below: so neighbours of a seed that are
too large to be pushed, as the hubs of a graph are, have a score too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import cut, drop


def push(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, eps: float = 1e-3, rounds: int | None = None) -> DataFrame:
    """``(seed, node, score, residual, bound)`` on the undirected graph of ``(src, dst, weight)``, for every ``(seed)``.

    ``bound`` is how far the score may be under the true one: ``eps`` times the sum of the node's weights, or with a number of ``rounds`` that ends before all
    residuals are small, the sum of the seed's residuals if that is more. Parallel edges add up, a loop counts once; edges with a null end or no positive weight are left out.
    Seeds that aren't in the graph give no rows. Seeds that repeat are one.
    """
    rows = edges.where("src is not null and dst is not null and weight > 0").select("src", "dst", F.col("weight").cast("double").alias("w"))
    both = rows.unionByName(rows.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = cut(both, "neighbours")
    degree = cut(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")), "degrees")
    to = degree.select(F.col("node").alias("dst"), F.col("degree").alias("to_degree"))
    share = both.join(degree.withColumnRenamed("node", "src"), "src").join(to, "dst").select(F.col("src").alias("node"), F.col("dst").alias("to"), "to_degree", (F.col("w") / F.col("degree")).alias("share"))
    share = cut(share, "shares")
    begin = seeds.select("seed").distinct().join(degree, seeds["seed"] == degree["node"])
    now = cut(begin.select("seed", "node", "degree", F.lit(0.0).alias("score"), F.lit(1.0).alias("residual")), "pushed")
    over = F.col("residual") > eps * F.col("degree")
    k = 0
    while (rounds is None or k < rounds) and not now.where(over).isEmpty():
        k += 1
        sent = now.where(over).join(share, "node").select("seed", F.col("to").alias("node"), F.col("to_degree").alias("degree"), F.lit(0.0).alias("score"), ((1 - alpha) * F.col("residual") * F.col("share")).alias("residual"))
        kept = now.select("seed", "node", "degree", (F.col("score") + F.when(over, alpha * F.col("residual")).otherwise(0.0)).alias("score"), F.when(over, 0.0).otherwise(F.col("residual")).alias("residual"))
        step = cut(sent.unionByName(kept).groupBy("seed", "node").agg(F.first("degree").alias("degree"), F.sum("score").alias("score"), F.sum("residual").alias("residual")), "pushed")
        drop(now)
        now = step
    drop(both, share)
    limit = eps * F.col("degree")
    open_ = now.groupBy("seed").agg(F.max(F.when(over, 1).otherwise(0)).alias("open"), F.sum("residual").alias("left"))
    score, rest = F.col("score") + alpha * F.col("residual"), (1 - alpha) * F.col("residual")
    return now.join(open_, "seed").select("seed", "node", score.alias("score"), rest.alias("residual"), F.when(F.col("open") == 1, F.greatest(limit, "left")).otherwise(limit).alias("bound"))


def retrieve_neighbours(edges: DataFrame, seeds: DataFrame, k: int = 10, alpha: float = 0.15, eps: float = 1e-3, rounds: int | None = None) -> DataFrame:
    """``(seed, rank, node, score, bound)``: each seed's ``k`` best nodes but itself. Scores that are equal to nine places are in order of node."""
    found = push(edges, seeds, alpha, eps, rounds).where("node <> seed and score > 0")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "node"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("seed", "rank", "node", "score", "bound")
