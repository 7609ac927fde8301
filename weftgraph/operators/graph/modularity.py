"""Communities by modularity, level by level (Louvain), with connected groups (as Leiden has them).

In a round, half of the nodes, by the MD5 of node and round, look at the communities of their neighbours and move to the one whose join raises modularity most,
if it does; the other half stays, so that two nodes don't swap for ever. When rounds bring nothing more, communities that aren't connected are taken apart, which never
lowers modularity, each community becomes a node of a smaller graph, and the rounds begin again on that, until no community joins another.

A round is equi-joins and partially aggregated groupings of a table with a row for each edge; strengths of communities and the weight of the whole graph are
sums. A hub's edges are summed by community before they are compared. Nothing but one-row sums comes to the driver, as no side of a join is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph.build import nodes_of
from weftgraph.operators.graph.community import numbered
from weftgraph.operators.graph.components import connected_components
from weftgraph.storage import apart, cut, scratch

#: Rounds of a level, levels, and the rise of modularity that counts.
ROUNDS, LEVELS, RISE = 20, 20, 1e-7


def _both_ways(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)``: each edge in both directions, a loop once with twice its weight, so that the weights of a node sum to its strength."""
    once = edges.where("src is not null and dst is not null and w > 0")
    loop = F.col("src") == F.col("dst")
    turned = once.where(~loop).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return once.select("src", "dst", F.when(loop, 2 * F.col("w")).otherwise(F.col("w")).alias("w")).unionByName(turned).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _labelled(both: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the communities of both ends."""
    own, other = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return both.join(apart(own), "src").join(apart(other), "dst")


def _quality(both: DataFrame, strengths: DataFrame, labels: DataFrame, total: float) -> float:
    inside = _labelled(both, labels).where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("q")).select(F.col("q") / total)
    squares = strengths.join(apart(labels), "id").groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("q")).select(-F.col("q") / total**2)
    return sum(r[0] for r in inside.union(squares).collect())  # two rows


def modularity(edges: DataFrame, groups: DataFrame, weight: str | None = "weight") -> float:
    """Modularity of ``(node, group)`` on the undirected graph: the share of weight inside groups above that of a random graph with the same strengths."""
    both = cut(_both_ways(edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))), "both")
    strengths = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    total = both.agg(F.sum("w")).first()[0]
    return _quality(both, strengths, groups.select(F.col("node").alias("id"), F.col("group").alias("label")), total) if total else 0.0


def _moved(both: DataFrame, strengths: DataFrame, labels: DataFrame, total: float, turn) -> DataFrame:
    """Labels after one round. The gain of a community is the weight to it less what chance gives it, with the node itself out of its own community."""
    k_of = strengths.join(apart(labels), "id").groupBy("label").agg(F.sum("k").alias("sum"))
    to = both.where("src <> dst").join(apart(labels.select(F.col("id").alias("dst"), "label")), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
    own = labels.select("id", F.col("label").alias("own")).join(apart(strengths), "id")
    stay = own.select("id", F.col("own").alias("label"), F.lit(0.0).alias("w"))  # leaving no neighbour behind is a choice too
    weights = to.unionByName(stay).groupBy("id", "label").agg(F.sum("w").alias("w"))
    rated = weights.join(apart(own), "id").join(apart(k_of), "label")
    gain = F.col("w") - F.col("k") * (F.col("sum") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / total
    best = rated.groupBy("id").agg(
        F.min(F.struct((-F.round(gain, 9)).alias("g"), "label")).alias("best"), F.max(F.when(F.col("label") == F.col("own"), F.round(gain, 9))).alias("kept"), F.first("own").alias("own")
    )
    moves = turn & (-F.col("best.g") > F.col("kept"))
    return best.select("id", F.when(moves, F.col("best.label")).otherwise(F.col("own")).alias("label"))


def _settled(both: DataFrame, total: float, rounds: int, seed: int) -> tuple[DataFrame, float, bool]:
    """Labels of a level, each that of a node of its community, their modularity, and whether any node moved."""
    strengths = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "strengths")
    best = cut(strengths.select("id", F.col("id").alias("label")), "labels")
    top, idle, moved, now = _quality(both, strengths, best, total), 0, False, best
    for r in range(rounds):
        turn = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(seed), F.lit(r))), 1, 1) < "8"
        now = cut(_moved(both, strengths, now, total, turn), "labels")
        quality = _quality(both, strengths, now, total)
        if quality > top + RISE:
            best, top, idle, moved = now, quality, 0, True
        else:
            idle += 1
            if idle == 3:
                break
    if not moved:
        return best, top, False
    inside = _labelled(both, best).where("a = b and src < dst").select("src", "dst")
    parts = connected_components(inside)
    return cut(best.join(apart(parts), "id", "left").select("id", F.coalesce("component", "id").alias("label")), "labels"), top, True


def modularity_communities(edges: DataFrame, weight: str | None = "weight", rounds: int = ROUNDS, levels: int = LEVELS, tries: int = 1) -> DataFrame:
    """``(node, group)`` on the undirected graph: groups from 1, in order of each one's least node; a node without an edge to another is its own.

    Parallel edges add up; edges without a positive weight hold nothing together. Of several ``tries``, which differ in who moves when, the best counts.
    """
    spark = edges.sparkSession
    with scratch(spark) as made:
        plain = cut(edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), "edges")
        first = cut(_both_ways(plain), "both")
        total = first.agg(F.sum("w")).first()[0]
        every = nodes_of(plain).where("id is not null")
        if not total:
            return made.keep(cut(numbered(every.select(F.col("id").alias("node"), F.col("id").alias("component"))), "communities"))
        found = max((_levels(first, total, rounds, levels, seed) for seed in range(tries)), key=lambda x: x[1])[0]
        # The label of a group is a node's of it, not always its least.
        heads = found.groupBy("label").agg(F.min("id").alias("component"))
        members = every.join(apart(found.join(apart(heads), "label")), "id", "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))
        return made.keep(cut(numbered(members), "communities"))


def _levels(both: DataFrame, total: float, rounds: int, levels: int, seed: int) -> tuple[DataFrame, float]:
    whole, top = None, 0.0
    for _ in range(levels):
        labels, top, moved = _settled(both, total, rounds, seed)
        whole = labels if whole is None else cut(whole.withColumnRenamed("label", "id_").join(apart(labels.withColumnRenamed("id", "id_")), "id_").select("id", "label"), "whole")
        if not moved:
            break
        # Loops already hold both directions, as do the sums of edges inside a community.
        both = cut(_labelled(both, labels).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "both")
    return whole, top
