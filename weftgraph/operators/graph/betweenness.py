"""Edge betweenness on unweighted undirected graphs by Brandes' accumulation.

Graphs of at most ``in_memory`` edges are broadcast, and their sources dealt to tasks. Larger ones never leave the tables:
all sources are searched level by level, a row for each source and node, by equi-joins and partially aggregated sums. Both
give the same numbers; the second costs rows in the square of a component, which is what the measure asks for.

``sampled_betweenness`` searches from a sample of nodes only, so that its cost is that of so many searches whatever the size of the graph, and tells how far
its estimates may be off: a source adds between 0 and n - 1 to an edge, so Hoeffding's inequality bounds the mean over a sample without replacement.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph.build import nodes_of, undirected
from weftgraph.storage import cut, scratch

IN_MEMORY = 200_000


def from_source(s: str, near: dict[str, list[str]]) -> dict[tuple[str, str], float]:
    """What shortest paths from ``s`` add to each edge."""
    distance, paths, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
    queue = deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in distance:
                distance[w] = distance[v] + 1
                queue.append(w)
            if distance[w] == distance[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    load, out = defaultdict(float), {}
    for w in reversed(order):
        for v in before[w]:
            part = paths[v] / paths[w] * (1 + load[w])
            load[v] += part
            out[(min(v, w), max(v, w))] = out.get((min(v, w), max(v, w)), 0.0) + part
    return out


def edge_betweenness(edges: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """``(src, dst, betweenness)`` for each undirected edge that is no loop; each pair of nodes counts once."""
    plain = cut(undirected(edges).where("src <> dst"), "plain")
    return _broadcast(plain) if plain.count() <= in_memory else _by_levels(plain)


def _broadcast(plain: DataFrame) -> DataFrame:
    spark, kind = plain.sparkSession, plain.schema["src"].dataType.simpleString()
    near: dict[str, list[str]] = defaultdict(list)
    for r in plain.collect():
        near[r["src"]].append(r["dst"])
        near[r["dst"]].append(r["src"])
    shared = spark.sparkContext.broadcast(dict(near))

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, float] = defaultdict(float)
        for batch in batches:
            for s in batch["id"]:
                for edge, x in from_source(s, shared.value).items():
                    total[edge] += x
        yield pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["src", "dst", "x"])

    sources = spark.createDataFrame([(v,) for v in near], f"id {kind}").repartition(min(max(1, len(near)), spark.sparkContext.defaultParallelism))
    return sources.mapInPandas(accumulate, f"src {kind}, dst {kind}, x double").groupBy("src", "dst").agg((F.sum("x") / 2).alias("betweenness"))


def _by_levels(plain: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Forward, a level is the nodes at one distance of their source, with the number of shortest paths; backward, loads are summed from the last level.

    All nodes are sources, or those of ``sources`` ``(id)``. Half of the sum over sources, so that each pair counts once if all are.
    """
    both = cut(plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "neighbours")
    step = both.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    begin = both.select(F.col("src").alias("id")).distinct() if sources is None else sources
    levels = [cut(begin.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while not levels[-1].isEmpty():
        reached = levels[-1].join(step, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        for old in levels[-2:]:  # a neighbour of a level is in it, in the one before or in the next
            reached = reached.join(old.select("s", "v"), ["s", "v"], "left_anti")
        levels.append(cut(reached, "level"))
    load, found = None, None
    for upper, lower in zip(reversed(levels[:-2]), reversed(levels[1:-1]), strict=True):
        below = lower.withColumn("load", F.lit(0.0)) if load is None else lower.join(load, ["s", "v"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        below = below.select("s", F.col("v").alias("w"), F.col("paths").alias("paths_w"), "load").join(step, "w")
        part = F.col("paths") / F.col("paths_w") * (1 + F.col("load"))
        parts = cut(below.join(upper, ["s", "v"]).select("s", "v", "w", part.alias("x")), "loads")
        load = parts.groupBy("s", "v").agg(F.sum("x").alias("load"))
        own = parts.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"), "x")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("src", "dst").agg((F.sum("x") / 2).alias("betweenness"))


def sampled_betweenness(edges: DataFrame, sources: int = 64, delta: float = 0.05) -> DataFrame:
    """``(src, dst, betweenness, bound)`` for each undirected edge that is no loop, estimated from so many source nodes.

    Sources are the nodes with the least MD5 of their ids. With probability 1 - ``delta`` no edge's estimate is off by more than ``bound``, which is the same for
    all; it is 0 where every node is a source. All sources are searched together, level by level, in tables of a row for each source and node.
    """
    spark = edges.sparkSession
    with scratch(spark) as made:
        plain = cut(undirected(edges).where("src <> dst"), "plain")
        nodes = cut(nodes_of(plain), "nodes")
        n, m = nodes.count(), plain.count()
        k = min(sources, n)
        if not m:
            return made.keep(cut(plain.select("src", "dst", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound")), "betweenness"))
        chosen = cut(nodes.orderBy(F.md5(F.col("id").cast("string")), "id").limit(k), "sources")
        found = _by_levels(plain, chosen).withColumn("betweenness", F.col("betweenness") * (n / k))
        bound = 0.0 if k == n else n * (n - 1) / 2 * math.sqrt(math.log(2 * m / delta) / (2 * k))
        every = plain.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.lit(bound).alias("bound"))
        return made.keep(cut(every, "betweenness"))
