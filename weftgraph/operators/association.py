"""Proximity weighed against chance.

Two nodes that are mentioned in many chunks meet in many of them by chance alone. The measures here compare the number of chunks that
mention both with what the numbers for each would give: normalised pointwise mutual information, between -1 and 1, and the log-likelihood ratio,
which tells how sure a deviation is. Only pairs that meet often enough are joined to the numbers of their nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import proximity
from weftgraph.operators.proximity import mentions
from weftgraph.storage import cut


def _term(observed: Column, rows: Column, columns: Column, n: Column) -> Column:
    """``observed * ln(observed / expected)``, 0 where nothing is observed."""
    return F.when(observed > 0, observed * F.log(observed * n / (rows * columns))).otherwise(0.0)


def npmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """1 for nodes that are only mentioned together, 0 for independent ones."""
    return F.when(both == n, 1.0).otherwise(F.log(both * n / (a * b)) / -F.log(both / n))


def log_likelihood_ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    cells = ((both, a, b), (a - both, a, n - b), (b - both, n - a, b), (n - a - b + both, n - a, n - b))
    return 2 * sum((_term(o, r, c, n) for o, r, c in cells), F.lit(0.0))


def associations(relations: DataFrame, least: int = 2) -> DataFrame:
    """``(node_1, node_2, n_chunks, npmi, llr)`` for node_1 < node_2 in at least ``least`` chunks together, from relations with ``chunk_id``.

    A chunk counts once for a pair, however often it mentions them. Chunks that mention nothing don't count.
    """
    once = proximity.blocks(mentions(relations).select("chunk_id", "node", F.lit(1).cast("long").alias("m")))
    of_node = cut(once.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").cast("double").alias("c")), "spread")
    n = once.agg(F.count_if(F.col("block") == 0).cast("double").alias("n"))  # one row
    pairs = proximity.pairs_of(once, chunks=False, least=least).withColumnRenamed("count", "n_chunks")
    for k in (1, 2):
        pairs = pairs.join(of_node.select(F.col("node").alias(f"node_{k}"), F.col("c").alias(f"c_{k}")), f"node_{k}")
    both, c1, c2, total = F.col("n_chunks").cast("double"), F.col("c_1"), F.col("c_2"), F.col("n")
    return pairs.join(F.broadcast(n)).select("node_1", "node_2", "n_chunks", npmi(both, c1, c2, total).alias("npmi"), log_likelihood_ratio(both, c1, c2, total).alias("llr"))


def spread(relations: DataFrame) -> DataFrame:
    """``(node, mentions, n_chunks, entropy, evenness)``: how a node's mentions spread over chunks.

    ``entropy`` (natural logarithm) of its mentions over chunks, and ``evenness``, its share of the most there can be: that of a node
    mentioned equally in every chunk. Generic concepts are even and are mentioned in many chunks. One grouping: the entropy follows from sums.
    """
    counted = cut(mentions(relations), "mentions")
    n = counted.agg(F.count_distinct("chunk_id").alias("n"))  # one row
    m = F.col("m").cast("double")
    sums = counted.groupBy("node").agg(F.sum("m").alias("mentions"), F.count("*").alias("n_chunks"), F.sum(m * F.log(m)).alias("x"))
    entropy = F.greatest(F.lit(0.0), F.log(F.col("mentions").cast("double")) - F.col("x") / F.col("mentions"))
    found = sums.withColumn("entropy", entropy).join(F.broadcast(n))
    return found.select("node", "mentions", "n_chunks", "entropy", F.when(F.col("n") > 1, F.col("entropy") / F.log("n")).otherwise(1.0).alias("evenness"), "n")


def generic(relations: DataFrame, least_share: float = 0.1, least_evenness: float = 0.5) -> DataFrame:
    """Nodes of ``spread`` in at least a share ``least_share`` of chunks and of evenness ``least_evenness`` or more: concepts too common to tell anything."""
    return spread(relations).where((F.col("n_chunks") >= least_share * F.col("n")) & (F.col("evenness") >= least_evenness))


def without(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations of which neither end is one of ``nodes``."""
    columns = relations.columns
    for end in ("source", "target"):
        relations = relations.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return relations.select(*columns)
