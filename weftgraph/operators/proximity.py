"""Contextual proximity: nodes are near if chunks mention both.

The number of a pair is the product of its mentions in each chunk, summed over chunks. Relations go to their chunk once; there
mentions are counted, and a chunk's nodes are written in order, ``BLOCK`` of them to a row. The pairs of a row are made from it as lists, one
for each first node, which are shuffled once, as a text of names each; blocks of one chunk meet in a join, which AQE splits when it is skewed. Only half of the pairs is made
(node_1 < node_2); the other half is its mirror image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schemas import DIRECTED, Mode
from weftgraph.storage import cut

#: Chunks of a node whose pairs one key takes; nodes of a chunk in one row; relations of a bucket of chunks that are summed up before they go to their chunk; and buckets.
LANE, BLOCK, HOT, BUCKETS = 100_000, 256, 1_000_000, 1 << 14


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _ends(rows: DataFrame) -> DataFrame:
    """A row for each node that a relation names."""
    rest = [c for c in rows.columns if c not in ("source", "target")]
    return rows.select(*rest, F.explode(F.array("source", "target")).alias("node")).where("node is not null")


def mentions(relations: DataFrame) -> DataFrame:
    """``(chunk_id, node, m)``, dealt by chunk: how often each chunk's relations name a node. Counts the relations of buckets of chunks first."""
    rows = relations.select("chunk_id", "source", "target").where("chunk_id is not null")
    hot = [r["b"] for r in rows.groupBy(_bucket("chunk_id").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).collect()]  # a chunk of very many relations is in one of few buckets
    if not hot:
        return _ends(rows.repartition("chunk_id")).groupBy("chunk_id", "node").agg(F.count("*").alias("m"))
    named, one, none = _bucket("chunk_id").isin(hot), F.lit(1).cast("long").alias("m"), F.lit(None).cast("string").alias("target")
    summed = _ends(rows.where(named)).groupBy("chunk_id", "node").agg(F.count("*").alias("m")).select("chunk_id", F.col("node").alias("source"), none, "m")
    dealt = rows.where(~named).select("*", one).unionByName(summed).repartition("chunk_id")
    return _ends(dealt).groupBy("chunk_id", "node").agg(F.sum("m").alias("m"))


def lane(other: Column, lanes: Column) -> Column:
    """The key beside its first node that a pair is dealt by: one of ``lanes``, by its second node."""
    return F.pmod(F.xxhash64(other), lanes).cast("int")


def blocks(counted: DataFrame) -> DataFrame:
    """``(chunk_id, block, nodes, ms, odd)``, written: each chunk's nodes in order, ``BLOCK`` of them to a row. ``ms`` is null where all are mentioned once; ``odd`` rows have a name with a line break."""
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("node"))
    numbered = counted.where("chunk_id is not null and node is not null").select("chunk_id", "node", "m", F.floor((place - 1) / BLOCK).cast("int").alias("block"))
    each = numbered.groupBy("chunk_id", "block").agg(F.sort_array(F.collect_list(F.struct("node", "m"))).alias("each"))
    ms = F.col("each.m")
    return cut(each.select("chunk_id", "block", F.col("each.node").alias("nodes"), F.when(F.array_max(ms) > 1, ms).alias("ms"), F.array_join("each.node", "").contains("\n").alias("odd")), "blocks")


def _lists(written: DataFrame) -> DataFrame:
    """``(chunk_id, node_1, m_1, near, ms, odd)``: each node of a chunk with the nodes after it."""
    mine = F.coalesce(F.get("own", F.col("at")), F.lit(1).cast("long")).alias("m_1")
    rows = written.select("chunk_id", "nodes", F.col("ms").alias("own"), "odd", F.posexplode("nodes").alias("at", "node_1")).where(F.col("at") + 1 < F.size("nodes"))
    rest = lambda c: F.slice(c, F.col("at") + 2, F.size("nodes"))
    found = rows.select("chunk_id", "node_1", mine, rest("nodes").alias("near"), rest("own").alias("ms"), "odd")
    later = written.where("block > 0")
    if later.isEmpty():
        return found
    first = written.where(F.size("nodes") == BLOCK).select("chunk_id", F.col("block").alias("a"), "nodes", F.col("ms").alias("own"))
    met = first.join(later.select("chunk_id", F.col("block").alias("b"), F.col("nodes").alias("near"), "ms", "odd"), "chunk_id").where("a < b")
    across = met.select("chunk_id", "own", "near", "ms", "odd", F.posexplode("nodes").alias("at", "node_1"))
    return found.unionByName(across.select("chunk_id", "node_1", mine, "near", "ms", "odd"))


def _laned(counted: DataFrame) -> DataFrame:
    """``(node, lanes)`` of nodes whose pairs have several keys: one for each ``LANE`` chunks that mention it. Such nodes are few, as mentions are ``LANE`` to each key."""
    return counted.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > LANE).select("node", F.ceil(F.col("n") / LANE).cast("int").alias("lanes"))


def _dealt(lists: DataFrame, written: DataFrame) -> DataFrame:
    """Lists with the ``lane`` of their pairs, if a node has several."""
    heavy = _laned(written.select(F.explode("nodes").alias("node"))).withColumnRenamed("node", "node_1")
    if heavy.isEmpty():
        return lists
    rows = lists.join(F.broadcast(heavy), "node_1", "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    rows = rows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    several, here = F.col("lanes") > 1, lambda x: lane(x, F.col("lanes")) == F.col("lane")
    rows = rows.withColumn("ms", F.when(several, F.filter("ms", lambda _, i: here(F.get("near", i)))).otherwise(F.col("ms")))  # before near: in one step it would see the new one
    return rows.withColumn("near", F.when(several, F.filter("near", here)).otherwise(F.col("near"))).where(F.size("near") > 0).drop("lanes")


def pairs_of(written: DataFrame, chunks: bool = True, least: int = 1) -> DataFrame:
    """``pairs`` of mentions in ``blocks``."""
    lists = _dealt(_lists(written), written)
    key, listed = ["node_1", *(["lane"] if "lane" in lists.columns else [])], ["chunk_id"] if chunks else []
    text, plain = F.when(~F.col("odd"), F.array_join("near", "\n")).alias("text"), F.when(F.col("odd"), F.col("near")).alias("plain")
    sent = lists.select(*key, "m_1", text, plain, "ms", *listed).repartition(*key)
    met = sent.select(*key, "m_1", "ms", *listed, F.posexplode(F.coalesce("plain", F.split("text", "\n", -1))).alias("at", "node_2"))
    met = met.select(*key, "node_2", *listed, (F.col("m_1") * F.coalesce(F.get("ms", F.col("at")), F.lit(1).cast("long"))).alias("n"))
    total, one = [F.sum("n").alias("count")], [*key, "node_2"]
    if chunks:
        met = met.withColumn("count", F.sum("n").over(Window.partitionBy(*one))).where(F.col("count") >= least)  # most pairs meet once: no list is made of them
        each = F.array_sort(F.collect_list(F.struct("chunk_id", "n")))
        total.append(F.flatten(F.transform(each, lambda x: F.array_repeat(x["chunk_id"], x["n"].cast("int")))).alias("chunk_ids"))
    return met.groupBy(*one).agg(*total).where(F.col("count") >= least).drop("lane")


def pairs(counted: DataFrame, chunks: bool = True, least: int = 1) -> DataFrame:
    """``(node_1, node_2, count[, chunk_ids])`` for node_1 < node_2 and counts of ``least`` or more, from mentions, in which a chunk has a node once.

    Pairs are dealt by their first node, so that those of a chunk are one row.
    """
    return pairs_of(blocks(counted), chunks, least)


def half(relations: DataFrame, chunks: bool = True, least: int = 2, cap: int = 3) -> DataFrame:
    """``(node_1, node_2, count, weight[, chunk_ids])``: proximity edges in one direction, node_1 < node_2."""
    found = pairs(mentions(relations), chunks, least).where((F.col("node_1") != "") & (F.col("node_2") != ""))
    return found.withColumn("weight", F.least(F.col("count"), F.lit(cap)).cast("double"))


def proximity(relations: DataFrame, mode: Mode = DIRECTED, chunks: bool = True, least: int = 2, cap: int = 3) -> DataFrame:
    """Proximity edges in both directions: pairs of count ``least`` or more, of weight min(count, ``cap``).

    ``chunk_ids`` holds each chunk as often as its product of mentions, in order of chunk_id.
    """
    rest = ["count", *(["chunk_ids"] if chunks else []), "weight"]
    ends = [F.struct(F.col(a).alias("source"), F.col(b).alias("target")) for a, b in (("node_1", "node_2"), ("node_2", "node_1"))]
    both = half(relations, chunks, least, cap).select(F.inline(F.array(*ends)), *rest)  # a union would sum every pair twice
    return both.withColumns({"relationship": F.lit(mode.proximity_label), "description": F.lit(mode.proximity_description)})
