"""Proximity counts over a stream of relations, exact however chunks are cut into batches.

The count of a pair is a sum over chunks of products of mentions, so what a batch adds to a chunk follows from the chunk's mentions before (old) and in the
batch (new): old x new + new x old + new x new. The state is two tables of increments, mentions of chunks and counts of pairs, with a partition for each
batch, named by its number. A batch reads the increments of batches before it, of its own chunks only, and writes its own partitions, so a batch that runs again after a
failure replaces what it wrote. Rows that are delivered twice are told by their ``key`` and count once. Chunks may come in pieces and late without a limit: no state
expires. ``compact`` sums increments up in another folder, so that their number needn't grow with that of batches.

Mentions go to their chunk once, and the pairs of a chunk of at most ``SMALL`` nodes are made there, as lists by first node; only larger chunks are joined with themselves.
The lists are written as they are made, so that pairs are shuffled once, when ``totals`` sums them up by first node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftgraph.operators.proximity import LANE, lane
from weftgraph.storage import cut, scratch

#: A row of a relation has both its ends, ``node`` and ``other``; a sum of several rows has one.
_MENTIONS = "chunk_id string, node string, other string, m long, batch long"
#: Second nodes are one text, a line each, or ``plain`` where a name has a line break; ``counts`` is null where each counts once.
_PAIRS = "node_1 string, text string, plain array<string>, counts array<bigint>, batch long"

#: Nodes of a chunk whose pairs are made from one list; rows of a batch whose chunks are looked up by broadcast; rows of a bucket of chunks that are summed up before they meet; and buckets.
SMALL, FEW, HOT, BUCKETS = 256, 100_000, 1_000_000, 1 << 14


def _path(table: str, kind: str) -> str:
    return f"{table.rstrip('/')}/{kind}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _before(spark: SparkSession, table: str, kind: str, schema: str | StructType, number: int) -> DataFrame:
    """Increments of the batches before ``number``."""
    path = _path(table, kind)
    empty = spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(path) if _exists(spark, path) else empty
    return found.where(F.col("batch") < number)


def _write(rows: DataFrame, table: str, kind: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{_path(table, kind)}/batch={number}")


def delta_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(node_1, node_2, count)`` that mentions ``new`` add to ``old``, both ``(chunk_id, node, m)`` with a node once in a chunk."""
    before, added = old.withColumn("added", F.lit(0).cast("long")), new.select("chunk_id", "node", F.lit(0).cast("long").alias("m"), F.col("m").alias("added"))
    every = before.unionByName(added).groupBy("chunk_id", "node").agg(F.sum("m").alias("old"), F.sum("added").alias("new"))
    every = cut(every, "touched")
    second = every.select("chunk_id", F.col("node").alias("node_2"), F.col("old").alias("old_2"), F.col("new").alias("new_2"))
    first = every.withColumnsRenamed({"node": "node_1", "old": "old_1", "new": "new_1"})
    parts = []
    for a, b, times in (  # no pair of two old mentions is made
        (first.where("new_1 > 0"), second, F.col("new_1") * (F.col("old_2") + F.col("new_2"))),
        (first.where("old_1 > 0"), second.where("new_2 > 0"), F.col("old_1") * F.col("new_2")),
    ):
        parts.append(a.join(b, "chunk_id").where("node_1 < node_2").select("node_1", "node_2", times.alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("node_1", "node_2").agg(F.sum("n").alias("count")).where(F.col("count") > 0)


def _ends(rows: DataFrame) -> DataFrame:
    """A row for each node that a row mentions."""
    rest = [c for c in rows.columns if c not in ("node", "other")]
    return rows.select(*rest, F.explode(F.array("node", "other")).alias("node")).where("node is not null")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _summed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(chunk_id, node, old, new, size, upto)``, dealt by chunk; ``size`` is the number of the chunk's nodes, ``upto`` that of its new ones up to the node."""
    none = F.lit(0).cast("long")
    rows = old.select("chunk_id", "node", "other", F.col("m").alias("old"), none.alias("new")).unionByName(new.select("chunk_id", "node", "other", none.alias("old"), F.col("m").alias("new")))
    hot = [r["b"] for r in rows.groupBy(_bucket("chunk_id").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).collect()]  # a chunk of very many rows is in one of few buckets
    sums = [F.sum(c).alias(c) for c in ("old", "new")]
    if hot:
        named = _bucket("chunk_id").isin(hot)
        rows = rows.where(~named).unionByName(_ends(rows.where(named)).groupBy("chunk_id", "node").agg(*sums).withColumn("other", F.lit(None).cast("string")))
    every = _ends(rows.repartition("chunk_id")).groupBy("chunk_id", "node").agg(*sums)
    ordered = Window.partitionBy("chunk_id").orderBy("node")
    size = F.count("*").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return every.withColumns({"size": size, "upto": F.count_if(F.col("new") > 0).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")})


def _lists(summed: DataFrame) -> DataFrame:
    """``(node_1, text, plain, counts)`` of each chunk: pairs of which one node is new. A new node takes all nodes after it, another one the new ones after it: slices of lists in order, compared with nothing."""
    row = F.struct("node", "old", "new", "upto")
    lists = [F.sort_array(F.collect_list(x)).alias(name) for name, x in (("every", row), ("added", F.when(F.col("new") > 0, row)))]
    chunks = summed.groupBy("chunk_id").agg(*lists, F.max(F.col("old") + F.col("new")).alias("most")).where(F.size("added") > 0)
    chunks = chunks.select("every", "added", "most", F.array_join("every.node", "").contains("\n").alias("odd"))
    first = chunks.select("every", "added", "most", "odd", F.posexplode("every").alias("at", "one"))
    after = F.when(F.col("one.new") > 0, F.slice("every", F.col("at") + 2, F.size("every"))).otherwise(F.slice("added", F.col("one.upto") + 1, F.size("every")))
    found = first.select("one", "most", "odd", after.alias("near")).where(F.size("near") > 0)
    times = F.transform("near", lambda x: F.col("one.new") * (x["old"] + x["new"]) + F.col("one.old") * x["new"])
    names = F.col("near.node")
    return found.select(F.col("one.node").alias("node_1"), F.when(~F.col("odd"), F.array_join(names, "\n")).alias("text"), F.when(F.col("odd"), names).alias("plain"), F.when(F.col("most") > 1, times).alias("counts"))


def _singly(pairs: DataFrame) -> DataFrame:
    return pairs.select("node_1", F.lit(None).cast("string").alias("text"), F.array("node_2").alias("plain"), F.array("count").alias("counts"))


def add_batch(relations: DataFrame, table: str, number: int, key: str | None = None) -> None:
    """Count the relations ``(chunk_id, source, target[, key])`` as batch ``number``."""
    spark = relations.sparkSession
    with scratch(spark):
        rows = relations.select("chunk_id", "source", "target", *([key] if key else []))
        if key:
            seen = StructType([rows.schema[key]]).add("batch", "long")
            told = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(_before(spark, table, "keys", seen, number), key, "left_anti")
            rows = told.unionByName(rows.where(F.col(key).isNull()))
        one = F.lit(1).cast("long").alias("m")
        rows = rows.select("chunk_id", F.col("source").alias("node"), F.col("target").alias("other"), one, *([F.col(key).alias("#key")] if key else []))
        _write(rows, table, "mentions", number)
        added = spark.read.schema(rows.schema).parquet(f"{_path(table, 'mentions')}/batch={number}")
        if key:
            _write(added.select(F.col("#key").alias(key)).where(F.col(key).isNotNull()), table, "keys", number)
        new = added.where("chunk_id is not null")
        n = new.count()
        old = _before(spark, table, "mentions", _MENTIONS, number if n else 0).where("chunk_id is not null")
        if n <= FEW:
            old = old.join(F.broadcast(new.select("chunk_id").distinct()), "chunk_id", "left_semi")
        seen_size = Observation()
        summed = _summed(old, new)
        _write(_lists(summed.observe(seen_size, F.max("size").alias("most")).where(F.col("size") <= SMALL)), table, "pairs", number)
        if n and (seen_size.get["most"] or 0) > SMALL:
            large = cut(summed.where(F.col("size") > SMALL), "large")
            side = lambda c: large.where(F.col(c) > 0).select("chunk_id", "node", F.col(c).alias("m"))
            _singly(delta_pairs(side("old"), side("new"))).write.mode("append").parquet(f"{_path(table, 'pairs')}/batch={number}")


def start(relations: DataFrame, table: str, checkpoint: str, key: str | None = None, **trigger) -> StreamingQuery:
    """Begin to count the pairs of a stream of ``(chunk_id, source, target[, key])`` into the folder ``table``.

    Rows of the same ``key`` count once, whichever batch they come in; without a key, and where it is null, every row counts.
    """
    return relations.writeStream.foreachBatch(lambda batch, number: add_batch(batch, table, number, key)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, table: str, into: str, last: int) -> None:
    """Sum the increments of batches up to ``last`` up to one each in the folder ``into``, in which the next batches are to be counted.

    ``table`` stays as it is, so a break on the way loses nothing; delete it when the stream has moved.
    """
    mentions = _ends(_before(spark, table, "mentions", _MENTIONS, last + 1)).where("chunk_id is not null")
    _write(mentions.groupBy("chunk_id", "node").agg(F.sum("m").alias("m")), into, "mentions", last)
    _write(_singly(_total(_before(spark, table, "pairs", _PAIRS, last + 1), 1)), into, "pairs", last)
    if _exists(spark, _path(table, "keys")):
        _write(spark.read.parquet(_path(table, "keys")).where(F.col("batch") <= last).drop("batch"), into, "keys", last)


def _total(lists: DataFrame, least: int) -> DataFrame:
    """``(node_1, node_2, count)``. Lists are dealt by first node as they were written, those of nodes with very many by their second nodes too."""
    lists = lists.select("node_1", "text", "plain", "counts")
    crowd = lists.groupBy(_bucket("node_1").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > LANE).select("b", F.ceil(F.col("n") / LANE).cast("int").alias("lanes"))
    names, key = F.coalesce("plain", F.split("text", "\n", -1)), ["node_1"]
    if not crowd.isEmpty():
        key = ["node_1", "lane"]
        dealt = lists.withColumn("b", _bucket("node_1")).join(F.broadcast(crowd), "b", "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
        dealt = dealt.select("node_1", "text", "plain", "counts", "lanes", F.when(F.col("lanes") > 1, names).alias("near"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
        here, several = lambda x: lane(x, F.col("lanes")) == F.col("lane"), F.col("lanes") > 1
        counts = F.when(several, F.filter("counts", lambda _, i: here(F.get("near", i)))).otherwise(F.col("counts")).alias("counts")
        lists = dealt.select(*key, F.when(~several, F.col("text")).alias("text"), F.when(several, F.filter("near", here)).otherwise(F.col("plain")).alias("plain"), counts)
    sent = lists.repartition(*key)
    found = sent.select(*key, "counts", F.posexplode(names).alias("at", "node_2"))
    count = F.coalesce(F.get("counts", F.col("at")), F.lit(1).cast("long"))
    return found.select(*key, "node_2", count.alias("n")).groupBy(*key, "node_2").agg(F.sum("n").alias("count")).where(F.col("count") >= least).drop("lane")


def totals(spark: SparkSession, table: str, least: int = 2) -> DataFrame:
    """``(node_1, node_2, count)`` over all batches so far, for counts of at least ``least``."""
    return _total(spark.read.schema(_PAIRS).parquet(_path(table, "pairs")), least)
