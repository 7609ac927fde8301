"""The prefix trie of sequences of turns by prefix doubling.

Turns that are equal get one dense number. Blocks of 2, 4, 8 ... turns that begin at multiples of their length are named in as many rounds as
the longest sequence's length has binary digits: the name of a block is the dense number of the pair of names of its halves. A prefix is cut into such blocks by
the binary digits of its length, so it is named from a shorter prefix and one block; those whose lengths end in the same number of zeros are
named in one round, from the longest blocks to the single turns. The name of a prefix is the least conversation that begins with it, so names and lengths are the
nodes. Every round is equi-joins and partially aggregated groupings on tables that halve from round to round; no sequence is ever gathered in a row or a task.

A node's subtree is summed without walking the tree: each node is counted at the conversation that names it, running sums along each
conversation, in stretches of bounded length, are what a conversation holds from a depth on, and a node sums these over its members.

Defined results: rows with a null conversation take no part. Turns are in order, null first; turns of one number in order of role, then of the SHA-256 of
role and text. A null role or text is empty. Rows that repeat are turns of their own. An empty table gives no node, not even a root. Texts of any length count by
their SHA-256. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import cut, drop, scratch

#: Turns of a stretch of running sums, and ids of a piece of a node's list, as powers of two.
STRETCH, PIECE = 10, 10
_LOW = (1 << 33) - 1


def _numbered(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written table with ``at``, a number in order of its partitions and of rows in them; and ``(p, before)``, how many rows the earlier ones hold."""
    rows = cut(table.withColumn("at", F.monotonically_increasing_id()), "numbered")
    sizes = rows.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n"))  # a row a partition
    return rows, sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))


def dense_names(keys: DataFrame) -> DataFrame:
    """Distinct rows with ``name``: numbers from 0 without gaps."""
    rows, before = _numbered(keys.distinct())
    return rows.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(before), "p").withColumn("name", F.col("before") + F.col("at").bitwiseAND(F.lit(_LOW))).drop("p", "at", "before")


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, name, n_bytes)``: every turn with its place from 0, the number of its role and text, and its text's bytes.

    Places come from a range partitioning by conversation and turn, so that a long conversation is many tasks' work.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    hashed = cut(conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "turns")
    rows, _ = _numbered(hashed.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "digest").drop("turn", "role"))
    drop(hashed)
    rows = rows.withColumn("p", F.shiftright("at", 33))
    parts = rows.groupBy("conv_id", "p").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("p")) - F.col("n")  # a row for each partition that a conversation is in
    named = rows.join(dense_names(rows.select("digest")), "digest").drop("digest")
    placed = named.join(parts.withColumn("before", before), ["conv_id", "p"])
    return cut(placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "name", "n_bytes"), "placed")


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation begins with that are another's."""
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences in which every conversation begins with the first turns of conversation ``c - c % 5``, and their lengths.

    ``(conv_id, depth, name, n_bytes)`` with depth from 1, and ``(conv_id, length)``.
    """
    turns = turns_in_order(conversations)
    sizes = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    c = F.col("conv_id")
    wanted = sizes.select("conv_id", "n", borrowed_turns(c).alias("h"), (c - c % 5).alias("base"))
    found = wanted.join(sizes.select(c.alias("base"), F.col("n").alias("there")), "base", "left")
    info = cut(found.withColumn("kept", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "base", "h", "kept", (F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    heads = turns.where("i < 8").withColumnRenamed("conv_id", "base").join(info.select("conv_id", "base", "h"), "base").where("i < h")
    own = turns.where(F.col("i") >= borrowed_turns(c)).join(info.select("conv_id", (F.col("kept") - F.col("h") + 1).alias("shift")), "conv_id")
    rows = heads.select("conv_id", (F.col("i") + 1).alias("depth"), "name", "n_bytes").unionByName(own.select("conv_id", (F.col("i") + F.col("shift")).alias("depth"), "name", "n_bytes"))
    return cut(rows, "sequences"), info.select("conv_id", "length")


def _blocks(sequences: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two ``(conv_id, j, name)`` of the whole blocks of that many turns; block ``j`` begins after ``j`` of them."""
    levels = [sequences.select("conv_id", (F.col("depth") - 1).alias("j"), "name")]
    while 2 << (len(levels) - 1) <= longest:
        half = F.col("j") % 2
        halves = levels[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        pairs = cut(halves.where("b is not null"), "pairs")
        levels.append(cut(pairs.join(dense_names(pairs.select("a", "b")), ["a", "b"]).select("conv_id", "j", "name"), "blocks"))
        drop(pairs)
    return levels


def prefix_names(sequences: DataFrame, longest: int) -> DataFrame:
    """``(conv_id, depth, least)``: for each prefix of a sequence the least conversation that begins with it."""
    known = None
    for k, blocks in reversed(list(enumerate(_blocks(sequences, longest)))):
        rows = blocks.where(F.col("j") % 2 == 0).select("conv_id", F.shiftleft("j", k).alias("before"), F.shiftleft(F.col("j") + 1, k).alias("depth"), "name")
        first = rows.where("before = 0").withColumn("shorter", F.lit(0).cast("long"))  # prefixes of one length are all of one block, or none is
        if known is not None:
            first = first.unionByName(rows.where("before > 0").join(known.select("conv_id", F.col("depth").alias("before"), F.col("least").alias("shorter")), ["conv_id", "before"]))
        step = cut(first.drop("before"), "prefixes")
        least = cut(step.groupBy("depth", "shorter", "name").agg(F.min("conv_id").alias("least")), "least")  # written, so that a join on a common prefix can be split
        named = cut(step.join(least, ["depth", "shorter", "name"]).select("conv_id", "depth", "least"), "named")
        drop(step, least)
        known = named if known is None else known.unionByName(named)
    return known


def _ends(ends: DataFrame) -> DataFrame:
    """``(least, depth, ends_sha256)`` of ``(least, depth, conv_id)``: pieces of lists are joined in tasks, and hashed one after another."""
    pieces = ends.groupBy("least", "depth", F.shiftright("conv_id", PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for batch in batches:
            out = []
            for least, depth, ids in zip(batch["least"], batch["depth"], batch["ids"], strict=True):
                if node == (least, depth):
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (least, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["least", "depth", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, sha.hexdigest())], columns=["least", "depth", "ends_sha256"])

    return pieces.repartition("least", "depth").sortWithinPartitions("least", "depth", "piece").mapInPandas(digests, "least long, depth long, ends_sha256 string")


def trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``(conv_id, depth, name, n_bytes)``, whose lengths are ``(conv_id, length)``.

    ``conv_id``, the least member, with ``depth`` names a node. ``parent_conv_id``, ``n_convs`` members, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    with scratch(sequences.sparkSession) as made:
        top = lengths.agg(F.max("length").alias("longest"), F.min("conv_id").alias("least")).first()
        empty = sequences.select("conv_id", "depth", F.col("conv_id").alias("least")).limit(0)
        names = prefix_names(sequences, top["longest"]) if top["longest"] else empty
        turns = sequences.select("conv_id", "depth", "n_bytes").join(names, ["conv_id", "depth"]).join(lengths, "conv_id").select("conv_id", "depth", "least", "n_bytes", (F.col("depth") == F.col("length")).alias("ends"))
        roots = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(top["least"]).cast("long").alias("least"), F.lit(0).cast("long").alias("n_bytes"), (F.col("length") == 0).alias("ends"))
        rows = cut(turns.unionByName(roots), "prefix_rows")

        size = F.count("*")
        counts = rows.groupBy("least", "depth").agg(size.alias("n_convs"), ((size - 1) * F.max("n_bytes")).alias("saved"), (F.count_if("ends") == size).cast("long").alias("leaf"))
        own = counts.withColumnRenamed("least", "conv_id")  # a node is counted at the conversation that names it
        above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
        nodes = cut(own.join(above, ["conv_id", "depth"], "left"), "nodes")
        children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))

        held = cut(rows.join(nodes.select("conv_id", "depth", "saved", "leaf"), ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"]).withColumn("stretch", F.shiftright("depth", STRETCH)), "held")
        later = held.groupBy("conv_id", "stretch").agg(F.sum("saved").alias("later_saved"), F.sum("leaf").alias("later_leaf"))
        after = Window.partitionBy("conv_id").orderBy(F.desc("stretch"))  # a row for each stretch of a conversation
        later = later.select("conv_id", "stretch", *[(F.sum(x).over(after) - F.col(x)).alias(x) for x in ("later_saved", "later_leaf")])
        within = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
        running = held.select("*", *[F.sum(x).over(within).alias(f"own_{x}") for x in ("saved", "leaf")]).join(later, ["conv_id", "stretch"])
        sums = running.groupBy(F.col("least").alias("conv_id"), "depth").agg(F.sum(F.col("own_saved") + F.col("later_saved")).alias("saved_tokens"), F.sum(F.col("own_leaf") + F.col("later_leaf")).alias("n_leaves"))

        key = ["conv_id", "depth"]
        out = nodes.join(sums, key).join(children, key, "left").join(_ends(rows.where("ends")).withColumnRenamed("least", "conv_id"), key, "left")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
        return made.keep(cut(out, "trie"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (``rebuilt``)."""
    with scratch(conversations.sparkSession) as made:
        return made.keep(trie(*rebuilt(conversations)))


#: CRC-32 bit by bit; prefixes as joined digests.
SQL = """WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS h FROM t GROUP BY c),
f AS (SELECT s.c, s.h, s.c - s.c % 5 AS base, least(s.h, coalesce(b.n, 0)) AS kept FROM s LEFT JOIN s b ON b.c = s.c - s.c % 5),
q AS (SELECT f.c, t.i + 1 AS d, digest, bytes FROM f JOIN t ON t.c = f.base AND t.i < f.h UNION ALL SELECT f.c, t.i - f.h + f.kept + 1, digest, bytes FROM f JOIN t ON t.c = f.c AND t.i >= f.h),
r AS (SELECT c, 0 AS d, '' AS prefix, 0 AS bytes FROM s UNION ALL SELECT c, d, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d), bytes FROM q),
m AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends, min(c) OVER (PARTITION BY d, prefix) AS least, count(*) OVER (PARTITION BY d, prefix) AS n FROM r),
o AS (SELECT *, CASE WHEN ends AND min(ends) OVER (PARTITION BY d, least) THEN least END AS leaf FROM m),
v AS (SELECT DISTINCT a.d, a.least, b.d AS sub, b.least AS sub_least, (b.n - 1) * b.bytes AS saved, b.leaf FROM o a JOIN o b ON b.c = a.c AND b.d >= a.d),
w AS (SELECT d, least, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(leaf) AS n_leaves, count(*) FILTER (WHERE sub = d + 1) AS n_children FROM v GROUP BY d, least),
e AS (SELECT d, least, min(n) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM o GROUP BY d, least)
SELECT e.least AS conv_id, e.d AS depth, p.least AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM e JOIN w USING (d, least) LEFT JOIN o p ON p.c = e.least AND p.d = e.d - 1"""
