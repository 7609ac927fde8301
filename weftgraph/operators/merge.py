"""One edge per ordered pair, from direct relations and proximity edges.

A pair has at most one proximity edge, so direct relations are summed to one row per pair first and the two tables
meet in one outer join; proximity rows never pass through a grouping. Values of a pair are kept as arrays in order of
appearance (direct relations by ``ord``, then proximity) and rendered as text only by ``rendered``. Ties in ``ord`` are
ordered by the values themselves. Chunk lists are as long as the pair's relations. ``chunks=False`` leaves them out; a mode
that drops repeated labels then drops them by a partial aggregation before labels are gathered, so that a row holds a pair's
different labels and not all of its relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schemas import DIRECTED, NOTEBOOK, Mode

_PAIR, _ENDS = ["source", "target"], ["node_1", "node_2"]


def union(direct: DataFrame, near: DataFrame) -> DataFrame:
    """Both tables under one schema; ``branch`` 0 for direct, 1 for proximity. Columns that one lacks are null in it."""
    direct = _with_ord(direct).withColumn("chunk_ids", F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id"))).drop("chunk_id")
    return direct.withColumn("branch", F.lit(0)).unionByName(near.withColumn("branch", F.lit(1)), allowMissingColumns=True)


def _with_ord(direct: DataFrame) -> DataFrame:
    return direct if "ord" in direct.columns else direct.withColumn("ord", F.lit(None).cast("long"))


def _gathered(*values: str) -> Column:
    """A group's rows by ``ord``."""
    return F.array_sort(F.collect_list(F.struct("ord", *values)))


def _in_order(rows: str, value: str, alias: str) -> Column:
    """The non-null values of gathered rows."""
    return F.transform(F.filter(rows, lambda x: x[value].isNotNull()), lambda x: x[value]).alias(alias)


def _different(direct: DataFrame, value: str, alias: str) -> DataFrame:
    """Each pair's different values, in order of first appearance."""
    firsts = direct.where(F.col(value).isNotNull()).groupBy(*_PAIR, value).agg(F.min("ord").alias("ord"))
    return firsts.groupBy(*_PAIR).agg(_gathered(value).alias("rows")).select(*_PAIR, _in_order("rows", value, alias))


def _summed(direct: DataFrame, mode: Mode, chunks: bool) -> DataFrame:
    """``(source, target, w, relationships, descriptions[, own_chunks])`` of direct relations, one row per pair."""
    rows = direct.where("source is not null and target is not null")
    if chunks or not mode.distinct:  # a row holds all relations of its pair in any case
        wanted = {"relationship": "relationships", "description": "descriptions"} | ({"chunk_id": "own_chunks"} if chunks else {})
        summed = rows.groupBy(*_PAIR).agg(F.sum("weight").alias("w"), _gathered(*wanted).alias("rows"))
        return summed.select(*_PAIR, "w", *[_in_order("rows", value, alias) for value, alias in wanted.items()])
    out = rows.groupBy(*_PAIR).agg(F.sum("weight").alias("w"))
    for value, alias in (("relationship", "relationships"), ("description", "descriptions")):
        out = out.join(_different(rows, value, alias), _PAIR, "left")
    return out


def merge(direct: DataFrame, near: DataFrame, mode: Mode = DIRECTED, chunks: bool = True) -> DataFrame:
    """``(source, target[, chunk_ids], relationships, weight, descriptions)``; weight is the sum, 0 if no row has one."""
    found = _summed(_with_ord(direct), mode, chunks)
    own = near.where("source is not null and target is not null").select(
        *_PAIR, F.array("relationship").alias("n_relationships"), F.col("weight").alias("n_weight"), F.array("description").alias("n_descriptions"), *(["chunk_ids"] if chunks else [])
    )
    both = found.join(own, _PAIR, "full")
    empty = F.array().cast("array<string>")

    def values(mine: str, other: str) -> Column:
        every = F.concat(F.coalesce(mine, empty), F.filter(F.coalesce(other, empty), lambda x: x.isNotNull()))
        return F.array_distinct(every) if mode.distinct else every

    listed = [F.concat(F.coalesce("own_chunks", empty), F.coalesce("chunk_ids", empty)).alias("chunk_ids")] if chunks else []
    weight = F.coalesce("w", F.lit(0.0)) + F.coalesce("n_weight", F.lit(0.0))
    return both.select(*_PAIR, *listed, values("relationships", "n_relationships").alias("relationships"), weight.alias("weight"), values("descriptions", "n_descriptions").alias("descriptions"))


def _folded(direct: DataFrame, *values: str) -> DataFrame:
    """Complete relations by ``node_1`` <= ``node_2``, dealt by both; ``forth`` where node_1 is the source."""
    rows = _with_ord(direct).where("source is not null and target is not null")
    return rows.select(F.least(*_PAIR).alias("node_1"), F.greatest(*_PAIR).alias("node_2"), (F.col("source") <= F.col("target")).alias("forth"), "ord", *values).repartition(*_ENDS)


def _of(forth: bool, rows: str, value: str) -> Column:
    """The non-null values of gathered rows of one direction."""
    mine = F.filter(rows, lambda x: (x["forth"] if forth else ~x["forth"]) & x[value].isNotNull())
    return F.coalesce(F.transform(mine, lambda x: x[value]), F.array().cast("array<string>"))


def _sides(value: Column) -> list[Column]:
    """Sums of what the relations of each direction give; null where there is none."""
    return [F.sum(F.when(F.col("forth"), value)).alias("own_forth"), F.sum(F.when(~F.col("forth"), value)).alias("own_back")]


def _ways(both: DataFrame, made) -> DataFrame:
    """A row for each direction of a pair: that of a near pair has both. ``made(forth, source, target)`` gives its columns."""
    ways = [F.struct((F.col(own).isNotNull() | F.col("near")).alias("here"), *made(forth, *ends)) for forth, own, ends in ((True, "own_forth", _ENDS), (False, "own_back", _ENDS[::-1]))]
    return both.select(F.inline(F.array(*ways))).where("here").drop("here")


def merge_half(direct: DataFrame, half: DataFrame, mode: Mode = DIRECTED, chunks: bool = True) -> DataFrame:
    """``merge`` of direct relations and ``proximity.half``: both directions of a pair meet in one row, so that near pairs are shuffled once."""
    values = ["relationship", "description", *(["chunk_id"] if chunks else [])]
    rows = _folded(direct, "weight", *values).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if mode.distinct and not chunks:  # a row holds different labels only; dealt by pair, so nothing is shuffled
        rows = rows.groupBy(*_ENDS, "forth", *values).agg(F.sum("weight").alias("weight"), F.min("ord").alias("ord"))
    found = rows.groupBy(*_ENDS).agg(*_sides(F.col("weight")), F.array_sort(F.collect_list(F.struct("ord", *values, "forth"))).alias("rows"))
    listed = ["chunk_ids"] if chunks else []
    both = found.join(half.select(*_ENDS, F.col("weight").alias("n_weight"), *listed), _ENDS, "full").withColumn("near", F.col("n_weight").isNotNull())
    empty = F.array().cast("array<string>")

    def made(forth: bool, source: str, target: str) -> list[Column]:
        def labels(value: str, label: str) -> Column:
            every = F.concat(_of(forth, "rows", value), F.when(F.col("near"), F.array(F.lit(label))).otherwise(empty))
            return F.array_distinct(every) if mode.distinct else every

        weight = F.coalesce("own_forth" if forth else "own_back", F.lit(0.0)) + F.coalesce("n_weight", F.lit(0.0))
        ids = [F.concat(_of(forth, "rows", "chunk_id"), F.coalesce("chunk_ids", empty)).alias("chunk_ids")] if chunks else []
        return [
            F.col(source).alias("source"), F.col(target).alias("target"), *ids, labels("relationship", mode.proximity_label).alias("relationships"), weight.alias("weight"),
            labels("description", mode.proximity_description).alias("descriptions"),
        ]

    return _ways(both, made)


def summed_half(direct: DataFrame, half: DataFrame) -> DataFrame:
    """``(source, target, weight)`` of ``merge_half``: merged edges with their weight alone."""
    rows = direct.where("source is not null and target is not null").select(F.least(*_PAIR).alias("node_1"), F.greatest(*_PAIR).alias("node_2"), (F.col("source") <= F.col("target")).alias("forth"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    own = rows.select(*_ENDS, F.when(F.col("forth"), F.col("weight")).alias("forth"), F.when(~F.col("forth"), F.col("weight")).alias("back"))
    near = half.select(*_ENDS, F.col("weight").alias("forth"), F.col("weight").alias("back"))
    both = own.unionByName(near).groupBy(*_ENDS).agg(F.sum("forth").alias("own_forth"), F.sum("back").alias("own_back")).withColumn("near", F.lit(False))
    return _ways(both, lambda forth, source, target: [F.col(source).alias("source"), F.col(target).alias("target"), F.col("own_forth" if forth else "own_back").alias("weight")])


def rendered(edges: DataFrame, mode: Mode = DIRECTED) -> DataFrame:
    """Merged edges with their arrays as text, and a ``label``: the first relationship."""
    listed = [F.array_join("chunk_ids", ",").alias("chunk_id")] if "chunk_ids" in edges.columns else []
    return edges.select(
        *_PAIR, *listed, F.array_join("relationships", mode.separator).alias("relationship"), "weight",
        F.array_join("descriptions", " | ").alias("description"), F.get("relationships", F.lit(0)).alias("label"),
    )


def split_label(edges: DataFrame, mode: Mode = DIRECTED) -> DataFrame:
    """``rendered`` edges labelled as files are read back: by splitting the text, which cuts labels that hold the separator."""
    from weftgraph.functions.text import first_part

    return edges.withColumn("label", first_part("relationship", mode.separator.strip(), stripped=mode.distinct))


def merge_counts(direct: DataFrame, near: DataFrame, direct_count: int = 4, mode: Mode = NOTEBOOK) -> DataFrame:
    """``(node_1, node_2, chunk_id, edge, count)``: the notebook's merge; a direct relation counts ``direct_count``."""
    rows = _with_ord(direct).where("source is not null and target is not null")
    found = rows.groupBy(*_PAIR).agg(F.count("*").alias("n"), _gathered("relationship", "chunk_id").alias("rows"))
    found = found.select(*_PAIR, "n", _in_order("rows", "chunk_id", "own_chunks"), _in_order("rows", "relationship", "own_edges"))
    both = found.join(near.select(*_PAIR, "chunk_ids", F.col("relationship").alias("near_edge"), F.col("count").alias("near_count")), _PAIR, "full")
    empty = F.array().cast("array<string>")
    chunks = F.concat(F.coalesce("own_chunks", empty), F.coalesce("chunk_ids", empty))
    edges = F.concat(F.coalesce("own_edges", empty), F.when(F.col("near_edge").isNotNull(), F.array("near_edge")).otherwise(empty))
    count = F.coalesce("n", F.lit(0)) * direct_count + F.coalesce("near_count", F.lit(0))
    return both.select(
        F.col("source").alias("node_1"), F.col("target").alias("node_2"), F.array_join(chunks, mode.separator).alias("chunk_id"), F.array_join(edges, mode.separator).alias("edge"), count.cast("long").alias("count")
    )


def last_counts(direct: DataFrame, half: DataFrame, direct_count: int = 4, mode: Mode = NOTEBOOK, scale: float = 4.0) -> DataFrame:
    """``(src, dst, title, weight)``: ``build.last_written`` of ``merge_counts``, from ``proximity.half``. Both directions of a pair meet in one row, of which the last written, from the greater end, stays if there is one."""
    found = _folded(direct, "relationship").groupBy(*_ENDS).agg(*_sides(F.lit(1)), F.array_sort(F.collect_list(F.struct("ord", "relationship", "forth"))).alias("rows"))
    both = found.join(half.select(*_ENDS, F.col("count").alias("near_count")), _ENDS, "full")
    back = F.col("own_back").isNotNull() | F.col("near_count").isNotNull()
    label = F.when(F.col("near_count").isNotNull(), F.array(F.lit(mode.proximity_label))).otherwise(F.array().cast("array<string>"))
    title, own = (F.when(back, a).otherwise(b) for a, b in ((_of(False, "rows", "relationship"), _of(True, "rows", "relationship")), (F.col("own_back"), F.col("own_forth"))))
    count = F.coalesce(own, F.lit(0)) * direct_count + F.coalesce("near_count", F.lit(0))
    return both.select(F.col("node_1").alias("src"), F.col("node_2").alias("dst"), F.array_join(F.concat(title, label), mode.separator).alias("title"), (count.cast("long") / scale).alias("weight"))


def top_edges(edges: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` heaviest edges; equal weights in order of their ends."""
    return edges.orderBy(F.desc("weight"), "source", "target").limit(n)


def heaviest(edges: DataFrame, n: int = 10, width: int = 35, mode: Mode = DIRECTED) -> DataFrame:
    """``(weight, source, target, label)`` of the heaviest ``rendered`` edges, labels cut to ``width`` characters, as a summary prints them."""
    return split_label(top_edges(edges, n), mode).select("weight", "source", "target", F.substring("label", 1, width).alias("label"))


def weight_range(edges: DataFrame) -> DataFrame:
    """Number of edges and their least and largest weight."""
    return edges.agg(F.count("*").alias("edges"), F.min("weight").alias("least"), F.max("weight").alias("largest"))
