"""Places of nodes in the plane by forces, for graphs of any size.

Neighbours attract each other and all nodes repel each other (Fruchterman and Reingold 1991). Repulsion isn't summed over pairs: nodes are counted into the cells
of a quad-tree, and a cell at a distance acts as one heavy node at the middle of what it holds. On every level a cell meets only the children of its parent's neighbours
that aren't its own neighbours, at most 27, as nearer ones are met on a finer level and farther ones on a coarser (the fast multipole scheme with one term).
On the finest level each node meets the eight cells next to its own, and the rest of its own. A cell's forces go down to the cells inside it.

All of it are equi-joins and partially aggregated sums in tables; a round costs a few rows for each node, edge and cell. The driver gets the extent of the drawing; no side of a join is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph.build import nodes_of
from weftgraph.storage import apart, cut, drop, scratch

#: Nodes that share a node's cell of the finest level on average, itself included; levels added for it at most; levels in all; and the least squared distance that forces know.
PER_CELL, FINER, DEEPEST, NEAR = 1.5, 4, 14, 1e-4


def _number(id_: Column, salt: str) -> Column:
    """A number between 0 and 1 that follows from the id."""
    return F.pmod(F.xxhash64(F.lit(salt), id_), F.lit(1 << 30)) / float(1 << 30)


def _depth(places: DataFrame, n: int, low_x: float, low_y: float, side: float, per_cell: float) -> int:
    """The fewest levels at which nodes aren't crowded, from as many as there are powers of four in the number of nodes: dense parts of a drawing ask for more."""
    least = min(DEEPEST, max(1, math.ceil(math.log(n, 4))))
    d = F.explode(F.sequence(F.lit(least), F.lit(min(DEEPEST, least + FINER)))).alias("d")
    cell = [F.floor((F.col(a) - low) / side * F.pow(F.lit(2.0), F.col("d"))).alias(f"c{a}") for a, low in (("x", low_x), ("y", low_y))]
    counted = places.select("x", "y", d).groupBy("d", *cell).agg(F.count("*").alias("n"))
    crowd = {r["d"]: r["crowd"] for r in counted.groupBy("d").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}
    return next((d for d in sorted(crowd) if crowd[d] <= per_cell), max(crowd))


def _pyramid(places: DataFrame, depth: int, low_x: float, low_y: float, side: float) -> tuple[DataFrame, DataFrame]:
    """Places with their finest cell; and ``(level, cx, cy, n, x, y)``: cells of all levels from 1, with the middle of their nodes."""
    top = (1 << depth) - 1
    cell = lambda c, low: F.least(F.floor((F.col(c) - low) / side * (1 << depth)).cast("int"), F.lit(top))
    held = places.withColumns({"cx": cell("x", low_x), "cy": cell("y", low_y)})
    finest = held.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("by", F.lit(depth) - F.col("level"))
    shifted = up.select("level", F.call_function("shiftright", "cx", "by").alias("cx"), F.call_function("shiftright", "cy", "by").alias("cy"), "n", "sx", "sy")
    cells = shifted.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    return held, cells.select("level", "cx", "cy", "n", (F.col("sx") / F.col("n")).alias("x"), (F.col("sy") / F.col("n")).alias("y"))


def _push(dx: Column, dy: Column, n: Column) -> tuple[Column, Column]:
    """The force of ``n`` nodes at a distance: as many, over the distance."""
    square = F.greatest(dx * dx + dy * dy, F.lit(NEAR))
    return n * dx / square, n * dy / square


def repulsion(places: DataFrame, per_cell: float = PER_CELL) -> DataFrame:
    """``(id, x, y, fx, fy)`` of ``(id, x, y)``: what all other nodes push a node with, each by one over its distance."""
    box = places.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, low_x, high_x, low_y, high_y = box
    if n < 2:
        return places.select("id", "x", "y", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    side = max(high_x - low_x, high_y - low_y, 1e-9)
    depth = _depth(places, n, low_x, low_y, side, per_cell)
    held, cells = _pyramid(places, depth, low_x, low_y, side)
    held, cells = cut(held, "held"), cut(cells, "cells")

    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-3, 4) for j in range(-3, 4) if (i, j) != (0, 0)])
    sent = cells.select("level", F.col("cx").alias("from_x"), F.col("cy").alias("from_y"), "n", F.col("x").alias("sx"), F.col("y").alias("sy"), F.inline(steps))
    sent = sent.withColumns({"cx": F.col("from_x") + F.col("dx"), "cy": F.col("from_y") + F.col("dy")})
    beside = (F.abs(F.col("dx")) <= 1) & (F.abs(F.col("dy")) <= 1)
    parents = F.greatest(*[F.abs(F.shiftright(f"c{a}", 1) - F.shiftright(f"from_{a}", 1)) for a in "xy"]) <= 1
    sent = sent.where((F.col("cx") >= 0) & (F.col("cy") >= 0) & ~beside & parents)
    met = sent.drop("from_x", "from_y", "dx", "dy").join(apart(cells.select("level", "cx", "cy", "x", "y")), ["level", "cx", "cy"])
    fx, fy = _push(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.col("n"))
    field = met.groupBy("level", "cx", "cy").agg(F.sum(fx).alias("fx"), F.sum(fy).alias("fy"))

    finest = cells.where(F.col("level") == depth).select("cx", "cy", "n", F.col("x").alias("mx"), F.col("y").alias("my"))
    down = finest.select(F.col("cx").alias("own_x"), F.col("cy").alias("own_y"), F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")).withColumn("by", F.lit(depth) - F.col("level"))
    down = down.select("own_x", "own_y", "level", F.call_function("shiftright", "own_x", "by").alias("cx"), F.call_function("shiftright", "own_y", "by").alias("cy"))
    summed = down.join(apart(field), ["level", "cx", "cy"]).groupBy(F.col("own_x").alias("cx"), F.col("own_y").alias("cy")).agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    found = held.join(apart(finest.join(apart(summed), ["cx", "cy"], "left")), ["cx", "cy"])
    others = F.col("n") - 1  # the rest of the own cell, at its middle
    ox, oy = ((F.col("n") * F.col(m) - F.col(c)) / F.greatest(others, F.lit(1)) for m, c in (("mx", "x"), ("my", "y")))
    px, py = _push(F.col("x") - ox, F.col("y") - oy, others)
    far = found.select("id", "x", "y", (F.coalesce("fx", F.lit(0.0)) + px).alias("fx"), (F.coalesce("fy", F.lit(0.0)) + py).alias("fy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    seen = held.select("id", "x", "y", "cx", "cy", F.inline(around)).select("id", "x", "y", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy")).join(apart(finest), ["cx", "cy"])
    qx, qy = _push(F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("n"))
    both = far.unionByName(seen.select("id", "x", "y", qx.alias("fx"), qy.alias("fy")))
    return both.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def layout(edges: DataFrame, rounds: int = 30, gravity: float = 0.05, begin: DataFrame | None = None) -> DataFrame:
    """``(id, x, y)`` for every end of ``(src, dst, weight)``, after so many rounds in which nodes move less and less.

    The unit is the distance at which two neighbours with an edge of mean weight rest. It begins at places that follow from ids, or at those of ``begin`` (``id``, ``x``, ``y``).
    Parallel edges and both directions add up; loops, null ends and weights that aren't positive move nothing.
    """
    spark = edges.sparkSession
    with scratch(spark) as made:
        nodes = cut(nodes_of(edges.select("src", "dst")).where("id is not null"), "nodes")
        side = max(1.0, math.sqrt(nodes.count()))
        drawn = edges.where("src is not null and dst is not null and src <> dst and weight > 0").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("w"))
        drawn = cut(drawn, "drawn")
        mean = drawn.agg(F.avg("w")).first()[0] or 1.0
        pulls = cut(drawn.unionByName(drawn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).withColumn("w", F.least(F.col("w") / mean, F.lit(4.0))), "pulls")
        now = nodes.select("id", (side * _number(F.col("id"), "x")).alias("x"), (side * _number(F.col("id"), "y")).alias("y"))
        if begin is not None:
            now = now.join(apart(begin.select("id", F.col("x").alias("bx"), F.col("y").alias("by"))), "id", "left").select("id", F.coalesce("bx", "x").alias("x"), F.coalesce("by", "y").alias("y"))
        now = cut(now, "places")
        for k in range(rounds):
            heat = 0.5 * side * (1 - k / rounds) ** 2 / 2 + 0.05
            with scratch(spark) as own:
                pushed = repulsion(now)
                ends = pulls.join(apart(now.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))), "src").join(apart(now.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))), "dst")
                dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
                far = F.sqrt(dx * dx + dy * dy)
                pulled = ends.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * far * dx).alias("gx"), F.sum(F.col("w") * far * dy).alias("gy"))
                middle = side / 2
                total = pushed.join(apart(pulled), "id", "left").select(
                    "id", "x", "y", *[(F.col(f"f{a}") + F.coalesce(f"g{a}", F.lit(0.0)) + gravity * (middle - F.col(a))).alias(f"d{a}") for a in "xy"]
                )
                length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
                share = F.when(length > heat, heat / length).otherwise(1.0)
                step = own.keep(cut(total.select("id", (F.col("x") + F.col("dx") * share).alias("x"), (F.col("y") + F.col("dy") * share).alias("y")), "places"))
            drop(now)
            now = step
        return made.keep(now)
