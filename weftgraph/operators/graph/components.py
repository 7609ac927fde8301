"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is a min aggregation on one end of the edges followed by an equi-join on that end, so
a hub costs one partially aggregated row per task, and its join side is split by AQE when it is
skewed. No neighbour list is ever collected. The number of rounds is logarithmic in the graph's
size; each round's edges are written to the shared folder and the previous round's are deleted. It
ends as soon as all components are stars, which takes no round where the edges are stars from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import apart, cut, drop

MAX_ROUNDS = 60


def _star(edges: DataFrame, u: str, v: str) -> DataFrame:
    """For each ``u`` the least id among itself and its neighbours, attached to its edges."""
    least = edges.groupBy(u).agg(F.min(v).alias("_m")).select(F.col(u), F.least(u, "_m").alias("m"))
    return edges.join(apart(least), u)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _star(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = _star(edges, "a", "b")
    return down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        down.select("a", F.col("m").alias("b"))
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every component is a star by now: no centre (``b``) is a leaf (``a``), and no leaf has two centres. A centre is less than its leaves."""
    centres = edges.select(F.col("b").alias("a")).distinct()
    if not edges.join(apart(centres), "a", "left_semi").isEmpty():
        return False
    return edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every id that has an edge; component is the least id reachable.

    Null ends and self loops link nothing and are ignored; an id that has only those is not
    returned. An empty edge table gives an empty result. Direction and repeated edges don't matter.
    """
    live = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    now = cut(live.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(MAX_ROUNDS):
        if _stars(now):
            break
        step = cut(_small(_large(now).distinct()).where("a <> b").distinct(), "components")
        drop(now)
        now = step
    else:
        raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
