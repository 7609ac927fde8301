"""Communities of the second Girvan-Newman level, and of label propagation.

Edges of highest betweenness go one after another until the number of components has grown twice, so the
second level has two communities more than the graph has components; a graph with too few edges has what it has.
Ties of betweenness (rounded to nine places) are broken by the smallest pair of ends. Only the component that lost
an edge is searched again; the others keep their betweenness. Graphs of at most ``in_memory`` nodes are held by the
driver; larger ones stay in tables, with the same result. The cost grows with nodes times edges at every removal, so
``label_communities``, another measure under another name, is the one whose cost grows with the graph only.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph.betweenness import edge_betweenness, from_source
from weftgraph.operators.graph.build import nodes_of, undirected
from weftgraph.operators.graph.components import connected_components
from weftgraph.storage import apart, cut, drop

IN_MEMORY = 2_000
MAX_ROUNDS = 30


def _reached(v: str, near: dict[str, set[str]]) -> set[str]:
    seen, todo = {v}, [v]
    while todo:
        for w in near[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def _loads(spark, near: dict[str, set[str]], nodes: list[str]) -> dict[tuple[str, str], float]:
    """Edge betweenness within one component, its sources dealt to tasks where there are enough of them."""
    if len(nodes) > 200:
        rows = [(a, b) for a in nodes for b in near[a] if a < b]
        return {(r["src"], r["dst"]): r["betweenness"] for r in edge_betweenness(spark.createDataFrame(rows, "src string, dst string")).collect()}
    total: dict[tuple[str, str], float] = defaultdict(float)
    for s in nodes:
        for edge, x in from_source(s, near).items():
            total[edge] += x / 2
    return total


def girvan_newman(edges: DataFrame, splits: int = 2, in_memory: int = IN_MEMORY) -> DataFrame:
    """``(node, group)``: groups from 1, in order of each one's least node."""
    spark = edges.sparkSession
    nodes = [r[0] for r in nodes_of(edges).where("id is not null").limit(in_memory + 1).collect()]
    if len(nodes) > in_memory:
        return _in_tables(edges, splits)
    near: dict[str, set[str]] = {v: set() for v in nodes}
    for a, b in undirected(edges).where("src <> dst").collect():
        near[a].add(b)
        near[b].add(a)
    left, parts = set(nodes), []
    while left:
        parts.append(_reached(min(left), near))
        left -= parts[-1]
    loads = [_loads(spark, near, sorted(p)) if len(p) > 1 else {} for p in parts]
    goal = len(parts) + splits
    while len(parts) < goal and any(loads):
        _, edge, k = min((-round(x, 9), e, k) for k, own in enumerate(loads) for e, x in own.items())
        a, b = edge
        near[a].discard(b)
        near[b].discard(a)
        old, one = parts.pop(k), _reached(a, near)
        loads.pop(k)
        for part in [one] if b in one else [one, old - one]:
            parts.append(part)
            loads.append(_loads(spark, near, sorted(part)) if len(part) > 1 else {})
    rows = [(v, k) for k, part in enumerate(sorted(map(sorted, parts)), 1) for v in part]
    return spark.createDataFrame(rows, "node string, group int")


def _in_tables(edges: DataFrame, splits: int) -> DataFrame:
    """Girvan-Newman with edges, loads and components in tables; one edge at a time comes to the driver."""
    left = cut(undirected(edges).where("src <> dst"), "edges")
    loads, parts = cut(edge_betweenness(left), "loads"), cut(connected_components(left), "parts")
    while splits and (top := loads.select(F.round("betweenness", 9).alias("x"), "src", "dst").orderBy(F.desc("x"), "src", "dst").first()):
        own = parts.where(F.col("id") == F.lit(top["src"])).first()["component"]
        left = cut(left.where(~((F.col("src") == F.lit(top["src"])) & (F.col("dst") == F.lit(top["dst"])))), "edges")
        touched = parts.where(F.col("component") == F.lit(own)).select(F.col("id").alias("src"))
        inside = cut(left.join(touched, "src", "left_semi"), "inside")
        again = connected_components(inside)
        ends = again.where(F.col("id").isin(top["src"], top["dst"])).collect()
        if len(ends) < 2 or ends[0]["component"] != ends[1]["component"]:
            splits -= 1
        loads = loads.join(touched, "src", "left_anti")
        loads = cut(loads if inside.isEmpty() else loads.unionByName(edge_betweenness(inside)), "loads")
        parts = cut(parts.where(F.col("component") != F.lit(own)).unionByName(again), "parts")
    every = nodes_of(edges).where("id is not null").join(parts, "id", "left")
    return numbered(every.select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component")))


def label_communities(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(node, group)`` by label propagation on the undirected graph, weights aside; no bound on size.

    Every node begins with its own label. In a round, half of the nodes (by the MD5 of node and round, so that two sides
    don't swap labels for ever) take the label that most of their neighbours and they themselves have; the least
    such label on a tie. It ends when no node of either half would change, or after ``rounds`` rounds. A group is a
    connected set of nodes of one label: groups are numbered from 1 in order of each one's least node, and a node without neighbours is its own.
    Each round is an equi-join and two partially aggregated groupings, written to the shared folder; no neighbour list is collected.
    """
    plain = undirected(edges).where("src <> dst")
    both = cut(plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "neighbours")
    labels = cut(both.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label")), "labels")
    for k in range(rounds):
        heard = both.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label").unionByName(labels)
        votes = heard.groupBy("id", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("id", F.col("m.label").alias("best"))
        turn = F.substring(F.md5(F.concat_ws(":", "id", F.lit(k))), 1, 1) < "8"
        new = labels.join(best, "id").select("id", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"), (F.col("best") != F.col("label")).alias("open"))
        step = cut(new, "labels")
        moved = not step.where("open").isEmpty()
        drop(labels)
        labels = step.select("id", "label")
        if not moved:
            break
    ends = both.where("src < dst").join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    found = connected_components(ends.where("a = b").select("src", "dst"))
    every = nodes_of(edges).where("id is not null").join(found, "id", "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))
    return numbered(every)


def numbered(members: DataFrame) -> DataFrame:
    """``(node, group)`` from ``(node, component)``: groups from 1 in order of component.

    Components are counted in range partitions first, so that no task sees all of them.
    """
    heads = members.select("component").distinct().repartitionByRange("component").withColumn("p", F.spark_partition_id())
    heads = cut(heads, "components")
    sizes = heads.groupBy("p").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("p").orderBy("component"))
    ranked = heads.withColumn("k", inside).join(F.broadcast(before), "p").select("component", (F.col("before") + F.col("k")).cast("int").alias("group"))
    return members.join(apart(ranked), "component").select("node", "group")
