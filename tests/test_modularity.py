"""Communities against the best of all partitions, and sampled betweenness against the exact measure."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.graph import betweenness, community, components, modularity
from weftgraph.plans.queries import page_links
from weftgraph.storage import cut


def quality(edges, groups):
    total = 2 * sum(w for _, _, w in edges)
    strength, inside = {}, 0.0
    for a, b, w in edges:
        strength[groups[a]] = strength.get(groups[a], 0) + w
        strength[groups[b]] = strength.get(groups[b], 0) + w
        inside += 2 * w if groups[a] == groups[b] else 0
    return inside / total - sum(k * k for k in strength.values()) / total**2


def partitions(nodes):
    if not nodes:
        yield []
        return
    head, *rest = nodes
    for part in partitions(rest):
        for k in range(len(part)):
            yield [*part[:k], [head, *part[k]], *part[k + 1 :]]
        yield [[head], *part]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, weight double")


GRAPHS = {
    "two cliques": [*[(f"a{i}", f"a{j}", 1.0) for i in range(4) for j in range(i)], *[(f"b{i}", f"b{j}", 1.0) for i in range(4) for j in range(i)], ("a0", "b0", 1.0)],
    "a ring of pairs": [(f"v{i}", f"v{(i + 1) % 8}", 5.0 if i % 2 == 0 else 1.0) for i in range(8)],
    "a loop and parallel edges": [("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 1.0), ("c", "d", 3.0), ("d", "d", 4.0), ("e", "f", 1.0), ("e", "a", 0.5)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_the_best_of_all_partitions(spark, name):
    edges = GRAPHS[name]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max(quality(edges, {v: k for k, part in enumerate(p) for v in part}) for p in partitions(nodes))
    found = modularity.modularity_communities(frame(spark, edges), tries=1)
    groups = {r["node"]: r["group"] for r in found.collect()}
    assert set(groups) == set(nodes) and quality(edges, groups) == pytest.approx(best)
    assert modularity.modularity(frame(spark, edges), found) == pytest.approx(best)


def test_above_label_propagation_and_connected(spark):
    links = page_links(spark, "/root/testdata/sf0.01")
    found, labels = modularity.modularity_communities(links, weight=None), community.label_communities(links)
    q = modularity.modularity(links, found, None)
    assert q > modularity.modularity(links, labels, None) > 0
    pairs = {(r["src"], r["dst"]) for r in links.collect()}
    groups = {r["node"]: r["group"] for r in found.collect()}
    near = {}
    for a, b in pairs:
        if groups[a] == groups[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for g in set(groups.values()):
        members = {v for v, k in groups.items() if k == g}
        seen, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += near.get(v, ())
        assert seen == members


def test_groups_are_numbered_by_least_node_and_odd_edges(spark):
    edges = [("x", "y", 1.0), ("y", "x", None), ("b", "c", 2.0), ("lonely", "lonely", 1.0), ("a", "zero", 0.0), (None, "x", 1.0)]
    found = {r["node"]: r["group"] for r in modularity.modularity_communities(frame(spark, edges)).collect()}
    assert found == {"a": 1, "b": 2, "c": 2, "lonely": 3, "x": 4, "y": 4, "zero": 5}
    assert modularity.modularity_communities(frame(spark, edges).limit(0)).isEmpty()
    none = modularity.modularity_communities(frame(spark, [("a", "b", 0.0)])).collect()
    assert sorted(tuple(r) for r in none) == [("a", 1), ("b", 2)]


def test_sampled_betweenness_is_within_its_bound(spark):
    r = random.Random(6)
    edges = [(f"v{a}", f"v{b}") for a, b in itertools.combinations(range(24), 2) if r.random() < 0.15] + [("v0", "v0"), (None, "v1")]
    pairs = spark.createDataFrame(edges, "src string, dst string")
    exact = {(x["src"], x["dst"]): x["betweenness"] for x in betweenness.edge_betweenness(pairs).collect()}
    for k in (8, 16):
        found = betweenness.sampled_betweenness(pairs, sources=k).collect()
        assert {(x["src"], x["dst"]) for x in found} == set(exact)
        off = max(abs(x["betweenness"] - exact[x["src"], x["dst"]]) for x in found)
        assert 0 < off <= found[0]["bound"]
    every = betweenness.sampled_betweenness(pairs, sources=100).collect()
    assert all(x["bound"] == 0 and x["betweenness"] == pytest.approx(exact[x["src"], x["dst"]]) for x in every)
    assert betweenness.sampled_betweenness(pairs.limit(0)).isEmpty()


def test_no_side_of_a_join_is_sent_to_the_driver(spark):
    """Small enough to be broadcast, each would go by way of the driver in every round."""
    both = cut(frame(spark, [("a", "b", 1.0), ("b", "a", 1.0)]).withColumnRenamed("weight", "w"))
    strengths, labels = both.select(F.col("src").alias("id"), F.col("w").alias("k")), both.select(F.col("src").alias("id"), F.col("dst").alias("label"))
    ends = both.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    found = [modularity._labelled(both, labels), modularity._moved(both, strengths, labels, 2.0, F.lit(True)), components._large(ends), components._small(ends)]
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
