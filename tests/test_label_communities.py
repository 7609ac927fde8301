"""Label propagation splits what is connected, and the flows can use it above Girvan-Newman's bound."""

import itertools

from weftgraph.operators.graph import community
from weftgraph.plans import flows


def groups(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["group"], set()).add(r["node"])
    return out


def test_cliques_joined_by_an_edge_are_two_groups(spark):
    left, right = list("abcdef"), list("uvwxyz")
    pairs = [*itertools.combinations(left, 2), *itertools.combinations(right, 2), ("f", "u")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    assert groups(community.label_communities(edges)) == {1: set(left), 2: set(right)}
    assert groups(community.label_communities(edges.select("dst", "src").toDF("src", "dst").unionByName(edges))) == {1: set(left), 2: set(right)}


def test_two_sided_graph_settles(spark):
    edges = spark.createDataFrame([(f"l{i}", f"r{j}") for i in range(4) for j in range(4)], "src string, dst string")
    assert groups(community.label_communities(edges)) == {1: {f"{s}{i}" for s in "lr" for i in range(4)}}


def test_flow_takes_a_community_method(spark):
    rows = [("a", "b", 4), ("b", "c", 4), ("a", "c", 4)]
    concepts = spark.createDataFrame([(w, 3, f"{k}") for k, (a, b, _) in enumerate(rows) for w in (a, b)], "entity string, importance int, chunk_id string")

    nodes = flows.concept_graph(concepts, communities=community.label_communities).nodes
    assert len({r["color"] for r in nodes.collect()}) == 1
    assert len({r["color"] for r in flows.concept_graph(concepts).nodes.collect()}) == 3
