"""Graph measures against hand-worked and brute-force results."""

import itertools
import random

import numpy as np
import pytest

from weftgraph.operators.graph import betweenness, build, community, rank, style
from weftgraph.operators.graph.components import connected_components

SMALL = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6)]


def graph(spark, pairs, weight=None):
    rows = [(str(a), str(b), float(w[0]) if w else (weight or 1.0)) for a, b, *w in pairs]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def random_pairs(seed, n=14, m=20):
    r = random.Random(seed)
    return list({tuple(r.sample(range(n), 2)) for _ in range(m)})


def dense_rank(pairs, alpha=0.85):
    nodes = sorted({str(x) for p in pairs for x in p[:2]})
    at, n = {v: i for i, v in enumerate(nodes)}, len(nodes)
    m = np.zeros((n, n))
    for a, b, *w in pairs:
        m[at[str(b)], at[str(a)]] += w[0] if w else 1
    total = m.sum(axis=0)
    m = np.where(total > 0, m / np.where(total > 0, total, 1), 1 / n)
    return dict(zip(nodes, np.linalg.solve(np.eye(n) - alpha * m, np.full(n, (1 - alpha) / n)), strict=True))


def test_pagerank_of_the_worked_graph(spark):
    pairs = [("a", "b", 4), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1), ("d", "c", 3), ("c", "e", 1)]
    ranks, converged = rank.pagerank(graph(spark, pairs))
    found = {r["id"]: r["pagerank"] for r in ranks.collect()}
    assert converged and sum(found.values()) == pytest.approx(1)
    assert found == pytest.approx({"a": 0.203217, "b": 0.202735, "c": 0.326283, "d": 0.064547, "e": 0.203217}, abs=1e-5)
    assert found == pytest.approx(dense_rank(pairs), abs=1e-5)


def test_each_mode_has_its_own_attempts(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(rank, "pagerank", lambda edges, weight, max_iter, tol: (tried.append((max_iter, tol)), False))
    edges = graph(spark, [("a", "b")])
    assert [rank.rank_or_fall_back(edges, mode=m)[1] for m in ("pipeline", "directed")] == ["in-degree centrality"] * 2
    assert tried == [(200, 1e-6), (100, 1e-6), (500, 1e-5)]


def test_pagerank_that_does_not_converge_says_so(spark):
    assert rank.pagerank(graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")]), max_iter=1)[1] is False


def test_empty_graph(spark):
    empty = graph(spark, [("a", "b")]).limit(0)
    assert rank.pagerank(empty)[0].isEmpty()
    assert connected_components(empty).isEmpty()
    assert community.girvan_newman(empty).isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_partition_as_union_find_does(spark, seed):
    pairs = random_pairs(seed, 40, 30)
    found = {r["id"]: r["component"] for r in connected_components(graph(spark, pairs)).collect()}
    head = {str(v): str(v) for p in pairs for v in p}

    def find(v):
        while head[v] != v:
            v = head[v]
        return v

    for a, b in pairs:
        x, y = sorted((find(str(a)), find(str(b))))
        head[y] = x
    assert found == {v: find(v) for v in head}


def test_components_of_a_long_path_and_nulls(spark):
    rows = [(i, i + 1) for i in range(60)] + [(5, 5), (None, 3), (100, 101), (101, 100)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_betweenness_of_the_worked_graph(spark):
    found = {(int(r["src"]), int(r["dst"])): r["betweenness"] for r in betweenness.edge_betweenness(graph(spark, SMALL)).collect()}
    assert found == {(2, 3): 12, (3, 5): 8, (5, 6): 6, (0, 2): 5, (1, 2): 5, (3, 4): 4, (4, 5): 2, (0, 1): 1}


def test_betweenness_against_all_shortest_paths(spark):
    pairs = random_pairs(3, 9, 14)
    near = {}
    for a, b in pairs:
        near.setdefault(str(a), set()).add(str(b))
        near.setdefault(str(b), set()).add(str(a))

    def paths(s, t):
        level = [[s]]
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in p]
        return []

    want = {}
    for s, t in itertools.combinations(sorted(near), 2):
        found = paths(s, t)
        for p in found:
            for e in itertools.pairwise(p):
                want[tuple(sorted(e))] = want.get(tuple(sorted(e)), 0) + 1 / len(found)
    got = {(r["src"], r["dst"]): r["betweenness"] for r in betweenness.edge_betweenness(graph(spark, pairs)).collect()}
    assert got == pytest.approx(want)


def test_betweenness_in_tables_is_the_same(spark):
    edges = graph(spark, [*random_pairs(3, 10, 12), (7, 7), (50, 51)])
    rows = [{(r["src"], r["dst"]): round(r["betweenness"], 9) for r in betweenness.edge_betweenness(edges, n).collect()} for n in (10**6, 0)]
    assert rows[0] == rows[1] and rows[0]


def test_second_level_communities(spark):
    groups = {}
    for r in community.girvan_newman(graph(spark, SMALL)).collect():
        groups.setdefault(r["group"], set()).add(int(r["node"]))
    assert groups == {1: {0, 1, 2}, 2: {3, 4, 5}, 3: {6}}


def test_communities_are_two_more_than_components_and_cover_the_nodes(spark):
    pairs = random_pairs(5, 16, 16)
    edges = graph(spark, pairs)
    found = community.girvan_newman(edges)
    parts = connected_components(edges).select("component").distinct().count()
    assert found.select("group").distinct().count() == parts + 2
    assert found.count() == found.select("node").distinct().count() == build.nodes_of(edges).count()


def test_too_few_edges_to_split(spark):
    found = community.girvan_newman(graph(spark, [("a", "b"), ("c", "c")]))
    assert {(r["node"], r["group"]) for r in found.collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_communities_in_tables_are_the_same(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "e")]
    found = [sorted(map(tuple, community.girvan_newman(graph(spark, pairs), in_memory=n).collect())) for n in (2000, 0)]
    assert found[0] == found[1]


def test_label_communities_are_numbered_by_least_node(spark):
    found = community.label_communities(graph(spark, [("c", "d"), ("a", "b"), ("e", "e")]))
    assert {(r["node"], r["group"]) for r in found.collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)}


def test_degree_and_in_degree(spark):
    edges = graph(spark, [("a", "b"), ("b", "a"), ("a", "a"), ("c", "a")])
    assert {(r["id"], r["degree"]) for r in build.degree(edges).collect()} == {("a", 4), ("b", 1), ("c", 1)}
    assert {(r["id"], r["centrality"]) for r in build.in_degree_centrality(edges).collect()} == {("a", 1.5), ("b", 0.5), ("c", 0.0)}


def test_last_written_direction_wins(spark):
    rows = spark.createDataFrame([("a", "b", "x", 1), ("b", "a", "y", 2), ("a", "c", "z", 8)], "node_1 string, node_2 string, edge string, count int")
    assert {tuple(r) for r in build.last_written(rows, scale=1.0).collect()} == {("a", "b", "y", 2.0), ("a", "c", "z", 8.0)}


def test_styles(spark):
    import colorsys

    edges = graph(spark, SMALL)
    groups = style.colours(community.girvan_newman(edges))
    want = {k + 1: "#" + "".join(f"{int(x * 255):02x}" for x in colorsys.hls_to_rgb(k / 3, 0.55, 0.75)) for k in range(3)}
    assert {r["group"]: r["color"] for r in groups.collect()} == want
    assert {r["color"] for r in style.colours(community.girvan_newman(edges), seed=4).collect()} == set(want.values())
    soft = {k: "#" + "".join(f"{round(x * 255):02x}" for x in colorsys.hls_to_rgb((3 - k) / 3 + 0.01, 0.6, 0.65)) for k in (1, 2, 3)}
    assert {r["group"]: r["color"] for r in style.colours(community.girvan_newman(edges), palette="soft").collect()} == soft
    ranks = spark.createDataFrame([("0", 0.1), ("1", 0.3)], "id string, pagerank double")
    found = {r["id"]: (r["group"], r["color"], r["size"]) for r in style.styled(build.nodes_of(edges), ranks, groups.where("node <> '6'")).collect()}
    assert found["0"][2] == 10 and found["1"][2] == 60 and found["6"] == (0, "#aaaaaa", 10)
    flat = spark.createDataFrame([("0", 0.2)], "id string, pagerank double")
    assert {r["size"] for r in style.styled(build.nodes_of(edges), flat, groups).collect()} == {10}
    assert {r["size"] for r in style.styled(build.nodes_of(edges), flat, groups, "pipeline").collect()} == {200}
