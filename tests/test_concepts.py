"""Spelling, association, spread, backbone, cores and retrieval against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import association, canonical, similar
from weftgraph.operators.graph import backbone, cores, retrieve


def runs(name, q=4):
    return {name[i : i + q] for i in range(len(name) - q + 1)} or {name}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def some_names(seed, n=150):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcde") for _ in range(r.randint(2, 12))) for _ in range(40)]
    return sorted({r.choice(stems) + r.choice(["", "s", "es", "x", "ing"]) for _ in range(n)} | {"doctor", "doctors", "aaaa", "aaaaa", "aaaaaa", "", "ab"})


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_similar_sets(spark, percent):
    names = some_names(percent)
    frame = spark.createDataFrame([(x,) for x in names], "name string").select(F.col("name").alias("id"), similar.grams("name").alias("tokens"))
    found = {(r["a"], r["b"]): r["jaccard"] for r in similar.similar_sets(frame, percent).collect()}
    first = {}
    for x in names:
        first.setdefault(frozenset(runs(x)), x)
    kept = sorted(first.values())
    right = {(a, b): jaccard(runs(a), runs(b)) for a, b in itertools.combinations(kept, 2) if 100 * len(runs(a) & runs(b)) >= percent * len(runs(a) | runs(b))}
    right |= {(first[frozenset(runs(x))], x): 1.0 for x in names if first[frozenset(runs(x))] != x}
    assert found == pytest.approx(right)


def test_many_equal_sets_cost_a_row_each(spark):
    frame = spark.range(500).select(F.col("id"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    assert similar.similar_sets(frame).count() == 499


def test_canonical_names(spark):
    names = [(x, i % 7) for i, x in enumerate(some_names(1))] + [(None, 5), ("doctors", 90), ("doctor", 4), ("lonely", None)]
    found = {r["name"]: r for r in canonical.canonical_names(spark.createDataFrame(names, "name string, mentions int")).collect()}
    total = Counter()
    for x, m in names:
        total[x] += m or 0
    del total[None]
    group = {x: {x} for x in total}
    for a, b in itertools.combinations(total, 2):
        if jaccard(runs(a), runs(b)) >= 0.75 and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    assert {x: (r["canonical"], r["mentions"], r["n_names"]) for x, r in found.items()} == {x: (min(g, key=lambda y: (-total[y], y)), total[x], len(g)) for x, g in group.items()}
    assert found["doctor"]["canonical"] == "doctors"
    assert canonical.canonical_names(spark.createDataFrame([], "name string, mentions int")).isEmpty()


def test_contraction(spark):
    names = spark.createDataFrame([("doctor", "doctors"), ("doctors", "doctors"), ("nurse", "nurse")], "name string, canonical string")
    edges = spark.createDataFrame([("doctor", "nurse", 1.0), ("doctors", "nurse", 2.0), ("doctors", "nurse", None), ("doctor", "doctors", 4.0), ("nurse", "ward", 3.0), (None, "ward", 1.0)], "src string, dst string, weight double")
    found = sorted(map(tuple, canonical.contract(edges, names).collect()))
    assert found == [("doctors", "nurse", 3.0, 3), ("nurse", "ward", 3.0, 1)]
    assert ("doctors", "doctors", 4.0, 1) in set(map(tuple, canonical.contract(edges, names, loops=True).collect()))


def relations(spark, seed=2, n=300):
    r = random.Random(seed)
    rows = [(f"n{min(r.randrange(12), r.randrange(12))}", f"n{r.randrange(12)}", f"c{r.randrange(30)}") for _ in range(n)] + [("n1", None, "c1"), ("n1", "n2", None), ("pair a", "pair b", "c1"), ("pair a", "pair b", "c2")]
    return rows, spark.createDataFrame(rows, "source string, target string, chunk_id string")


def test_associations(spark):
    rows, frame = relations(spark)
    chunks = defaultdict(set)
    for s, t, c in rows:
        for x in (s, t):
            if x is not None and c is not None:
                chunks[x].add(c)
    n = len(set().union(*chunks.values()))
    right = {}
    for a, b in itertools.combinations(sorted(chunks), 2):
        both = len(chunks[a] & chunks[b])
        if both >= 2:
            ca, cb = len(chunks[a]), len(chunks[b])
            cells = [(both, ca * cb), (ca - both, ca * (n - cb)), (cb - both, (n - ca) * cb), (n - ca - cb + both, (n - ca) * (n - cb))]
            right[a, b] = (both, 1.0 if both == n else math.log(both * n / (ca * cb)) / -math.log(both / n), 2 * sum(o * math.log(o * n / e) for o, e in cells if o))
    found = {(r["node_1"], r["node_2"]): (r["n_chunks"], r["npmi"], r["llr"]) for r in association.associations(frame).collect()}
    assert found.keys() == right.keys() and all(found[k] == pytest.approx(right[k], abs=1e-9) for k in right)
    assert found["pair a", "pair b"][1] == pytest.approx(1.0)


def test_nodes_of_every_chunk(spark):
    frame = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2")], "source string, target string, chunk_id string")
    assert [tuple(r) for r in association.associations(frame).collect()] == [("a", "b", 2, 1.0, 0.0)]


def test_spread_and_generic_concepts(spark):
    rows, frame = relations(spark)
    counts = Counter((x, c) for s, t, c in rows for x in (s, t) if x is not None and c is not None)
    n = len({c for _, c in counts})
    right = {}
    for x in {x for x, _ in counts}:
        own = [k for (y, _), k in counts.items() if y == x]
        entropy = -sum(k / sum(own) * math.log(k / sum(own)) for k in own)
        right[x] = (sum(own), len(own), entropy, entropy / math.log(n))
    found = {r["node"]: (r["mentions"], r["n_chunks"], r["entropy"], r["evenness"]) for r in association.spread(frame).collect()}
    assert found.keys() == right.keys() and all(found[k] == pytest.approx(right[k], abs=1e-9) for k in right)
    common = {r["node"] for r in association.generic(frame, 0.3, 0.6).collect()}
    assert common == {x for x, (_, c, _, e) in right.items() if c >= 0.3 * n and e >= 0.6} and common
    left = association.without(frame, association.generic(frame, 0.3, 0.6)).collect()
    assert sorted(map(str, left)) == sorted(map(str, (r for r in frame.collect() if r["source"] not in common and r["target"] not in common)))
    assert association.spread(frame.limit(0)).isEmpty() and association.associations(frame.limit(0)).isEmpty()


def some_edges(seed=3, n=25, m=140):
    r = random.Random(seed)
    return [(f"v{min(r.randrange(n), r.randrange(n))}", f"v{r.randrange(n)}", float(r.choice([1, 1, 2, 3, 20, 100]))) for _ in range(m)]


@pytest.mark.parametrize("directed", [True, False])
def test_backbone(spark, directed):
    rows = some_edges() + [("only", "v0", 5.0), ("v1", "v2", 0.0), (None, "v1", 1.0), ("v1", "v2", None)]
    weights = Counter()
    for a, b, w in rows:
        if a is not None and w:
            weights[(a, b) if directed else tuple(sorted((a, b)))] += w
    chance = {}
    for (a, b), w in weights.items():
        if directed:
            sides = [[x for (c, _), x in weights.items() if c == a], [x for (_, c), x in weights.items() if c == b]]
        else:
            sides = [[x for e, x in weights.items() if v in e] for v in (a, b)]
        chance[a, b] = min((1 - w / sum(s)) ** (len(s) - 1) if len(s) > 1 else 1.0 for s in sides)
    frame = spark.createDataFrame(rows, "src string, dst string, weight double")
    found = {(r["src"], r["dst"]): r["chance"] for r in backbone.disparity(frame, directed).collect()}
    assert found == pytest.approx(chance)
    kept = {(r["src"], r["dst"]) for r in backbone.backbone(frame, 0.1, directed).collect()}
    assert kept == {e for e, p in chance.items() if p < 0.1} and 0 < len(kept) < len(chance)


def peeled(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out, k = {}, 0
    while near:
        low = [v for v in near if len(near[v]) <= k]
        if not low:
            k += 1
        for v in low:
            out[v] = k
            for w in near.pop(v):
                if w in near:
                    near[w].discard(v)
    return out


def test_core_numbers(spark):
    pairs = [(a, b) for a, b, _ in some_edges()] + [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)] + [("k0", f"leaf{i}") for i in range(40)] + [(f"path{i}", f"path{i + 1}") for i in range(30)] + [("loop", "loop"), (None, "k1")]
    frame = spark.createDataFrame(pairs, "src string, dst string")
    assert {r["id"]: r["core"] for r in cores.core_numbers(frame).collect()} == peeled([p for p in pairs if None not in p])
    bounds = {r["id"]: r["core"] for r in cores.core_numbers(frame, rounds=1).collect()}
    assert all(bounds[v] >= k for v, k in peeled([p for p in pairs if None not in p]).items())
    assert cores.core_numbers(frame.limit(0)).isEmpty()


def exact_ranks(rows, seed, alpha):
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    at, m = {v: i for i, v in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
    for a, b, w in rows:
        m[at[a], at[b]] += w
        if a != b:
            m[at[b], at[a]] += w
    step = m / m.sum(axis=1, keepdims=True)
    one = np.zeros(len(nodes))
    one[at[seed]] = alpha
    return dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - (1 - alpha) * step.T, one), strict=True))


@pytest.mark.parametrize(("eps", "rounds"), [(1e-3, None), (1e-5, None), (1e-4, 2)])
def test_scores_are_within_their_bounds(spark, eps, rounds):
    rows = some_edges()
    frame, seeds = spark.createDataFrame(rows + [(None, "v1", 1.0), ("v1", "v2", 0.0)], "src string, dst string, weight double"), ["v0", "v3", "v3", "not there"]
    found = defaultdict(dict)
    for r in retrieve.push(frame, spark.createDataFrame([(s,) for s in seeds], "seed string"), 0.15, eps, rounds).collect():
        found[r["seed"]][r["node"]] = (r["score"], r["bound"], r["residual"])
    assert set(found) == {"v0", "v3"}
    for seed, own in found.items():
        assert sum(x[0] + x[2] for x in own.values()) == pytest.approx(1)
        for node, right in exact_ranks(rows, seed, 0.15).items():
            score, bound, _ = own.get(node, (0.0, eps * 1e9, 0.0))
            assert score <= right + 1e-9 and right - score <= bound + 1e-9


def test_the_best_neighbours(spark):
    rows = some_edges()
    frame = spark.createDataFrame(rows, "src string, dst string, weight double")
    found = retrieve.retrieve_neighbours(frame, spark.createDataFrame([("v3",)], "seed string"), k=4, eps=1e-8).orderBy("rank").collect()
    right = sorted(((-round(x, 6), v) for v, x in exact_ranks(rows, "v3", 0.15).items() if v != "v3"))[:4]
    assert [(r["node"], r["rank"]) for r in found] == [(v, i) for i, (_, v) in enumerate(right, 1)]


def test_sets_that_share_two_rare_tokens_only_do_not_meet(spark):
    """Sets meet by three of their first tokens: 60 sets that share two rare ones have no key in common."""
    rows = [(i, ["a", "b", *[f"{i}-{k}" for k in range(6)]], 8, 6) for i in range(60)]
    heads = similar._together(spark.createDataFrame(rows, "id long, tokens array<string>, n int, must int"), 75, 3)
    assert heads.count() == 60 * 10  # three of the first five
    assert heads.select("id", "key").distinct().groupBy("key").count().where("count > 1").isEmpty()
    assert similar.similar_sets(spark.createDataFrame(rows, "id long, tokens array<string>, n int, must int").select("id", "tokens")).isEmpty()
