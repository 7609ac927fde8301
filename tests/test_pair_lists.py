"""Pairs as lists by first node, and edges merged with both directions in one row: the same rows as by plain loops, with less to shuffle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import association, merge, proximity
from weftgraph.operators.graph import backbone, build
from weftgraph.schemas import DIRECTED, NOTEBOOK, PIPELINE
from weftgraph.streaming import proximity as stream

SCHEMA = "chunk_id string, source string, target string, relationship string, weight double, description string, ord long"


def rows(spark, n=160, odd=True):
    r = random.Random(5)
    name = lambda: r.choice(["", "a\nb", "a", *[f"n{i}" for i in range(9)]] if odd else [f"n{i}" for i in range(9)])
    made = [(f"c{r.randrange(7)}", name(), name(), f"r{r.randrange(4)}", float(r.randrange(1, 9)), f"d{r.randrange(4)}", i) for i in range(n)]
    return spark.createDataFrame([*made, (None, "n1", "n2", "r", 1.0, "d", n), ("c1", None, "n2", "r", 1.0, "d", n + 1), ("c8", "n1", "n1", "r", None, "d", n + 2)], SCHEMA)


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def of_loops(relations):
    out = Counter()
    for c in {r["chunk_id"] for r in relations if r["chunk_id"] is not None}:
        m = Counter(x for r in relations if r["chunk_id"] == c for x in (r["source"], r["target"]) if x is not None)
        out.update({(a, b): m[a] * m[b] for a in m for b in m if a < b})
    return out


@pytest.mark.parametrize(("block", "hot", "lanes"), [(256, 10**6, 100_000), (3, 10**6, 100_000), (2, 9, 2)])
def test_pairs_of_large_chunks_hot_chunks_and_frequent_nodes(spark, monkeypatch, block, hot, lanes):
    relations = rows(spark)
    for name, value in (("BLOCK", block), ("HOT", hot), ("LANE", lanes)):
        monkeypatch.setattr(proximity, name, value, raising=False)
    want = of_loops(relations.collect())
    found = proximity.pairs(proximity.mentions(relations)).collect()
    assert {(r["node_1"], r["node_2"]): r["count"] for r in found} == want and len(found) == len(want)
    assert all(len(r["chunk_ids"]) == r["count"] and r["chunk_ids"] == sorted(r["chunk_ids"]) for r in found)


def many(spark):
    r = random.Random(4)
    return spark.createDataFrame([(f"c{k // 9}", f"s{r.randrange(10**6)}", f"p{r.randrange(10**6)}", "r", 1.0, "d", k) for k in range(18_000)], SCHEMA)


def test_pairs_are_shuffled_once_and_in_lists(spark):
    relations, before = many(spark), shuffled(spark)
    proximity.half(relations, chunks=False).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 11 * (2000 * 18 * 17 // 2)


@pytest.mark.parametrize("mode", [DIRECTED, PIPELINE])
@pytest.mark.parametrize("chunks", [True, False])
def test_merging_by_halves_says_the_same(spark, mode, chunks):
    relations = rows(spark)
    want = merge.rendered(merge.merge(relations, proximity.proximity(relations, mode, chunks), mode, chunks), mode)
    found = merge.rendered(merge.merge_half(relations, proximity.half(relations, chunks), mode, chunks), mode)
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_edges_written_last_and_weights_alone_by_halves(spark):
    relations = rows(spark, 60)
    near, half = proximity.proximity(relations), proximity.half(relations, chunks=False)
    want = build.last_written(merge.merge_counts(relations, near, mode=NOTEBOOK))
    assert sorted(map(str, merge.last_counts(relations, half).collect())) == sorted(map(str, want.select("src", "dst", "title", "weight").collect()))
    whole = merge.merge(relations, near).select("source", "target", "weight")
    assert sorted(map(str, merge.summed_half(relations, half).collect())) == sorted(map(str, whole.collect()))
    for df in (merge.last_counts(relations, half), merge.summed_half(relations, half)):
        df.write.format("noop").mode("overwrite").save()


def test_single_edges_are_not_added_up_again(spark):
    edges = merge.summed_half(r := rows(spark, odd=False), proximity.half(r, chunks=False)).withColumnsRenamed({"source": "src", "target": "dst"})
    want, found = (backbone.disparity(edges, single=single) for single in (False, True))
    key = lambda df: sorted((r["src"], r["dst"], r["weight"], round(r["chance"], 9)) for r in df.collect())
    assert key(found) == key(want)


def test_associations_carry_no_numbers_of_nodes_through_the_pairs(spark):
    relations, before = many(spark), shuffled(spark)
    association.associations(relations).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 17 * (2000 * 18 * 17 // 2)
    small = rows(spark, odd=False)
    n = {}
    for c, a, b in {(r["chunk_id"], *p) for r in small.collect() if r["chunk_id"] for p in [(r["source"], r["target"])]}:
        n.setdefault(c, set()).update(x for x in (a, b) if x is not None)
    both = Counter((a, b) for nodes in n.values() for a in nodes for b in nodes if a < b)
    assert {(r["node_1"], r["node_2"]): r["n_chunks"] for r in association.associations(small).collect()} == {p: k for p, k in both.items() if k > 1}


def test_a_stream_writes_lists_as_they_are_shuffled(spark, tmp_path):
    """As one text for each first node, with counts only where some aren't 1; names with line breaks as a list."""
    lines = [("c1", "a", "b", 1), ("c1", "c", "d", 2), ("c2", "a", "a", 3), ("c2", "b", "x", 4), ("c3", "m\nn", "o", 5)]
    for number in (0, 1):
        part = spark.createDataFrame([x for x in lines if x[3] % 2 == number], "chunk_id string, source string, target string, key long")
        stream.add_batch(part, str(tmp_path), number, "key")
    written = spark.read.parquet(f"{tmp_path}/pairs").where("batch = 1")
    found = sorted((r["node_1"], r["text"], r["plain"], r["counts"]) for r in written.where("text is not null").collect())
    assert found == [("a", "b\nc\nd", None, None), ("a", "b\nx", None, [2, 2]), ("b", "c\nd", None, None)]
    assert [(r["node_1"], r["plain"], r["counts"]) for r in written.where("text is null").collect()] == [("m\nn", ["o"], None)]
    want = {("a", "b"): 3, ("a", "c"): 1, ("a", "d"): 1, ("a", "x"): 2, ("b", "c"): 1, ("b", "d"): 1, ("b", "x"): 1, ("c", "d"): 1, ("m\nn", "o"): 1}
    assert {(r["node_1"], r["node_2"]): r["count"] for r in stream.totals(spark, str(tmp_path), 1).collect()} == want
