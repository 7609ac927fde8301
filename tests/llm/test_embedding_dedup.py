import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import embedding_dedup as ed


def brute(rows, threshold=0.98):
    good = [(i, label, np.array(v, float)) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    head, links = {i: i for i, _, _ in rows}, {}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for x, (i, a, u) in enumerate(good):
        for j, b, v in good[x + 1 :]:
            if a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                p, q = sorted((find(i), find(j)))
                head[q] = p
    return {i: (links.get(i, 0), find(i), find(i) == i) for i, _, _ in rows}


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"links": F.lit(1), "rep": F.lit(2)})
    return {r["vec_id"]: tuple(r)[1:] for r in ed.near_vectors(frame, **options).collect()}


def corpus(seed, groups=40, each=12, size=32, noise=0.02):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = r.normal(size=size)
        rows += [base + noise * r.normal(size=size) * r.integers(0, 8) for _ in range(int(r.integers(1, each)))]
    rows = [np.float32(x).tolist() for x in rows]
    rows += rows[:20] + [[2 * a for a in x] for x in rows[:5]]
    return [(i, x, int(r.integers(3)) if i % 7 else 1) for i, x in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"leaf_limit": 20}, {"leaf_limit": 20, "sample": 60}])
def test_equals_brute_force(spark, options):
    rows = corpus(1)
    got, want = run(spark, rows, **options), brute(rows)
    assert set(got) == set(want)
    found, every = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert every > 300 and found >= 0.995 * every
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)


def test_odd_rows(spark):
    nan = float("nan")
    v = [1.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0, 2.0, 0.0], 1), (10, [None, 1.0], 1), (11, [2.0, 4.0], 1), (12, v, 2), (13, [-1.0, -2.0], 1)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, ed.near_vectors(frame).collect())) == sorted(map(str, [*[__import__("pyspark").sql.Row(vec_id=1, n_links=1, component_id=1, kept=True)] * 2, __import__("pyspark").sql.Row(vec_id=None, n_links=0, component_id=None, kept=True)]))
    assert ed.near_vectors(frame.limit(0)).collect() == []


def test_dense_groups_are_counted_exactly_in_blocks(spark):
    """A group of 150 vectors within the threshold of each other can't be split; every one of its links counts."""
    r = np.random.default_rng(5)
    base = r.normal(size=32)
    rows = [(i, np.float32(base + 0.01 * r.normal(size=32)).tolist(), 1) for i in range(150)] + [(200 + i, np.float32(r.normal(size=32)).tolist(), 1) for i in range(150)]
    got = run(spark, rows, leaf_limit=20, sample=50)
    assert got == brute(rows) and got[0][0] == 149


def test_leaves_are_split_until_they_are_small(spark):
    r = np.random.default_rng(6)
    reps = spark.createDataFrame([(i, i, np.float32(r.normal(size=24)).tolist()) for i in range(3000)], "rep long, a long, v array<float>")
    members = ed._split_again(reps.select("rep", "a", F.lit(1).cast("long").alias("leaf")), reps, 0.98, 40)
    sizes = [x["count"] for x in members.groupBy("leaf").count().collect()]
    assert max(sizes) <= 40 and members.select("rep").distinct().count() == 3000 and sum(sizes) < 3 * 3000


def test_spill_keeps_near_pairs_together():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.018 * r.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (x * y).sum(axis=1) >= 0.98
    forest = ed.Forest(8, 0.98, 30)
    forest.fit("a", x)
    met, copies = np.zeros(len(x), bool), 0
    (rows, leaves), (others, found) = forest.route("a", x), forest.route("a", y)
    a, b = ({(i, leaf) for i, leaf in zip(p.tolist(), q.tolist(), strict=True)} for p, q in ((rows, leaves), (others, found)))
    met[[i for i, _ in a & b]] = True
    copies = len(rows) / len(x)
    assert near.sum() > 1000 and met[near].mean() > 0.999
    assert copies < 24
