"""Forces of cells against those of all pairs, drawings of known graphs, and tiles that leave nothing out."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators.graph import layout
from weftgraph.sources import tiles


def places_of(spark, points):
    return spark.createDataFrame([(f"v{i:04}", float(x), float(y)) for i, (x, y) in enumerate(points)], "id string, x double, y double")


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_cells_push_as_all_pairs_do(spark, kind):
    r = np.random.default_rng(2)
    points = r.random((600, 2)) * 25 if kind == "even" else np.concatenate([r.normal(c, 1.5, (150, 2)) for c in ((0, 0), (20, 3), (8, 17), (21, 22))])
    d = points[:, None] - points[None]
    square = np.maximum((d**2).sum(axis=2), layout.NEAR)
    exact = (d / square[:, :, None]).sum(axis=1)
    found = {x["id"]: (x["fx"], x["fy"]) for x in layout.repulsion(places_of(spark, points)).collect()}
    got = np.array([found[f"v{i:04}"] for i in range(len(points))])
    off = np.linalg.norm(got - exact, axis=1) / np.linalg.norm(exact, axis=1).mean()
    assert np.median(off) < 0.08 and np.corrcoef(got.ravel(), exact.ravel())[0, 1] > 0.97


def test_every_pair_of_cells_meets_once(spark):
    """With one node a cell, a pair met on two levels or on none would show."""
    side = 16
    points = [(i + 0.5, j + 0.5) for i in range(side) for j in range(side)]
    found = {x["id"]: (x["fx"], x["fy"]) for x in layout.repulsion(places_of(spark, points), per_cell=1.0).collect()}
    p = np.array(points)
    d = p[:, None] - p[None]
    exact = (d / np.maximum((d**2).sum(axis=2), layout.NEAR)[:, :, None]).sum(axis=1)
    got = np.array([found[f"v{i:04}"] for i in range(len(points))])
    assert np.abs(got - exact).max() < 0.1 * np.abs(exact).max()


def test_neighbours_end_up_near_each_other(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i, j in itertools.combinations(range(6), 2)] + [("a0", "b0", 0.5), ("b1", "c0", 0.5), ("a0", "a0", 9.0), (None, "a1", 1.0), ("a1", "z", 0.0)]
    edges = spark.createDataFrame(cliques, "src string, dst string, weight double")
    found = {r["id"]: np.array([r["x"], r["y"]]) for r in layout.layout(edges, rounds=8).collect()}
    assert set(found) == {f"{c}{i}" for c in "abc" for i in range(6)} | {"z"}
    far = {(a, b): np.linalg.norm(found[a] - found[b]) for a, b in itertools.combinations(sorted(x for x in found if x != "z"), 2)}
    inside = np.mean([x for (a, b), x in far.items() if a[0] == b[0]])
    across = np.mean([x for (a, b), x in far.items() if a[0] != b[0]])
    assert across > 1.6 * inside
    assert layout.layout(edges.limit(0)).isEmpty()


def test_tiles_leave_nothing_out(spark, tmp_path):
    r = random.Random(3)
    nodes = [(f"v{i}", r.random() * 40 - 20, r.random() * 10, float(r.randrange(9)), "#112233") for i in range(900)]
    links = [(f"v{r.randrange(900)}", f"v{r.randrange(900)}", 1.0) for _ in range(2000)]
    places, edges = spark.createDataFrame(nodes, "id string, x double, y double, weight double, color string"), spark.createDataFrame(links, "src string, dst string, weight double")
    written = tiles.write_tiles(places, edges, f"file://{tmp_path}").collect()
    last = tiles.zoom_levels(900)
    assert last >= 1 and {x["z"] for x in written} == set(range(last + 1)) and (tmp_path / "index.html").read_text().startswith("<!DOCTYPE html>")
    where = {i: ((x + 20), y) for i, x, y, _, _ in nodes}
    for z in range(last + 1):
        items = [json.loads(line) for f in (tmp_path / "tiles" / str(z)).rglob("*.json") for line in f.read_text().splitlines()]
        assert sum(x["n"] for x in items if x["k"] == "n") == 900 and len(items) == sum(x["items"] for x in written if x["z"] == z)
        if z == last:
            assert {x["id"] for x in items if x["k"] == "n"} == set(where)
        assert all(0 <= x["x"] <= 1 and 0 <= x["y"] <= 1 for x in items)
    rows = tiles.tile_rows(places, edges)
    lines = rows.where("kind = 'e'").groupBy("z").agg(F.countDistinct("x", "y", "u", "v").alias("n")).collect()
    assert len(lines) == last + 1
    whole = rows.where("kind = 'e'").dropDuplicates(["z", "x", "y", "u", "v"]).groupBy("z").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    loops = sum(a == b for a, b, _ in links)
    assert all(x["n"] <= 2000 - loops and x["w"] == x["n"] for x in whole) and max(x["n"] for x in whole) > 0.9 * (2000 - loops)


def test_tiles_of_one_node_and_of_none(spark, tmp_path):
    schema = "id string, x double, y double, weight double, color string"
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert [tuple(r) for r in tiles.write_tiles(spark.createDataFrame([("a", 3.0, 3.0, None, None)], schema), edges, f"file://{tmp_path}/one").collect()] == [(0, 0, 0, 1)]
    assert tiles.write_tiles(spark.createDataFrame([], schema), edges, f"file://{tmp_path}/none").isEmpty()


def test_no_side_of_a_join_is_sent_to_the_driver(spark):
    """Small enough to be broadcast, each would go by way of the driver in every round."""
    places = places_of(spark, [(0.1 * i, 0.2 * i) for i in range(30)])
    edges = spark.createDataFrame([("v0000", "v0001", 1.0)], "src string, dst string, weight double")
    drawn = tiles.tile_rows(places.withColumns({"weight": F.lit(1.0), "color": F.lit("#112233")}), edges)
    for df in (layout.repulsion(places), drawn):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
