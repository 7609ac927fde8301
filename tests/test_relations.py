"""Cleaning, proximity and merging, on rows small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import clean, concepts, entities, merge, proximity
from weftgraph.plans import flows
from weftgraph.schemas import DIRECTED, NOTEBOOK, PIPELINE

RELATION = "source string, target string, relationship string, weight string, description string, chunk_id string, ord long"


def relations(spark, *rows):
    full = [(r + (None,) * 7)[:7] for r in rows]
    return spark.createDataFrame([(*r[:6], i) for i, r in enumerate(full)], RELATION)


def edge(a, b, chunk, relationship="r", weight="5"):
    return (a, b, relationship, weight, "", chunk)


def pairs(frame):
    return {(r["source"], r["target"]): r["count"] for r in frame.collect()}


def test_count_is_the_product_of_mentions(spark):
    rows = relations(spark, edge("a", "b", "c1"), edge("a", "c", "c1"), edge("a", "a", "c1"), edge("b", "a", "c2"))
    assert pairs(proximity.proximity(rows, least=1)) == {("a", "b"): 5, ("b", "a"): 5, ("a", "c"): 4, ("c", "a"): 4, ("b", "c"): 1, ("c", "b"): 1}
    near = proximity.proximity(rows)
    assert set(pairs(near)) == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    assert {r["weight"] for r in near.collect()} == {3.0}
    assert {tuple(r["chunk_ids"]) for r in near.where("source = 'a' and target = 'b'").collect()} == {("c1",) * 4 + ("c2",)}


def test_a_chunk_with_one_relation_gives_no_proximity(spark):
    assert proximity.proximity(relations(spark, edge("a", "b", "c1"))).isEmpty()


def test_null_chunks_and_empty_nodes_give_no_proximity(spark):
    rows = relations(spark, edge("a", "b", None), edge("a", "b", None), edge("", "b", "c"), edge("", "b", "c"))
    assert proximity.proximity(rows).isEmpty()


def test_blanks(spark):
    rows = relations(spark, edge("", "b", "c"), edge(None, "b", "c"), edge(" ", "b", "c"), edge("a", "b", "c", ""), edge(" A ", "\tB\n", "c", " Is "))
    faithful = clean.clean_relations(rows).select("source", "target", "relationship").collect()
    assert {tuple(r) for r in faithful} == {("", "b", "r"), ("a", "b", "is")}
    assert {tuple(r) for r in clean.clean_relations(rows, strict_blank=True).select("source", "target", "relationship").collect()} == {("a", "b", "is")}


def test_weights(spark):
    rows = spark.createDataFrame([(x,) for x in ("7", "high", None, "12", "-3", "nan")], "w string")
    assert [r[0] for r in rows.select(text.weight("w", 5)).collect()] == [7.0, 5.0, 5.0, 10.0, 1.0, 5.0]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="relationship"):
        clean.clean_relations(relations(spark, edge("a", "b", "c")).drop("relationship"))


def test_defaults_and_old_schema(spark):
    old = spark.createDataFrame([("a", "b", "r", "12", "c"), ("a", "b", "r", None, "c")], "node_1 string, node_2 string, edge string, count string, chunk_id string")
    assert sorted(r["weight"] for r in clean.from_legacy(old).collect()) == [4.0, 10.0]
    assert {r["weight"] for r in clean.from_legacy(old.drop("count")).collect()} == {4.0}


def test_old_schema_keeps_nothing_but_the_count(spark):
    old = spark.createDataFrame([("a", "b", "r", 7, "x", "c")], "node_1 string, node_2 string, edge string, weight int, description string, chunk_id string")
    row = clean.from_legacy(old).first()
    assert (row["source"], row["target"], row["relationship"], row["weight"], row["description"], row["chunk_id"]) == ("a", "b", "r", 4.0, "", "c")
    both = old.withColumn("source", F.lit("s"))
    assert clean.from_legacy(both).columns == both.columns


def test_white_space_of_all_kinds_is_stripped(spark):
    rows = spark.createDataFrame([("\u2003\x1c a\u3000b \u00a0\n",), ("",), (None,)], "x string")
    assert [r[0] for r in rows.select(text.strip("x")).collect()] == ["a\u3000b", "", None]


def test_na_texts(spark):
    rows = spark.createDataFrame([(x,) for x in ("None", "null", "NULL", "NA", "N/A", "n/a", "nan", "<NA>", "none", "na", "-", "unknown")], "x string")
    assert [r[0] for r in rows.select(text.na_to_null("x").alias("y")).where("y is not null").collect()] == ["none", "na", "-", "unknown"]


def merged(spark, mode):
    rows = relations(spark, edge("a", "b", "c1", "r1", "1"), edge("a", "b", "c1", "r2", "2"), edge("a", "b", "c2", "r1", "3")).withColumn("weight", F.col("weight").cast("double"))
    return merge.rendered(merge.merge(rows, proximity.proximity(rows, mode), mode), mode).where("source = 'a' and target = 'b'").first()


def test_merge_keeps_order_and_drops_repeats_if_told(spark):
    assert merged(spark, DIRECTED)["relationship"] == "r1 | r2 | contextual proximity"
    assert merged(spark, PIPELINE)["relationship"] == "r1,r2,r1,contextual proximity"
    row = merged(spark, DIRECTED)
    assert (row["label"], row["weight"]) == ("r1", 9.0)
    assert row["chunk_id"] == "c1,c1,c2,c1,c1,c1,c1,c2"


@pytest.mark.parametrize("mode", [DIRECTED, PIPELINE])
def test_merge_without_chunk_lists_says_the_same(spark, mode):
    rows = relations(spark, *[edge(f"n{i % 3}", f"n{(i * 7) % 5}", f"c{i % 4}", f"r{i % 6}") for i in range(60)], edge("lone", "one", "z"))
    rows = rows.withColumn("weight", F.col("weight").cast("double"))
    whole, bare = (flows.merged_edges(rows, mode, chunks) for chunks in (True, False))
    assert "chunk_id" not in bare.columns and sorted(map(str, whole.select(bare.columns).collect())) == sorted(map(str, bare.collect()))


def test_all_null_weights_sum_to_zero(spark):
    rows = relations(spark, edge("a", "b", "c", "r", None)).withColumn("weight", F.col("weight").cast("double"))
    assert merge.merge(rows, proximity.proximity(rows)).first()["weight"] == 0.0


def test_a_label_read_back_is_cut_at_the_separator(spark):
    rows = relations(spark, edge("a", "b", "c", "is, or was")).withColumn("weight", F.lit(1.0))
    out = merge.rendered(merge.merge(rows, proximity.proximity(rows), PIPELINE), PIPELINE)
    assert out.first()["label"] == "is, or was"
    assert merge.split_label(out, PIPELINE).first()["label"] == "is"


def test_notebook_counts(spark):
    rows = relations(spark, edge("a", "b", "c1"), edge("b", "a", "c1"))
    found = {(r["node_1"], r["node_2"]): (r["count"], r["edge"]) for r in merge.merge_counts(rows, proximity.proximity(rows, NOTEBOOK)).collect()}
    assert found[("a", "b")] == (8, "r,contextual proximity")


def test_merge_does_not_depend_on_row_order(spark):
    rows = relations(spark, *[edge(f"n{i % 3}", f"n{(i * 7) % 5}", f"c{i % 4}", f"r{i % 6}") for i in range(60)]).withColumn("weight", F.col("weight").cast("double"))
    flow = lambda r: sorted(map(str, flows.merged_edges(r, DIRECTED).collect()))
    assert flow(rows) == flow(rows.orderBy(F.rand(1)).repartition(3))


def test_top_edges_break_ties_by_ends(spark):
    rows = spark.createDataFrame([("b", "a", 1.0), ("a", "c", 1.0), ("a", "b", 2.0)], "source string, target string, weight double")
    assert [(r["source"], r["target"]) for r in merge.top_edges(rows, 2).collect()] == [("a", "b"), ("a", "c")]


def test_concepts_filter_left_mentions_only_and_average_mentions(spark):
    rows = spark.createDataFrame([("x", 1, "c"), ("x", 5, "c"), ("y", 2, "c"), ("z", 1, "c"), ("w", None, "c")], "entity string, importance int, chunk_id string")
    found = {(r["entity_L"], r["entity_R"]): (r["importance_L"], r["importance_R"], r["count"]) for r in concepts.cooccurrence(rows).collect()}
    assert found[("y", "x")] == (2.0, 3.0, 2)
    assert found[("x", "y")] == (5.0, 2.0, 1)
    assert found[("w", "z")] == (None, 1.0, 1)
    assert not any(left == "z" for left, _ in found)


def test_concepts_lose_only_single_spaces_and_nulls(spark):
    rows = spark.createDataFrame([(" ",), ("",), (None,), ("  A",)], "entity string")
    assert {r[0] for r in clean.clean_concepts(rows).collect()} == {"", "  a"}


def test_dropped_nodes_are_case_sensitive(spark):
    rows = spark.createDataFrame([("Accelerating Global Health", "a"), ("accelerating global health", "a")], "entity_L string, entity_R string")
    assert clean.drop_nodes(rows, ("Accelerating Global Health",)).count() == 1


def test_entity_counts(spark):
    rows = spark.createDataFrame([("n", "e", "c2"), ("n", "e", "c1"), ("n", "e", "c1"), ("n", None, "c")], "name string, entity string, chunk_id string")
    counted = entities.counts_by_chunk(rows)
    assert {tuple(r) for r in counted.collect()} == {("n", "e", "c1", 2), ("n", "e", "c2", 1)}
    assert tuple(entities.totals(counted).first()) == ("n", "e", 3, "c1,c2")
    assert tuple(entities.top(counted).first()) == ("n", "e", 3)


def test_flow_of_cached_relations(spark):
    rows = spark.createDataFrame([("A", "b", "r", "NA", "c"), ("nan", "b", "r", "3", "c")], "source string, target string, relationship string, weight string, chunk_id string")
    assert [tuple(r) for r in flows.prepared(rows, DIRECTED).select("source", "weight").collect()] == [("a", 4.0)]
    assert [tuple(r) for r in flows.prepared(rows, PIPELINE).select("source", "weight").collect()] == [("A", None)]
    assert [r["weight"] for r in flows.prepared(rows, DIRECTED, cached=False).where("source = 'a'").collect()] == [5.0]


def test_pairs_of_common_nodes_are_dealt_over_lanes(spark, monkeypatch):
    """A node's pairs have a key for each ``LANE`` chunks that mention it, and counts and lists don't depend on that."""
    rows = [(f"c{i:03}", "hub", f"n{i % 20}") for i in range(100)] + [(f"c{i:03}", "a", "hub") for i in range(0, 100, 3)]
    counted = proximity.mentions(spark.createDataFrame(rows, "chunk_id string, source string, target string"))
    found = []
    for lane in (100_000, 10):
        monkeypatch.setattr(proximity, "LANE", lane)
        found.append(sorted(map(tuple, proximity.pairs(counted, least=2).collect())))
    assert found[0] == found[1] and len(found[0]) == 35
    assert max(r["lanes"] for r in proximity._laned(counted).collect()) == 10
