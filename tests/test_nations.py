"""The nation graph holds every line, whatever the ids; only communities are taken above a weight threshold."""

from weftgraph.plans import queries


def tables(spark, folder):
    """Three nations; suppliers and customers have their nation's number. Pairs (0, 0), (0, 1), (2, 1) with 1, 2 and 6 lines."""
    lines = [(order, supplier) for order, supplier, n in ((0, 0, 1), (1, 0, 2), (2, 2, 6)) for _ in range(n)]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_suppkey long"),
        ("orders", [(0, 0), (1, 1), (2, 1)], "o_orderkey long, o_custkey long"),
        ("customer", [(k, k) for k in range(3)], "c_custkey long, c_nationkey int"),
        ("supplier", [(k, k) for k in range(3)], "s_suppkey long, s_nationkey int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_line_counts(spark, tmp_path):
    found = {(r["src"], r["dst"]): r["weight"] for r in queries.nation_graph(spark, tables(spark, tmp_path)).collect()}
    assert found == {("0", "0"): 1, ("0", "1"): 2, ("2", "1"): 6}


def test_communities_are_taken_of_heavy_pairs_and_styles_of_all_nodes(spark, tmp_path):
    d = tables(spark, tmp_path)
    assert {r["node"] for r in queries.communities_gn(spark, d).collect()} == {"1", "2"}
    assert {r["id"]: r["group"] for r in queries.node_style(spark, d).collect()} == {"0": 0, "1": 1, "2": 2}
