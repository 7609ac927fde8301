"""Document terms: words of the extractor's default length, and the graph of their neighbourhoods."""

from weftgraph.plans import queries


def test_words_of_four_letters_and_their_graph(spark, tmp_path):
    rows = [(1, "s", "Blue sky over blue hills; the blue hills sleep")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r["source"], r["target"]) for r in queries.doc_term_relations(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted([("blue", "over"), ("over", "blue"), ("blue", "hills"), ("hills", "blue"), ("blue", "hills"), ("hills", "sleep")])
    graph = {(r["src"], r["dst"]): r["weight"] for r in queries.QUERIES["doc_term_graph"](spark, str(tmp_path)).collect()}
    assert graph == {("blue", "over"): 1, ("over", "blue"): 1, ("blue", "hills"): 2, ("hills", "blue"): 1, ("hills", "sleep"): 1}
