"""The deterministic extractors of concepts and of judgements."""

import json

from weftgraph.operators import extract


def test_frequent_words_are_concepts():
    found = extract.FrequentWords(4)(["Tree tree TREE a1b2 house tree tree tree", "", "été_tree"])
    assert [json.loads(x) for x in found] == [
        [{"entity": "tree", "importance": 5, "category": "concept"}, {"entity": "house", "importance": 1, "category": "concept"}], [], [{"entity": "tree", "importance": 1, "category": "concept"}],
    ]


def test_a_sentence_that_names_both_relates_them(spark):
    rows = [("1", "Ada", "Bob", "x. Ada met Bob! Bob left."), ("2", "Ada", "Bob", "Ada came. Bob left."), ("3", "Ada", None, "Ada"), ("4", "O'Neil', 'x", "Bob", "O'Neil', 'x and Bob")]
    frame = spark.createDataFrame(rows, "chunk_id string, entity_1 string, entity_2 string, text string")
    found = {r["chunk_id"]: (r["relationship"], r["related"]) for r in extract.judged_pairs(frame, extract.SameSentence).collect()}
    assert found["1"] == ("Ada met Bob", True) and found["2"] == ("", False) and found["3"] == (None, None)


def test_rows_by_column_are_those_by_row(spark, monkeypatch):
    monkeypatch.setattr(extract, "ROWS", 7)
    texts = ["", None, "one", "alpha beta gamma, alpha", "x " * 50, " ".join(f"word{chr(97 + i)}" for i in range(20))]
    frame = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    one = extract.RegexRelations()
    at, values = one.columns([x or "" for x in texts])
    found = sorted(tuple(r) for r in extract.extract(frame, extract.RegexRelations).collect())
    assert found == sorted((i, *r.values()) for i, rows in enumerate(one.rows([x or "" for x in texts])) for r in rows)
    assert len(at) == len(found) == len(values["source"]) == 3 + 19


def test_strip_trims_only_what_has_space_at_an_end(spark):
    from weftgraph.functions.text import strip

    texts = ["", " ", "a", " a", "a　", "\x85a b\t", "é ", " x", "a\nb", None, "   ", "\U0001f600 "]
    frame = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in frame.select(strip("t")).collect()] == [x if x is None else x.strip() for x in texts]
    assert "CASE WHEN" in frame.select(strip("t"))._jdf.queryExecution().optimizedPlan().toString()
