"""Chunking, extraction, files, pages, the model server's client, and streaming."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import chunking, clean, extract
from weftgraph.plans import flows
from weftgraph.schemas import CHUNKS_CSV, CONCEPTS
from weftgraph.sources import files, html
from weftgraph.sources.model_server import Client
from weftgraph.streaming import proximity as stream


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.data())
def test_chunks_are_short_and_cover_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    chunks = chunking.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    at = 0
    for c in chunks:  # chunks follow each other in the text
        found = text.find(c, max(0, at - len(c) - size))
        assert found >= 0
        at = found + len(c)


def test_chunks_split_at_the_coarsest_separator():
    assert chunking.split_text("aaa\n\nbbb\n\nccc", 8, 0) == ["aaa\n\nbbb", "ccc"]
    assert chunking.split_text("one two three four", 10, 4) == ["one two", "two three", "four"]
    assert chunking.split_text("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "s", "abcdefghij"), (2, "s", ""), (3, "s", None)], "doc_id long, source string, text string")
    fixed = chunking.fixed_chunks(docs, 4, 1).orderBy("pos").collect()
    assert [r["text"] for r in fixed] == ["abcd", "defg", "ghij"]
    assert len({r["chunk_id"] for r in fixed}) == 3 and all(len(r["chunk_id"]) == 32 for r in fixed)
    found = chunking.recursive_chunks(docs, 4, 1)
    assert sorted(map(str, found.collect())) == sorted(map(str, chunking.recursive_chunks(docs.repartition(3), 4, 1).collect()))
    assert [r["text"] for r in chunking.chunk_range(found, 1, 2).collect()] == ["defg"]
    with pytest.raises(ValueError):
        chunking.recursive_chunks(docs, 4, 4)


ANSWERS = ['[{"source": "a", "target": "b", "relationship": "r", "weight": 7, "chunk_id": "x"}]', "oops", '{"source": "a"}', '[{"source": "a"}, 5]', None, "[]", '[{"source":', '[{"source": "a"}] done']


def test_only_lists_of_objects_have_rows(spark):
    rows = spark.createDataFrame([(f"c{i}", a) for i, a in enumerate(ANSWERS)], "chunk_id string, answer string")
    found = extract.parse_rows(rows, "answer", extract.RELATION).collect()
    assert [(r["chunk_id"], r["source"], r["weight"]) for r in found] == [("c0", "a", "7")]
    with pytest.raises(Exception, match="not a JSON list"):
        extract.parse_rows(rows, "answer", extract.RELATION, fail_fast=True).collect()


@pytest.mark.parametrize("answer", [None, "oops", "[1]"])
def test_strict_parsing_names_the_answer(spark, answer):
    rows = spark.createDataFrame([("c", answer)], "chunk_id string, answer string")
    with pytest.raises(Exception, match=f"not a JSON list of objects: {'no answer' if answer is None else ''}"):
        extract.parse_rows(rows, "answer", extract.RELATION, fail_fast=True).collect()
    with pytest.raises(Exception, match="not a JSON list of objects"):
        extract.extract(spark.createDataFrame([("c", "t")], "chunk_id string, text string"), lambda: lambda texts: [answer] * len(texts), fail_fast=True).collect()


def test_answers_of_extractors_are_parsed_as_those_of_columns(spark):
    rows = spark.createDataFrame([(f"c{i}", a) for i, a in enumerate(ANSWERS)], "chunk_id string, answer string")
    given = dict(enumerate(ANSWERS))
    chunks = spark.createDataFrame([(f"c{i}", str(i)) for i in given], "chunk_id string, text string")
    found = extract.extract(chunks, lambda: lambda texts: [given[int(t)] for t in texts])
    assert sorted(map(str, found.collect())) == sorted(map(str, extract.parse_rows(rows, "answer", extract.RELATION).collect()))


def test_pairs_are_judged(spark):
    pairs = spark.createDataFrame([("a", "b", "x", 1), ("c", "d", None, 2)], "entity_1 string, entity_2 string, text string, related int")

    def judge():
        return lambda texts: ['{"Relationship": "is", "Related": "Yes"}' if "'a'" in t else "no" for t in texts]

    assert {tuple(r) for r in extract.judged_pairs(pairs, judge).collect()} == {("a", "b", "x", "is", True), ("c", "d", None, None, None)}


def test_offline_named_entities(spark):
    chunks = spark.createDataFrame([("c", "In New York Ann met bob")], "chunk_id string, text string")
    assert {tuple(r) for r in extract.entities_of_text(chunks, lambda: extract.CapitalisedEntities()).collect()} == {("In New York Ann", "MISC", "c")}


def test_extractors(spark):
    chunks = spark.createDataFrame([("c1", "Alpha beta, gamma"), ("c2", None)], "chunk_id string, text string")
    found = clean.clean_relations(extract.extract(chunks, lambda: extract.RegexRelations(), tasks=2))
    assert {(r["source"], r["target"], r["chunk_id"]) for r in found.collect()} == {("alpha", "beta", "c1"), ("beta", "gamma", "c1")}

    def names():
        return lambda texts: [json.dumps([{"name": "n", "entity": t.split()[0]}] if t else []) for t in texts]

    assert {tuple(r) for r in extract.entities_of_text(chunks, names).collect()} == {("n", "Alpha", "c1")}
    rows = spark.createDataFrame([("Big thing", "place", "c")], "entity string, category string, chunk_id string")
    assert {tuple(r) for r in extract.entities_of_concepts(rows, names).collect()} == {("n", "Big", "c", "entity")}

    def ideas():
        return lambda texts: ['[{"entity": "E", "importance": "high", "category": "misc"}, {"entity": "F", "importance": 3}]' for _ in texts]

    assert {tuple(r) for r in extract.concepts(chunks.where("text is not null"), ideas).collect()} == {("E", None, "misc", "c1", "concept"), ("F", 3, None, "c1", "concept")}
    docs = spark.createDataFrame([(1, "s", "Alpha beta")], "doc_id long, source string, text string")
    assert flows.entity_counts(docs, names).first()["count"] == 1


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('a "quoted" | text\nof two lines', "s", "c1"), ("é", None, "c2"), (" spaces at both ends\n ", "s", "c3")], CHUNKS_CSV)
    files.write_table(rows, str(tmp_path / "made" / "chunks"))
    assert sorted(map(str, files.read_chunks(spark, str(tmp_path / "made" / "chunks")).collect())) == sorted(map(str, rows.collect()))
    concepts = files.rows_to_table(spark, [{"entity": "e", "importance": 2, "other": 1}], CONCEPTS)
    files.write_table(concepts, str(tmp_path / "concepts"))
    assert tuple(files.read_concepts(spark, str(tmp_path / "concepts")).first()) == ("e", 2, None, None, None)
    old = spark.createDataFrame([("a", "b", "r", "c")], "node_1 string, node_2 string, edge string, chunk_id string")
    files.write_table(old, str(tmp_path / "old"))
    assert files.read_relations(spark, str(tmp_path / "old")).columns == old.columns


def test_cache(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(len(made))

    path = str(tmp_path / "cache")
    assert [files.cached(spark, path, compute, again).count() for again in (False, False, True)] == [1, 1, 2]
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert files.cached(spark, path, compute).count() == 3


def test_binary_documents(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one\x0ctwo")
    found = files.binary_documents(spark, str(tmp_path), lambda b: b.decode().split("\x0c"))
    assert sorted((r["page"], r["text"]) for r in found.collect()) == [(0, "one"), (1, "two")]


def test_text_to_graph_and_page(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("tiger hunts rabbit eats grass tiger hunts rabbit </script>")
    (tmp_path / "in" / "b.txt").write_text("rabbit eats carrot")
    page = tmp_path / "out" / "page.html"
    make = lambda: flows.text_to_graph(spark, str(tmp_path / "in"), lambda: extract.RegexRelations(), str(tmp_path / "cache"), page=str(page))
    graph = make()
    text = page.read_text()
    assert graph.nodes.count() == 7 and '"from": "tiger"' in text and text.count("</script>") == 1
    assert sorted(map(str, make().merged.collect())) == sorted(map(str, graph.merged.collect()))
    with pytest.raises(ValueError, match="at most"):
        html.page(graph.nodes, graph.edges, most=2)


def test_undirected_and_concept_flows(spark):
    rows = spark.createDataFrame([("a", "b", "r", "c1", 1), ("b", "c", "r", "c1", 2), ("d", "e", "r", "c2", 3)], "source string, target string, relationship string, chunk_id string, ord long").withColumn("description", F.lit(""))
    graph = flows.undirected_graph(rows)
    assert {(r["id"], r["size"]) for r in graph.nodes.collect()} == {("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1)} or graph.nodes.count() == 5
    ideas = spark.createDataFrame([("A", 3, "c"), ("b", 1, "c"), ("c", 4, "c")], "entity string, importance int, chunk_id string")
    found = {r["id"]: r["size"] for r in flows.concept_graph(ideas).nodes.collect()}
    assert found == {"a": 18.0, "c": 24.0, "b": None}


class Server(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, *lines, status=200):
        self.send_response(status)
        self.end_headers()
        for x in lines:
            self.wfile.write(json.dumps(x).encode() + b"\n")

    def do_HEAD(self):  # noqa: N802
        self.answer()

    def do_GET(self):  # noqa: N802
        self.answer({"models": [{"name": "m"}]})

    def do_DELETE(self):  # noqa: N802
        self.answer(status=404)

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/api/generate":
            assert "template" not in body
            self.answer({"response": "[]"}, {"response": " "}, {"done": True, "response": "x", "context": [1]})
        elif self.path == "/api/show":
            self.answer({"name": body["name"]})
        elif self.path == "/api/copy":
            self.answer()
        else:
            self.answer({"status": "begun"}, {"status": "done"})


def test_model_server():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client, seen = Client(f"http://127.0.0.1:{server.server_port}"), []
    assert client.generate("m", "p") == ("[] ", [1])
    assert client.generate("m", "p", callback=seen.append) == ("", [1]) and len(seen) == 3
    assert client.models() == [{"name": "m"}] and client.show("m") == {"name": "m"} and client.alive()
    assert client.copy("a", "b") and not client.delete("a")
    assert [x["status"] for x in client.pull("m")] == ["begun", "done"] == [x["status"] for x in client.push("m")] == [x["status"] for x in client.create("m", "f")]
    server.shutdown()
    server.server_close()
    dead = Client("http://127.0.0.1:9", timeout=2)
    assert dead.generate("m", "p") == (None, None) and dead.models() is None and not dead.alive()


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from weftgraph.operators.proximity import mentions, pairs

    schema = "chunk_id string, source string, target string"
    rows = [(f"c{i % 4}", f"n{i % 3}", f"n{(i * 5) % 7}") for i in range(40)]
    for k in range(2):
        spark.createDataFrame([r for r in rows if int(r[0][1]) % 2 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = pairs(mentions(spark.createDataFrame(rows, schema)), chunks=False).where("count > 1")
    assert sorted(map(tuple, stream.totals(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_entry_and_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
