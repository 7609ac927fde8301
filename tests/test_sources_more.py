"""The extraction cache, byte ranges of quoted files, and table functions."""

import io
import json
import os
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import tables
from weftgraph.operators import chunking, extract
from weftgraph.plans.queries import _documents
from weftgraph.sources import files, quoted_csv
from weftgraph.sources.extraction_cache import ExtractionCache

# -- extraction cache ---------------------------------------------------------------------------------


def asking(log):
    """A factory of extractors that write each text that they are asked for to a folder."""

    class Asked:
        def __call__(self, texts):
            for t in texts:
                with open(os.path.join(log, f"{os.getpid()}-{threading.get_ident()}"), "a") as f:
                    f.write(json.dumps(t) + "\n")
            return [json.dumps([{"source": w, "target": "t", "relationship": "r"} for w in t.split()]) if t != "bad" else "no list" for t in texts]

    return Asked


def asked(log):
    out = sorted(json.loads(line) for name in os.listdir(log) for line in open(os.path.join(log, name)))
    for name in os.listdir(log):
        os.remove(os.path.join(log, name))
    return out


def found(rows):
    return sorted((r["chunk_id"], r["source"]) for r in rows.collect())


def test_only_chunks_of_the_changed_file_are_asked_for(spark, tmp_path):
    corpus, log = tmp_path / "corpus", tmp_path / "log"
    corpus.mkdir()
    log.mkdir()
    for i in range(10):
        (corpus / f"{i}.txt").write_text(f"alpha{i} beta{i} " * 12)
    cache = ExtractionCache(spark, str(tmp_path / "cache"))
    chunks = lambda: chunking.fixed_chunks(files.text_documents(spark, str(corpus)), 60, 10)
    first = found(cache.extracted(chunks(), asking(str(log)), "v1"))
    texts = {r["text"] for r in chunks().collect()}
    assert asked(log) == sorted(texts) and cache.version() == 1
    assert found(cache.extracted(chunks(), asking(str(log)), "v1")) == first and asked(log) == [] and cache.version() == 1
    (corpus / "3.txt").write_text("gamma delta " * 12)
    again = found(cache.extracted(chunks(), asking(str(log)), "v1"))
    new = {r["text"] for r in chunks().collect()} - texts
    assert asked(log) == sorted(new) and new and cache.version() == 2
    assert {s for _, s in again} == {s for c in chunks().collect() for s in c["text"].split()}
    cache.extracted(chunks(), asking(str(log)), "v2").count()
    assert len(asked(log)) == len({r["text"] for r in chunks().collect()})


def test_equal_texts_bad_answers_and_odd_rows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    cache = ExtractionCache(spark, str(tmp_path / "cache"))
    rows = [("1", "a b"), ("2", "a b"), ("2", "a b"), ("3", "bad"), ("4", None), ("5", ""), (None, "c")]
    frame = spark.createDataFrame(rows, "chunk_id string, text string").withColumns({"key": F.lit("x"), "source": F.lit("y")})
    for _ in range(2):
        rows = cache.extracted(frame, asking(str(log)), "v").collect()
        assert sorted((str(r["chunk_id"]), r["source"]) for r in rows) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "a"), ("2", "b"), ("2", "b"), ("None", "c")]
    assert asked(log) == ["", "a b", "bad", "c"]
    assert cache.extracted(frame.limit(0), asking(str(log)), "v").isEmpty()


def test_a_writer_that_dies_changes_nothing_for_readers(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    cache = ExtractionCache(spark, str(tmp_path / "cache"))
    one, two = (spark.createDataFrame([(x, f"text {x}")], "chunk_id string, text string") for x in "ab")
    cache.extracted(one, asking(str(log)), "v").count()
    before = found(cache.rows().withColumnRenamed("key", "chunk_id"))
    with monkeypatch.context() as m:
        m.setattr(ExtractionCache, "_commit", lambda self, part: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cache.extracted(two, asking(str(log)), "v")
    assert cache.version() == 1 and found(cache.rows().withColumnRenamed("key", "chunk_id")) == before
    assert found(cache.extracted(two, asking(str(log)), "v")) == [("b", "b"), ("b", "text")]
    old = cache.parts()
    assert cache.vacuum(older_than=3600) == []
    assert len(cache.vacuum(older_than=0)) == 1 and cache.parts() == old and len(os.listdir(tmp_path / "cache" / "parts")) == 2
    assert found(cache.extracted(one, asking(str(log)), "v")) == [("a", "a"), ("a", "text")]


def test_two_writers_at_once_both_add_their_parts(spark, tmp_path):
    a, b = ExtractionCache(spark, str(tmp_path)), ExtractionCache(spark, str(tmp_path))
    late, versions = a.version, iter([0])
    a.version = lambda: next(versions, None) or late()  # sees the version before b's
    assert b._commit("of b") == 1
    assert a._commit("of a") == 2 and a.parts() == ["of b", "of a"] and a.parts(1) == ["of b"]


# -- quoted files -------------------------------------------------------------------------------------


def some_rows(n=60, seed=1):
    r = random.Random(seed)
    values = ["plain", "", None, 'a "quoted" word', "two\nlines", "a|b", '"', '""', "\n", '\n"|\n', "é ü\r\nx", "end\n", "x" * 40]
    return [(str(i), r.choice(values), r.choice(values)) for i in range(n)]


def written(rows):
    out = io.StringIO()
    for row in [("id", "a", "b"), *rows]:
        out.write("|".join("" if x is None else '"' + x.replace('"', '""') + '"' if x == "" or set(x) & set('"|\n\r') else x for x in row) + "\n")
    return out.getvalue().encode()


@pytest.mark.parametrize("end", [b"\n", b""])
def test_every_cut_gives_every_record_once(end):
    rows = some_rows(25)
    data = written(rows).removesuffix(b"\n") + end
    file = pa.BufferReader(data)
    for size in [*range(1, 90), 200, 10_000]:
        parts = [(a, min(a + size, len(data))) for a in range(0, len(data), size)]
        bodies = [quoted_csv._records(file, a, b, data[:a].count(b'"') % 2 == 1) for a, b in parts]
        assert b"".join(bodies) == data, size
        assert all(x.count(b'"') % 2 == 0 for x in bodies)


def test_values_survive(spark, tmp_path):
    rows = some_rows(200)
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_bytes(written(rows[part::3]))
    (tmp_path / "_SUCCESS").write_text("")
    whole = files.read_table(spark, str(tmp_path), spark.createDataFrame([], "id string, a string, b string").schema)
    for size in (37, 500, 1 << 20):
        read = quoted_csv.read_quoted(spark, str(tmp_path), split_bytes=size)
        assert sorted(map(str, read.collect())) == sorted(f"Row(id={i!r}, a={a!r}, b={b!r})" for i, a, b in rows)
        assert sorted(map(str, read.na.fill("").collect())) == sorted(map(str, whole.na.fill("").collect()))


def test_a_large_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    line = "|".join(["{i}", '"first\nsecond ""x""\nthird"', "c" * 200])
    (tmp_path / "f.csv").write_text("id|a|b\n" + "".join(line.replace("{i}", str(i)) + "\n" for i in range(20_000)))
    size = (tmp_path / "f.csv").stat().st_size
    read = quoted_csv.read_quoted(spark, str(tmp_path), ["id", "a"], split_bytes=size // 8 + 1)
    assert read.rdd.getNumPartitions() == 8
    counts = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 2 * 20_000 / 8
    assert read.agg(F.count_distinct("id"), F.count_distinct("a")).first() == (20_000, 1)


def test_columns_and_filters(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(written(some_rows(100)))
    read = quoted_csv.read_quoted(spark, str(tmp_path), ["b", "id", "none"], split_bytes=300)
    rows = {i: b for i, _, b in some_rows(100)}
    assert read.columns == ["b", "id", "none"] and {r["id"]: r["b"] for r in read.collect()} == rows and read.where("none is not null").isEmpty()
    for condition in ("b = 'plain'", "b is null or b = ''", "b in ('plain', 'a|b') and id > '5'"):
        assert {r["id"] for r in read.where(condition).collect()} == {r["id"] for r in spark.createDataFrame(list(rows.items()), "id string, b string").where(condition).collect()}
    some = quoted_csv.read_quoted(spark, str(tmp_path), ["id"], only={"b": ["plain", None], "a": ["a|b", "", "plain"]}, split_bytes=300)
    assert {r["id"] for r in some.collect()} == {i for i, a, b in some_rows(100) if b in ("plain", None) and a in ("a|b", "", "plain")} and some.columns == ["id"]


def test_records_of_other_lengths(tmp_path):
    table = quoted_csv.parse(b'1|a\n2|"x\ny"|z|more\n\n3||""\n', ["id", "a", "b"], ["b", "id"])
    assert table.to_pylist() == [{"b": None, "id": "1"}, {"b": "z", "id": "2"}, {"b": "", "id": "3"}]
    assert quoted_csv.parse(b"", ["id"], ["id", "x"]).to_pylist() == []


# -- table functions ----------------------------------------------------------------------------------


def test_chunks_equal_the_operator_s(spark):
    tables.register(spark)
    documents = _documents(spark, "/root/testdata/sf0.001")
    right = sorted(map(str, chunking.recursive_chunks(documents, 700, 70).collect()))
    assert sorted(map(str, spark.sql("SELECT * FROM chunks(TABLE({d}), 700, 70)", d=documents).collect())) == right
    odd = spark.createDataFrame([(None, "s", "text"), (1, None, None), (2, "s", "")], "doc_id long, source string, text string")
    assert sorted(map(str, spark.sql("SELECT * FROM chunks(TABLE({d}), 700, 70)", d=odd).collect())) == sorted(map(str, chunking.recursive_chunks(odd, 700, 70).collect()))
    for wrong in ("SELECT * FROM chunks(TABLE({d}), 70, 70)", "SELECT * FROM chunks(TABLE(SELECT doc_id FROM {d}), 700, 70)"):
        with pytest.raises(Exception, match="overlap is less|columns doc_id"):
            spark.sql(wrong, d=odd).collect()


def test_successive_rows_of_partitions(spark):
    tables.register(spark)
    rows = [(u, t, f"e{(u * 7 + t * t) % 5}" if t != 3 else None) for u in range(6) for t in range(u + 2)]
    frame = spark.createDataFrame(rows, "u int, t int, e string").repartition(5)
    out = spark.sql("SELECT * FROM successive(TABLE({f}) PARTITION BY u ORDER BY (t), 'u', 'e')", f=frame).collect()
    right = [(u, t + 1, e, next(x for v, s, x in rows if v == u and s == t + 1)) for u, t, e in rows if t + 1 < u + 2]
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, right))


def test_relations_equal_the_operator_s(spark):
    tables.register(spark)
    chunks = chunking.fixed_chunks(_documents(spark, "/root/testdata/sf0.001"))
    right = extract.extract(chunks, extract.RegexRelations).select("chunk_id", "source", "target", "relationship")
    assert sorted(map(tuple, spark.sql("SELECT * FROM relations(TABLE({c}), 4)", c=chunks).collect())) == sorted(map(tuple, right.collect()))


def test_short_ranges_share_tasks(monkeypatch):
    """Every range is in one group, in order; a group has ``TASK`` bytes at most, or a task's share if that is less."""
    found = [("f", i * 10, i * 10 + 10, False) for i in range(100)] + [("g", 0, 500, False)]
    monkeypatch.setattr(quoted_csv, "TASK", 50)
    groups = quoted_csv.grouped(found, 4)
    assert [x for g in groups for x in g] == found and len(groups) == 21
    assert len(quoted_csv.grouped(found[:100], 40)) == 50
    assert quoted_csv.grouped([], 4) == []


def odd():
    class Odd:
        """Rows with line breaks, with nulls, of one empty text, and none."""

        def __call__(self, texts):
            rows = {"plain": [("a", "b"), ("b", "c")], "breaks": [("a\nb", "c"), ("", "")], "nulls": [(None, "x"), ("y", None)], "empty": [("", "")]}
            return [json.dumps([{"source": a, "target": b} for a, b in rows.get(t, [])]) for t in texts]

    return Odd


def test_a_text_is_one_row_of_the_cache_and_odd_values_survive(spark, tmp_path):
    chunks = spark.createDataFrame([(x, x) for x in ("plain", "breaks", "nulls", "empty", "none")], "chunk_id string, text string")
    cache = ExtractionCache(spark, str(tmp_path))
    want = sorted([("plain", "a", "b"), ("plain", "b", "c"), ("breaks", "a\nb", "c"), ("breaks", "", ""), ("nulls", None, "x"), ("nulls", "y", None), ("empty", "", "")], key=str)
    for _ in range(2):
        rows = cache.extracted(chunks, odd(), "odd", fields=("source", "target"))
        assert rows.columns == ["chunk_id", "source", "target"] and sorted(map(tuple, rows.collect()), key=str) == want
    (part,) = cache.parts()
    assert spark.read.parquet(f"{tmp_path}/parts/{part}/lists").count() == 5 == cache.keys().count() and cache.rows().count() == 7
    assert os.listdir(tmp_path / "parts") == [part]


def test_parts_with_tables_of_keys_and_rows_are_read(spark, tmp_path):
    cache, log = ExtractionCache(spark, str(tmp_path / "cache")), tmp_path / "log"
    log.mkdir()
    frame = spark.createDataFrame([("1", "a b"), ("2", "none"), ("3", "new")], "chunk_id string, text string")
    keyed = frame.where("chunk_id < 3").select("chunk_id", F.sha2(F.concat(F.lit("v\x01"), "text"), 256).alias("key"))
    keyed.select("key").write.parquet(str(tmp_path / "cache/parts/old/keys"))
    old = keyed.where("chunk_id = 1").select("key", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source"), *[F.lit("t").alias(x) for x in ("target", "relationship", "weight", "description")])
    old.write.parquet(str(tmp_path / "cache/parts/old/rows"))
    cache._commit("old")
    assert found(cache.extracted(frame, asking(str(log)), "v")) == [("1", "a"), ("1", "b"), ("3", "new")] and asked(log) == ["new"]
