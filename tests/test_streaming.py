"""Streamed pair counts equal those of all rows at once, however the rows are cut into batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.proximity import mentions, pairs
from weftgraph.streaming import proximity as stream

SCHEMA = "chunk_id string, source string, target string, key long"


@pytest.fixture
def rows():
    r = random.Random(8)
    return [(f"c{r.randrange(6)}", f"n{r.randrange(5)}", f"n{r.randrange(9)}", k) for k in range(90)]


def right(rows):
    out = Counter()
    for c in {x[0] for x in rows if x[0] is not None}:
        m = Counter(n for x in rows if x[0] == c for n in x[1:3] if n is not None)
        out.update({(a, b): m[a] * m[b] for a in m for b in m if a < b})
    return sorted((a, b, n) for (a, b), n in out.items() if n > 1)


def found(spark, table):
    return sorted(map(tuple, stream.totals(spark, str(table)).collect()))


def test_brute_force_equals_the_batch_operator(spark, rows):
    assert sorted(map(tuple, pairs(mentions(spark.createDataFrame(rows, SCHEMA)), chunks=False).where("count > 1").collect())) == right(rows)


def test_chunks_in_pieces_a_batch_delivered_again_and_a_batch_run_again(spark, rows, tmp_path):
    into = tmp_path / "in"
    into.mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(into))
    for part in (0, 1, 2, 0):  # every chunk comes in three batches, and the first batch twice
        spark.createDataFrame([x for x in rows if x[3] % 3 == part], SCHEMA).coalesce(1).write.mode("append").parquet(str(into))
        stream.start(source, str(tmp_path / "out"), str(tmp_path / "checkpoint"), key="key").awaitTermination()
    assert found(spark, tmp_path / "out") == right(rows)
    batches = spark.read.parquet(str(tmp_path / "out" / "pairs")).select("batch").distinct().count()
    assert batches == 3  # the fourth added nothing
    stream.add_batch(spark.createDataFrame([x for x in rows if x[3] % 3 == 2], SCHEMA), str(tmp_path / "out"), 2, "key")  # as after a failure
    assert found(spark, tmp_path / "out") == right(rows)


def test_batches_without_keys_and_odd_rows(spark, rows, tmp_path):
    odd = [(None, "n1", "n2", 1), ("c1", None, "n2", 2), ("c1", None, None, 3), ("c9", "x", "x", 4), ("c9", "x", "x", 4), ("c9", "y", "x", None), ("c9", "y", "x", None)]
    every = rows + odd
    for number in range(4):
        stream.add_batch(spark.createDataFrame([x for i, x in enumerate(every) if i % 4 == number], SCHEMA), str(tmp_path), number)
    stream.add_batch(spark.createDataFrame([], SCHEMA), str(tmp_path), 4)
    assert found(spark, tmp_path) == right(every)


def test_rows_without_a_key_all_count(spark, tmp_path):
    rows = [("c", "a", "b", None), ("c", "a", "b", None), ("c", "a", "b", 1), ("c", "a", "b", 1)]
    for number in (0, 1):
        stream.add_batch(spark.createDataFrame(rows, SCHEMA), str(tmp_path), number, "key")
    assert found(spark, tmp_path) == [("a", "b", 25)]


def test_old_pairs_are_not_made_again(spark):
    old = spark.createDataFrame([("c", f"n{i:02}", 1) for i in range(30)], "chunk_id string, node string, m long")
    new = spark.createDataFrame([("c", "n05", 2), ("c", "zz", 1)], "chunk_id string, node string, m long")
    counts = {(r["node_1"], r["node_2"]): r["count"] for r in stream.delta_pairs(old, new).collect()}
    assert len(counts) == 29 + 30 and counts["n04", "n05"] == 2 and counts["n05", "zz"] == 3 and ("n01", "n02") not in counts


def test_a_compacted_table_goes_on(spark, rows, tmp_path):
    batch = lambda n: spark.createDataFrame([x for x in rows if x[3] % 3 == n], SCHEMA)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for number in (0, 1):
        stream.add_batch(batch(number), old, number, "key")
    stream.compact(spark, old, new, 1)
    assert found(spark, old) == found(spark, new)
    assert spark.read.parquet(new + "/mentions").groupBy("chunk_id", "node").count().where(F.col("count") > 1).isEmpty()
    stream.add_batch(batch(2), new, 2, "key")
    stream.add_batch(batch(0), new, 3, "key")
    assert found(spark, new) == right(rows)


def test_large_chunks_frequent_chunks_and_frequent_nodes(spark, rows, tmp_path, monkeypatch):
    """The ways of chunks and nodes that are too large for one list, one partition or a broadcast give the same counts."""
    odd = [("c1", "a\nb", "", 901), ("c2", "a\nb", "", 902), ("c2", "a\nb", "", 903), ("c3", "", "x", 904)]
    for name, value in (("SMALL", 4), ("HOT", 9), ("FEW", 0), ("LANE", 2), ("BUCKETS", 4)):
        monkeypatch.setattr(stream, name, value, raising=False)
    for number in range(3):
        stream.add_batch(spark.createDataFrame([x for i, x in enumerate(rows + odd) if i % 3 == number], SCHEMA), str(tmp_path / "out"), number, "key")
    assert found(spark, tmp_path / "out") == right(rows + odd)
    stream.compact(spark, str(tmp_path / "out"), str(tmp_path / "into"), 2)
    assert found(spark, tmp_path / "into") == right(rows + odd)


def test_pairs_are_shuffled_once_and_in_lists(spark, tmp_path):
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    r = random.Random(4)
    lines = [(f"c{k // 9}", f"s{r.randrange(10**6)}", f"p{r.randrange(10**6)}", k) for k in range(18_000)]
    pairs, before = 2000 * 18 * 17 // 2, shuffled()
    for number in range(2):
        stream.add_batch(spark.createDataFrame([x for x in lines if x[3] % 2 == number], SCHEMA), str(tmp_path), number, "key")
    stream.totals(spark, str(tmp_path), least=1).write.format("noop").mode("overwrite").save()
    assert shuffled() - before < 24 * pairs
