"""The trie against a trie of dictionaries, against SQL, and odd rows."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from weftgraph.llm import prefix_trie, queries

D = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def sequences_of(rows):
    """Rebuilt sequences of (role, text), read off the definition."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(rows):
    sequences = sequences_of(rows)
    members = {}
    for c, own in sequences.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    below = {p: [x for x in members if x[: len(p)] == p] for p in members}
    out = []
    for p, who in members.items():
        kids = [x for x in below[p] if len(x) == len(p) + 1]
        leaves = [x for x in below[p] if not any(len(y) > len(x) for y in below[x])]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[p] if x)
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, prefix_trie.conversation_trie(frame).collect()), key=str)


def test_the_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    right = sorted(connection.execute(prefix_trie.SQL).fetchall(), key=str)
    rows = [tuple(r) for r in queries.table(spark, D, "conversations").collect()]
    assert sorted(map(tuple, queries.op13_conversation_prefix_trie(spark, D).collect()), key=str) == right == brute(rows)


def test_shared_prefixes_long_conversations_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    r = random.Random(4)
    rows = []
    for c in range(60):
        length = 37 if c == 40 else r.randint(1, 12)
        rows += [(c, t, r.choice(["user", "assistant"]) if t > 4 else "user", r.choice(["a", "bé", "ccc"]) if t > 3 else "hello") for t in range(length)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_turns_of_one_conversation_in_many_partitions(spark):
    rows = [(5, t, "user", str(t * 7 % 5)) for t in range(300)] + [(7, t, "user", "0") for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(13)
    placed = {(r["conv_id"], r["i"]) for r in prefix_trie.turns_in_order(frame).collect()}
    assert placed == {(5, i) for i in range(300)} | {(7, i) for i in range(3)}
    assert found(frame) == brute(rows)


def test_dense_names(spark):
    names = prefix_trie.dense_names(spark.range(1000).select((F.col("id") % 77).alias("a"), (F.col("id") % 2).alias("b")).repartition(9)).collect()
    assert sorted(r["name"] for r in names) == list(range(154)) and len({(r["a"], r["b"]) for r in names}) == 154


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, None, "b", None), (2, 3, "u", "x" * 200_000), (2, 3, "u", "x" * 200_000), (None, 0, "u", "y"), (-3, 0, "u", "z"), (-5, 0, "u", "z"), (-7, 1, "u", "z")]
    rows += [(c, t, None, "same") for c in (10, 11, 12, 13, 14) for t in range(2)] + [(2**62, 0, "u", "far"), (0, 5, "u", "tie b"), (0, 5, "u", "tie a"), (0, 5, "a", "tie c"), (21, 0, "u", "a"), (22, 0, "ua", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    right = brute(rows)
    assert found(frame) == right
    assert found(frame.selectExpr("*", "1 AS depth", "2 AS least", "3 AS name", "4 AS i", "5 AS p", "6 AS at")) == right
    assert found(frame.limit(0)) == []
