"""Near-dedup against brute force over full shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import near_dedup
from weftgraph.llm import textkernels as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, groups=12, size=6, words=60, noise=(0, 1, 2, 3)):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.choice(noise)):
                own[r.randrange(words)] = word()
            rows.append(" ".join(own))
    r.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame, **options).collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [3, 12])
def test_large_nodes_are_led_split_and_blocked_without_loss(spark, limit):
    rows = corpus(2, groups=5, size=25, noise=(0, 1, 2, 3, 4))
    assert found(spark, rows, node_limit=limit, depth=2) == brute(rows)


def test_a_passage_in_many_documents_joins_none(spark):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{r.random()}" for _ in range(40))) for i in range(60)]
    assert {x[1] for x in found(spark, rows, node_limit=10, depth=3).values()} == set(range(60))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "b a"), (7, long), (8, long + " end"), (9, "x" * 200_000), (10, "x" * 200_000)]
    assert found(spark, rows) == brute(rows)
    frame = spark.createDataFrame([*rows, (None, "a b"), (4, "A b")], "doc_id long, text string").withColumns({"h1": F.lit(1), "node": F.lit("x")})
    out = near_dedup.near_duplicates(frame).collect()
    assert len(out) == 12
    assert [tuple(r) for r in out if r["doc_id"] is None] == [(None, 1, None, True)]
    assert [tuple(r) for r in out if r["doc_id"] == 4] == [(4, 1, 4, True)] * 2


def test_empty_table(spark):
    assert found(spark, [(1, "a")][:0]) == {}


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = " ".join(map(str, range(20))), " ".join(map(str, range(100, 120)))
    rows = [(1, a), (1, b), (2, a), (3, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == {1}


def test_node_links_join_as_exhaustive_comparison_does():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, 180, replace=False), r.integers(0, 1 << 62, 10, dtype=np.uint64)])) for _ in range(30)]
    links = near_dedup.node_links(list(range(30)), sets, 75)
    want = set()
    for i in range(30):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    assert all(tuple(sorted(x, reverse=True)) in want for x in links)

    def parts(pairs):
        head = list(range(30))
        for a, b in pairs:
            x, y = head[a], head[b]
            head = [x if h == y else h for h in head]
        return [head.index(h) for h in head]

    assert parts(links) == parts(want)


def test_intersections_are_exact():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 40 if i % 2 else 5000, int(r.integers(1, 300)), dtype=np.uint64)) for i in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    got = near_dedup.intersections(sets)
    np.fill_diagonal(got, 0)
    assert (got == want).all()


def test_members_joined_already_are_linked_with_others_only():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 3)]
    assert {x[1] for x in near_dedup.node_links([5, 6, 7, 8], sets, 75, [1, 1, 0, 0])} == {7, 8}
    assert near_dedup.node_links([5, 6], sets[:2], 75, [1, 1]) == [] and near_dedup.node_links([5, 6], sets[:2], 75, [1, 0]) == [(5, 6)]


def test_word_hashes_tell_words_apart():
    data, at = tk.flat(__import__("pyarrow").array(["The cat", "the CAT sat", "", None, "é"]))
    starts, ends, first = tk.words(data, at, tk.word_table(near_dedup.SEPARATORS))
    h = tk.word_hashes(data, starts, ends).tolist()
    assert h[0] == h[2] and h[1] == h[3] and len(set(h)) == 4 and first.tolist() == [0, 2, 5, 5, 5, 6]


def test_repeated_rows_are_one_member(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "other ")
    rows = [(5, text)] * 20_000 + [(9, near)] + [(5, "another text of the same id, with words enough for shingles of its own")] * 3
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    counted = {(r["doc_id"], r["n_shingles"], r["component_id"]): r["count"] for r in out.groupBy("doc_id", "n_shingles", "component_id").count().collect()}
    assert counted == {(5, 56, 5): 20_000, (9, 56, 5): 1, (5, 10, 5): 3}


def test_the_comparer_skips_repeated_members(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(near_dedup, "node_links", lambda ids, sets, percent, sides=None: seen.append(list(ids)) or [])
    own, other = np.arange(3, dtype=np.uint64).tobytes(), np.arange(4, dtype=np.uint64).tobytes()
    rows = [(1, 5, 0, own)] * 4 + [(1, 5, 0, other), (1, 6, 0, own), (2, 6, 0, own)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], ["node", "rep", "side", "set"]) for part in (rows[:2], rows[2:])]
    list(near_dedup._comparer(75)(iter(batches)))
    assert [x for x in seen if x] == [[5, 5, 6], [6]]
