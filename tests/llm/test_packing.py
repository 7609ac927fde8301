import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import packing
from weftgraph.llm.queries import tokenizer

WORD_BPE = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


ODD = ["", "  ", "It's don't <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é é İstanbul ẞ straße", "1234 56,78 9.9... a.,b", "\x1c a\x1db\u0085c", "tab\ttab\r\nnew", "日本語 テキスト。", "z" * 3000 + " b", "ª º Œuvre Œ. x.. y,, z.,"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcAZé. ,'\n\t́ <|endoftext|>İ1", max_size=60), min_size=1, max_size=5))
def test_stretches_give_the_library_s_ids(texts):
    encoder = packing.stretch_encoder(WORD_BPE)
    want = encoder.tokenizer.encode_batch([*texts, *ODD], add_special_tokens=False)
    assert encoder.encode([*texts, *ODD]) == [np.array(e.ids, "<u4").tobytes() for e in want]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plans_place_every_rank_once_without_gaps(histogram):
    held, seen = {}, dict.fromkeys(histogram, 0)
    for length, first, end, sequence, offset, times in packing.plan(histogram, 64):
        assert first == seen[length]
        seen[length] = end
        for rank in range(first, end):
            held.setdefault(sequence + (rank - first) // times, []).append((offset + (rank - first) % times * length, length))
    assert seen == histogram
    for parts in held.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0, *[b for _, b in parts]])[:-1]) and sum(b for _, b in parts) <= 64
    total = sum(a * b for a, b in histogram.items())
    assert -(-total // 64) <= len(held) <= 2 * total / 64 + 1


def test_patterns_and_least_squares():
    assert sorted(packing.patterns(4, 3)) == [(2, 1, 1), (2, 2), (3, 1), (4,)]
    a = np.array([[1.0, 1, 0], [0, 1, 1], [1, 0, 1]])
    assert np.allclose(packing.nnls(a, np.array([3.0, 2, 1])), np.linalg.solve(a, [3, 2, 1]))
    x = packing.nnls(np.array([[1.0, 1], [1, 1.1]]), np.array([1.0, -1]))
    assert (x >= 0).all()


def check(rows, texts, library, capacity):
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    by = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + capacity]
        assert r["start"] == r["piece"] * capacity and r["length"] == len(part)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted((r["doc_id"], r["piece"]) for r in rows) == sorted((i, k) for i, x in ids.items() for k in range(-(-len(x) // capacity)))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0, *[b for _, b in parts]])[:-1]) and sum(b for _, b in parts) <= capacity
    return len(by), sum(map(len, ids.values()))


def test_packed_documents_against_the_library(spark, library):
    r = np.random.default_rng(1)
    texts = [(i, " ".join(f"word{r.integers(50)}" for _ in range(int(r.integers(0, 80))))) for i in range(200)] + [(500, None), (501, "x " * 2000), *[(600 + k, x) for k, x in enumerate(ODD)]]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"length": F.lit(3), "rank": F.lit("x"), "block": F.lit(0)})
    sequences, total = check(packing.pack(frame, WORD_BPE, 128).collect(), texts, library, 128)
    assert sequences <= 1.02 * total / 128 + 1


def test_repeated_rows_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(frame, WORD_BPE, 16).collect()
    assert sorted((r["length"], r["offset"]) for r in rows) == [(2, 6), (3, 0), (3, 3)] or sum(r["length"] for r in rows) == 8
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack(frame.limit(0), WORD_BPE, 16).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinrstAZéÜßÿ", min_size=1, max_size=25), min_size=1, max_size=40))
def test_merged_words_have_the_library_s_ids(words):
    encoder = packing.stretch_encoder(WORD_BPE)
    words = [w + ("", ".", ",")[k % 3] for k, w in enumerate(words)] + ["aaaaaaa", "b" * 64]
    assert encoder.merges is not None
    want = encoder.tokenizer.encode_batch(words, add_special_tokens=False)
    assert encoder.encode_words(words) == {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, want, strict=True)}


def test_other_tokenizers_go_to_the_library():
    encoder = packing.StretchEncoder(tokenizer("byte_bpe_50k.json"))
    assert encoder.merges is None and encoder.encode_new(["abc"]) == {"abc": np.array(encoder.tokenizer.encode("abc", add_special_tokens=False).ids, "<u4").tobytes()}


def test_rows_alike_are_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)
    rows = packing.pack(spark.createDataFrame([(None, "a b")] * 100 + [(1, "c")] * 30, "doc_id long, text string").repartition(3), WORD_BPE, 16).collect()
    assert len(rows) == 130 == len({(r["sequence_id"], r["offset"]) for r in rows}) and len({r["sequence_id"] for r in rows}) <= 24
