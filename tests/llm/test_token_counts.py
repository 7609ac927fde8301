import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import token_counts as tc
from weftgraph.llm.queries import tokenizer

BYTE_BPE = tokenizer("byte_bpe_50k.json")
ODD = ["", " ", "   a   b  ", "a \n b\n\n  c\t d", "x<|endoftext|> y<|endoftext|>z", "it's  'tis 'S", "\n \n", "é ü 日本  語", "a  b  c", "\x1c a\x1d b", "q" * 5000, "1 22 333  4444", "a \r\n  b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ' s\n\t1é <|endoftext|>.", max_size=60))
def test_pre_tokens_add_up(text):
    units = tc.pre_tokens(text)
    counts = dict(zip(units, tc.count_pieces(BYTE_BPE, list(units)), strict=True))
    assert sum(counts[u] * n for u, n in units.items()) == tc.count_pieces(BYTE_BPE, [text])[0]


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_counts_equal_the_library_s(spark, library, head):
    texts = ODD + [f"word{i} the the of {i * 7919} and and" * (i % 5) for i in range(80)]
    frame = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string").withColumns({"unit": F.lit(1), "check": F.lit("x")})
    found = {r["doc_id"]: tuple(r)[1:] for r in tc.token_counts(frame, BYTE_BPE, limit=20, head=head).collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)} | {900: 0}
    assert found == {i: (len((texts[i] if i < 900 else "").encode()), n, n > 20) for i, n in want.items()}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d e")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in tc.token_counts(frame, BYTE_BPE, head=0).collect()) == [("1", 1), ("1", 2), ("1", 2), ("None", 2)]
    assert tc.token_counts(frame.limit(0), BYTE_BPE).collect() == []


def test_a_long_pre_token_in_every_row_is_dealt_to_several_tasks(spark, library):
    texts = [f"{'-' * 200} of{i}" for i in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        found = {r["doc_id"]: r["n_tokens"] for r in tc.token_counts(frame, BYTE_BPE, head=0).collect()}
    finally:
        for k in small:
            spark.conf.unset(k)
    assert found == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_long_pre_tokens_come_into_the_head_as_far_as_they_fit(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "-" * 200 + " a a b")], "doc_id long, text string")
    assert set(tc._head(docs, BYTE_BPE, 10, 10)) == {"-" * 200, " a", " b"}
    monkeypatch.setattr(tc, "HEAD_BYTES", 4)
    assert " a" in tc._head(docs, BYTE_BPE, 10, 10) and "-" * 200 not in tc._head(docs, BYTE_BPE, 10, 10)
    assert tc._head(docs.limit(0), BYTE_BPE, 10, 10) == {}


def test_rows_without_id_whose_short_hashes_are_equal(spark, library):
    """The first two texts have the same 32-bit hash."""
    rows = [(None, "w189018 x x x x"), (None, "w227783 x x x"), (7, "w189018 x x x x"), (7, "w227783 x x x"), (7, "w227783 x x x"), (7, "17 499 0"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    right = [(d, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for d, x in rows]
    for head in (0, 1000):
        found = tc.token_counts(frame, BYTE_BPE, head=head).collect()
        assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in found) == sorted(map(str, right))


def test_rows_of_documents_are_dealt_to_many_units():
    import pyarrow as pa

    class Head:
        value: dict = {}

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(["a"] * 2000)], ["doc_id", "check", "text"])
    rows = pa.Table.from_batches(list(tc._splitter(Head, -1)(iter([batch])))).to_pandas()
    of_documents = rows[rows["n_bytes"] >= 0]["unit"].value_counts()
    assert len(of_documents) == 500 and of_documents.max() == 4
