"""Token counts from per-document pre-token frequencies.

A pre-token here is a stretch of text that begins where a space follows a non-space: the library's
own splitting never crosses such a place, so a text's count is the sum over its pre-tokens, special
strings included. Pieces are counted by the library once for each distinct pre-token; the counts are
joined to per-document frequencies and summed. No ids are kept or shipped.

The commonest pre-tokens would be hot keys of that join. So the ``head`` commonest of a sample
of documents (its size is ``sample`` rows or so, whatever the input's) are counted first, as many as fit into ``HEAD_BYTES``,
and this bounded table goes to every task; the sums over them need no join. All other pre-tokens, at most one row
for each document and pre-token, are dealt to tasks by pre-token and sorted, which brings a pre-token's
rows together: it is counted there, once, and its count multiplies their frequencies. Spark splits a task that gets much more than the
others, as by a long pre-token that very many documents hold, which is then counted once in each part. The sample decides
where a pre-token is looked up, never its count.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows that repeat are counted each;
a null doc_id is a value like any other. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import cut, drop

_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")
#: Bytes of all pre-tokens of the head; and of one, so that the commonest fit.
HEAD_BYTES, HEAD_LENGTH = 8 << 20, 4096
#: Size that marks a row as that of a pre-token.
_REST = -1
_TOKENIZERS: dict[str, object] = {}
_HEADS: dict[int, dict[str, int]] = {}


def pre_tokens(text: str) -> Counter:
    """Frequencies of a text's pre-tokens."""
    if _ODD.search(text):
        return Counter(_CUT.split(text))
    first, *rest = text.split(" ")
    counts = Counter([" " + x for x in rest])
    if first:
        counts[first] += 1
    return counts


def count_pieces(path: str, strings: list[str]) -> list[int]:
    """Pieces of each string, as the library encodes it alone."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            _TOKENIZERS[path] = Tokenizer.from_file(path)
        else:
            import sentencepiece

            _TOKENIZERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    made = _TOKENIZERS[path]
    if path.endswith(".json"):
        return [len(x.ids) for x in made.encode_batch_fast(strings, add_special_tokens=False)]
    return [len(x) for x in made.encode(strings, num_threads=1)]


def _head(documents: DataFrame, path: str, head: int, sample: int) -> dict[str, int]:
    share = min(1.0, sample / max(1, documents.count()))
    chosen = documents if share == 1 else documents.sample(share, seed=1)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text in batch.column(0).to_pylist():
                total.update({k: n for k, n in pre_tokens(text or "").items() if len(k) <= HEAD_LENGTH})
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["unit", "n"])

    counted = chosen.select("text").mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = cut(counted, "units")
    # Places among the commonest are found without the texts: a pre-token is known by its hash until it is sure to fit.
    ranked = counted.select(F.xxhash64("unit").alias("h"), "n", F.octet_length("unit").alias("size")).orderBy(F.desc("n"), "h").limit(head)
    fits, held = set(), 0
    for r in ranked.collect():
        held += r["size"]
        if held > HEAD_BYTES:
            break
        fits.add(r["h"])
    least = counted.sparkSession.createDataFrame([(h,) for h in fits], "h long")
    top = counted.withColumn("h", F.xxhash64("unit")).join(F.broadcast(least), "h").select("unit").toArrow().column(0).to_pylist()
    drop(counted)
    return dict(zip(top, count_pieces(path, top), strict=True)) if top else {}


def _head_of(broadcast, number: int) -> dict[str, int]:
    """This worker's copy of a broadcast head."""
    if number not in _HEADS:
        _HEADS.clear()
        _HEADS[number] = broadcast.value
    return _HEADS[number]


def _splitter(broadcast, number: int):
    """A row for each document, with what the head knows, summed; and one for each other pre-token of it, with its frequency.

    The rows of documents have one of 500 units, by their place, so that they are dealt to many tasks; it isn't theirs and isn't counted.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _head_of(broadcast, number).get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, units, numbers, sizes = [], [], [], []
                for d, text in enumerate(batch.column(2).to_pylist()):
                    total = 0
                    for unit, n in pre_tokens(text or "").items():
                        pieces = known(unit)
                        if pieces is None:
                            rows.append(d)
                            units.append(unit)
                            numbers.append(n)
                            sizes.append(_REST)
                        else:
                            total += pieces * n
                    rows.append(d)
                    units.append(str(d))
                    numbers.append(total)
                    sizes.append(len((text or "").encode()))
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(units, pa.string()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())],
                    ["doc_id", "check", "unit", "n", "n_bytes"],
                )

    return split


def _multiplier(path: str):
    """Frequencies times pieces, of rows sorted by pre-token. Rows of documents stay as they are."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, int] = {}
        for batch in batches:
            n, n_bytes = batch.column(3).to_numpy(), batch.column(4)
            at = np.flatnonzero(n_bytes.to_numpy() == _REST)
            coded = batch.column(2).take(pa.array(at)).dictionary_encode()
            names = coded.dictionary.to_pylist()
            new = [x for x in names if x not in last]
            found = last | dict(zip(new, count_pieces(path, new), strict=True))
            pieces = np.ones(len(n), np.int64)
            if names:
                pieces[at] = np.array([found[x] for x in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
                last = {names[-1]: found[names[-1]]}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n * pieces), n_bytes], ["doc_id", "check", "n", "n_bytes"])

    return multiply


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024, head: int = 150_000, sample: int = 20_000) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each row of ``documents``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast(_head(docs, tokenizer, head, sample))
    # Rows are told apart by doc_id and 64 bits of their text's hash: rows that are equal in both have equal counts and share a sum.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("check"), "text")
    rows = keyed.mapInArrow(_splitter(broadcast, int(broadcast._jbroadcast.id())), "doc_id long, check long, unit string, n long, n_bytes long")
    of_document = F.col("n_bytes") != _REST
    dealt = rows.hint("rebalance", "unit").sortWithinPartitions("unit")
    counted = dealt.mapInArrow(_multiplier(tokenizer), "doc_id long, check long, n long, n_bytes long")
    both = counted.groupBy("doc_id", "check").agg(F.sum("n").alias("n"), F.count_if(of_document).alias("rows"), F.max("n_bytes").alias("n_bytes"))
    tokens = F.expr("n div rows")
    return both.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row")).drop("_row")
