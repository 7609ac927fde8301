"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item (an item with
fewer words, but some, is one shorter window). Patterns of one length m are searched together:
a table gives for each block of two words how far the search may move on, as no pattern can end
sooner; a block of shift 0 ends some pattern, and its bucket holds the patterns with that suffix,
which are compared word by word. A block that no pattern holds moves the search by m - 1 words,
so most words of a document are never looked up.

The benchmark is read in blocks of about ``block_bytes`` of text (one item at least). Each block is broadcast, searched in a
pass over the texts of its own, and given up: neither the driver nor a worker ever holds the tables of two blocks, so memory
doesn't grow with the benchmark, and time grows with it by passes. Of a pass only the texts that were hit leave a row, keyed
by hashes of the text, and these rows are joined back at the end. With one block there is one pass and no join.

Defined results: a null text has no words; an item that is null or has no words has no windows;
an item with a null id marks words but is named in no list; an item id with several texts is one
item with the windows of all of them; rows that repeat, or lack an id, get a result each. Other columns are carried along
whatever their names; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.names import free
from weftgraph.storage import cut

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_RESULT = "struct<n_words:long, spans:array<struct<first:int, last:int>>, items:array<string>>"
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
#: Tables of the one block that this worker searches for now.
_TABLES: dict[int, list["WuManber"]] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, a-z and non-ASCII characters, A-Z lower-cased."""
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m = m = len(next(iter(patterns)))
        self.block = block = min(2, m)
        self.far = m - block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(block, m + 1):
                key = pattern[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket[pattern[m - block :]].append((pattern[0], list(pattern), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of each occurrence, from left to right."""
        m, far, shift, bucket, n = self.m, self.far, self.shift.get, self.bucket, len(words)
        at = m - 1
        while at < n:
            key = (words[at - 1], words[at]) if self.block == 2 else (words[at],)
            step = shift(key, far)
            if step:
                at += step
                continue
            begin = at - m + 1
            first = words[begin]
            for head, pattern, items in bucket[key]:
                if head == first and words[begin : at + 1] == pattern:
                    yield begin, items
            at += 1


def searchers(items: list[tuple[str | None, bytes | None]], window: int) -> list[WuManber]:
    """One searcher for each length of pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])].update([] if item is None else [item])
    return [WuManber(p) for p in by_length.values()]


def find(text: bytes | None, tables: list[WuManber]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, hit spans (first and last word, merged) and the items found."""
    words = words_of(text)
    hits, items = [], set()
    for table in tables:
        for begin, found in table.search(words):
            hits.append((begin, begin + table.m - 1))
            items |= found
    spans: list[tuple[int, int]] = []
    for first, last in sorted(hits):
        if spans and first <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
        else:
            spans.append((first, last))
    return len(words), spans, sorted(items)


def _tables(broadcast, number: int, window: int) -> list[WuManber]:
    """``number`` tells broadcasts apart: a worker builds the tables of one once, and forgets those of the one before."""
    if number not in _TABLES:
        _TABLES.clear()
        _TABLES[number] = searchers(broadcast.value, window)
    return _TABLES[number]


def _finder(broadcast, number: int, window: int):

    @F.arrow_udf(_RESULT)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _tables(broadcast, number, window)
        for column in columns:
            rows = [find(x, tables) for x in column.cast(pa.binary()).to_pylist()]
            yield pa.array([{"n_words": n, "spans": [{"first": a, "last": b} for a, b in spans], "items": items} for n, spans, items in rows], _ARROW)

    return search


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit``, ``spans`` (hit word ranges) and ``items`` (ids found, sorted as strings)."""
    spark = documents.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def found(table: DataFrame, b: int, name: str) -> tuple[DataFrame, object]:
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        broadcast = spark.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in rows])
        return table.withColumn(name, _finder(broadcast, int(broadcast._jbroadcast.id()), window)(F.col("text").cast("string"))), broadcast

    text = F.col("text").cast("string")
    key = [F.xxhash64(text), F.hash(text), F.octet_length(text)]
    passes = None
    for b in range(1, blocks):
        hit, broadcast = found(documents.select("text"), b, "f")
        hit = cut(hit.where(F.size("f.spans") > 0).select(*[k.alias(n) for k, n in zip(key, "abc", strict=True)], "f.spans", "f.items").distinct(), "hits")
        broadcast.destroy()
        passes = hit if passes is None else passes.unionByName(hit)
    out = documents.drop("n_words", "n_hit", "spans", "items")
    first, a, b, c, more = free([*out.columns, "n_words", "n_hit", "spans", "items"], "found", "a", "b", "c", "more")
    out, _ = found(out, 0, first)
    spans, items = F.col(f"{first}.spans"), F.col(f"{first}.items")
    if passes is not None:
        rest = passes.groupBy("a", "b", "c").agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")).alias(more))
        rest = rest.withColumnsRenamed({"a": a, "b": b, "c": c})
        out = out.join(rest, (key[0] == F.col(a)) & (key[1] == F.col(b)) & (key[2] == F.col(c)), "left")
        spans, items = F.concat(spans, F.coalesce(f"{more}.spans", F.filter(spans, lambda _: F.lit(False)))), F.concat(items, F.coalesce(f"{more}.items", F.filter(items, lambda _: F.lit(False))))
    out = out.withColumns({"n_words": F.col(f"{first}.n_words"), "spans": spans, "items": F.array_sort(F.array_distinct(items))})
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    return out.withColumn("n_hit", hit.cast("long")).drop(first, a, b, c, more)
