"""Sequence packing by patterns of few lengths, fitted by non-negative least squares.

1. Each text is tokenised and cut into pieces of at most ``capacity`` ids; only digests of the ids go on.
2. The histogram of piece lengths (at most ``capacity`` rows, counted over all pieces) goes to the driver.
3. Lengths are grouped into ``BINS`` bins. All patterns of at most ``DEPTH`` bins that fill a sequence are
   enumerated, and non-negative least squares gives how often to repeat each, so that the patterns
   together use up the histogram. The repeats are rounded down.
4. Each pattern is made with exact lengths: the longest left of each of its bins, and for its last place
   the longest length left that fits. What the patterns leave over is packed best fit, longest first,
   into the room left in sequences and into new ones. All of this works on counts of equal lengths, so
   its cost depends on ``capacity``, not on the number of pieces.
5. The plan says for each length which ranks go to which sequences; its size depends on ``capacity`` only, so it is
   broadcast. Ranks within a length are counted in blocks of about ``BLOCK_ROWS`` rows, dealt by a hash of each row's place
   in the written table, so that neither a length that many pieces share nor rows that repeat are a hot key.

Tokenising: white space never lies inside a token of this tokenizer, so texts are split at ASCII white
space and each distinct stretch is encoded once and kept in a bounded cache. Stretches of one word are merged many
at a time by ``wordmerges``, which gives the library's ids; all others, and tokenizers of another kind, go to the library.

Defined results: a null or empty text has only the end id; rows that repeat are packed as often as they
occur; a null doc_id is a value like any other. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.wordmerges import WordMerges
from weftgraph.storage import cut

BINS, DEPTH, BLOCK_ROWS = 64, 4, 50_000
#: Entries and longest stretch that the cache of encoded stretches keeps.
CACHE, CACHED_LENGTH = 600_000, 64
_MARKS = np.zeros(256, bool)
_MARKS[[ord("."), ord(",")]] = True
_ONE_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?").fullmatch
_ENCODERS: dict[str, "StretchEncoder"] = {}


class StretchEncoder:
    """Ids of whole texts, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        try:
            self.merges = WordMerges(json.loads(self.tokenizer.to_str()))
        except (ValueError, KeyError):
            self.merges = None

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of Latin letters with a full stop or a comma behind, or none, which is a word of its own to the tokenizer."""
        raw = [x.lower().encode() for x in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum([0, *map(len, raw)])
        starts = np.union1d(begin[:-1], np.flatnonzero(_MARKS[data]))
        ids = self.merges.encode(data, starts)
        held = ids >= 0
        at = (4 * np.append(0, np.cumsum(held))[begin]).tolist()
        flat = ids[held].astype("<u4").tobytes()
        return {x: flat[a:b] for x, a, b in zip(words, at, at[1:], strict=False)}

    def encode_new(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches without ASCII white space."""
        words, rest, out = [], [], {}
        for x in stretches:
            (words if self.merges and _ONE_WORD(x) else rest).append(x)
        for i in range(0, len(words), 50_000):
            out |= self.encode_words(words[i : i + 50_000])
        if rest:
            encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            out.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(rest, encoded, strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        known = self.known
        seen: set[str] = set()
        for parts in split:
            seen.update(parts)
        ids = self.encode_new([part for part in seen if part not in known])
        known.update((p, b) for p, b in ids.items() if len(p) <= CACHED_LENGTH)
        look = known if all(len(p) <= CACHED_LENGTH for p in ids) else {**{p: known[p] for parts in split for p in parts if p in known}, **ids}
        return [b"".join(map(look.__getitem__, parts)) for parts in split]


def stretch_encoder(path: str) -> StretchEncoder:
    """This worker's encoder: it and its cache outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = StretchEncoder(path)
    return _ENCODERS[path]


def _runs(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters."""
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= size:
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _piecer(path: str, capacity: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretch_encoder(path)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows, piece, crc, length = [], [], [], []
            for i, j in _runs(texts, 1 << 20):
                for d, ids in enumerate(encoder.encode(texts[i:j]), i):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), step)):
                        part = ids[a : a + step]
                        rows.append(d)
                        piece.append(k)
                        crc.append(zlib.crc32(part))
                        length.append(len(part) // 4)
            k = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(k), pa.array(k.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, a row for each piece."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _piecer(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All falling sequences of at most ``depth`` numbers from 1 with the sum ``bins``."""
    out = []

    def grow(left: int, most: int, have: tuple[int, ...]) -> None:
        if left == 0:
            out.append(have)
        elif len(have) < depth:
            for b in range(min(left, most), 0, -1):
                if b * (depth - len(have)) < left:
                    break
                grow(left - b, b, (*have, b))

    grow(bins, bins, ())
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 of least ``|a x - y|`` (Lawson and Hanson's active set method)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gain = a.T @ y
    small = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0)))
    while rounds and (gain[~free] > small).any():
        free[np.argmax(np.where(free, -np.inf, gain))] = True
        while rounds:
            rounds -= 1
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                break
            x += float(np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))) * (s - x)
            free &= x > 1e-12 * max(1.0, float(x.max()))
            x[~free] = 0
        x = np.maximum(s, 0)
        gain = a.T @ (y - a @ x)
    return x


class Plan:
    """Sequences as groups: how many of them are alike, and which lengths each holds how often."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        #: By room left: [number of sequences, [(length, times), ...]].
        self.open: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(self, count: int, held: list[tuple[int, int]]) -> None:
        self.open.setdefault(self.capacity - sum(a * b for a, b in held), []).append((count, held))

    def longest(self, low: int, high: int) -> int:
        """The longest length left in low..high, or 0."""
        if high < low:
            return 0
        at = np.flatnonzero(self.left[low : high + 1])
        return int(low + at[-1]) if len(at) else 0

    def fit(self) -> None:
        """Fill patterns of bins as often as non-negative least squares says."""
        bins = min(BINS, self.capacity)
        edge = np.ceil(np.arange(1, bins + 1) * self.capacity / bins).astype(int) if self.capacity % bins else np.arange(1, bins + 1) * (self.capacity // bins)
        edge = np.concatenate([[0], np.minimum(edge, self.capacity)])
        total = np.array([self.left[edge[b] + 1 : edge[b + 1] + 1].sum() for b in range(bins)], float)
        kinds = patterns(bins, DEPTH)
        a = np.zeros((bins, len(kinds)))
        for k, kind in enumerate(kinds):
            for b in kind:
                a[b - 1, k] += 1
        weight = np.where(np.arange(bins) < bins // 16, 0.3, 1.0)  # short pieces find room later anyway
        times = np.floor(nnls(a * weight[:, None], total * weight) + 1e-9).astype(np.int64)
        for k in np.argsort([-max(kind) for kind in kinds], kind="stable"):
            want = int(times[k])
            while want > 0:
                held: dict[int, int] = {}
                room = self.capacity
                for place, b in enumerate(kinds[k]):
                    last = place == len(kinds[k]) - 1 and place > 0
                    low, high = (1, room) if last else (int(edge[b - 1]) + 1, min(int(edge[b]), room))
                    for length, n in held.items():
                        self.left[length] -= n
                    pick = self.longest(low, high)
                    for length, n in held.items():
                        self.left[length] += n
                    if not pick:
                        break
                    held[pick] = held.get(pick, 0) + 1
                    room -= pick
                if len(kinds[k]) != sum(held.values()):
                    break
                n = min(want, min(int(self.left[length]) // times_ for length, times_ in held.items()))
                for length, times_ in held.items():
                    self.left[length] -= n * times_
                self.put(n, list(held.items()))
                want -= n

    def best_fit(self) -> None:
        """Pack what is left, longest first, where it leaves the least room."""
        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                room = min((r for r, groups in self.open.items() if r >= length and groups), default=0)
                if not room:
                    each = self.capacity // length
                    if n >= each:
                        self.put(n // each, [(length, each)])
                    if n % each:
                        self.put(1, [(length, n % each)])
                    break
                count, held = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                each = min(room // length, n)
                take = min(count, n // each)
                if take < count:
                    self.open.setdefault(room, []).append((count - take, held))
                self.put(take, [*held, (length, each)])
                n -= take * each
            self.left[length] = 0

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, end rank, first sequence, offset, times): ranks of a length, dealt to sequences in turn."""
        out, sequence, rank = [], 0, dict.fromkeys(range(self.capacity + 1), 0)
        for room in sorted(self.open):
            for count, held in self.open[room]:
                offset = 0
                for length, times in held:
                    out.append((length, rank[length], rank[length] + count * times, sequence, offset, times))
                    rank[length] += count * times
                    offset += length * times
                sequence += count
        return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    made = Plan(histogram, capacity)
    made.fit()
    made.best_fit()
    return made.rows()


def pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece."""
    spark = documents.sparkSession
    cutted = cut(pieces(documents, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, capacity)
    made = F.broadcast(spark.createDataFrame(rows or [(0, 0, 0, 0, 0, 1)], "p_length long, first long, last long, sequence long, at long, times long"))
    # At most ``capacity`` rows: how many blocks the ranks of a length are counted in.
    dealt = F.broadcast(spark.createDataFrame([(length, -(-n // BLOCK_ROWS)) for length, n in histogram.items()] or [(0, 1)], "length long, blocks long"))
    placed_rows = cutted.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("place")).join(dealt, "length")
    blocked = placed_rows.withColumn("block", F.pmod("place", "blocks")).drop("blocks")
    sizes = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32", "place")) - 1
    ranked = blocked.withColumn("inside", inside).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.join(made, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("sequence + (rank - first) div times").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("times")) * F.col("length")).alias("offset"),
    )
