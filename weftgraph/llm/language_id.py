"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as the number of byte n-grams (n = 1, 2, 3 together) that both hold, each
counted once, over the geometric mean of their own numbers. A-Z count as a-z and every other ASCII
character that is no letter as a space. N-grams of the landmarks all have a column; those of a text that no landmark
holds add to its own number only, as they can't be common.
Landmarks are labelled texts, the same number from each language. One-versus-rest kernel ridge
regression is solved on the landmarks' span (Nystroem: subset of regressors), and texts are scored
in batches: a 0/1 matrix of texts by n-grams, times landmarks, times coefficients.

Training reads about ``per_language`` labelled texts of each language, chosen by a hash of id and text; that bound is the only
sampling. The driver gets the n-grams of the landmarks and sums of one size from the executors, never a text. Every text is scored whole.

Defined results: ``und`` with score 0 for a text that is null or has no letter, or where there is no
labelled text to learn from; ties go to the first language in sorted order; a row with a null doc_id
is not held out, and is not learnt from; rows that repeat are learnt from once and get a result each. All columns of the input
are carried along whatever their names, and columns named like the added ones are replaced; only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.names import free
from weftgraph.llm import textkernels as tk
from weftgraph.storage import cut, drop

ORDERS, LANDMARKS, RIDGE = 3, 192, 1e-4
#: Tasks among which the texts to learn from are dealt: so many sums go to the driver.
PARTS = 16
#: Entries of a batch's matrix of texts by n-grams.
CELLS = 1 << 22
UNKNOWN = "und"
_BASE = (0, 1 << 8, (1 << 8) + (1 << 16))
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: Not bytes inside a character, nor first bytes of signs (0xC2 and 0xE2), which scripts share.
_TELLS = ((_FOLD != 32) & ((np.arange(256) < 128) | (np.arange(256) >= 0xC3)) & (np.arange(256) != 0xE2)).astype(np.float32)
_LOOKUPS: dict[int, tuple] = {}


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """A number for the n-gram that begins at each byte but the last n - 1."""
    wide = _FOLD[data].astype(np.int32)
    out = np.full(max(0, len(data) - n + 1), _BASE[n - 1], np.int32)
    for k in range(n):
        out += wide[k : k + len(out)] << (8 * (n - 1 - k))
    return out


def presence(data: np.ndarray, at: np.ndarray, lookup: np.ndarray, width: int, others: np.ndarray | None = None) -> np.ndarray:
    """0/1 matrix of texts by n-grams of the vocabulary. Each text's number of different n-grams without a column is added to ``others``."""
    out = np.zeros((len(at) - 1) * width, np.float32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in range(1, ORDERS + 1):
        code = codes(data, n)
        column = lookup[code]
        m = len(column)
        inside = row[:m] == row[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
        held, other = inside & (column >= 0), inside & (column < 0)
        out[row[:m][held] * width + column[held]] = 1
        if others is not None:
            others += np.bincount(np.unique(row[:m][other] << 25 | code[other]) >> 25, minlength=len(others))
    return out.reshape(-1, width)


def batches(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of texts whose matrix has at most about ``CELLS`` entries."""
    step = max(1, min(512, CELLS // max(1, width)))
    for first, last, data, at in tk.blocks(column, 1 << 20):
        for i in range(first, last, step):
            j = min(last, i + step)
            part = at[i - first : j - first + 1]
            yield i, j, data[part[0] : part[-1]], part - part[0]


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.grams, self.landmarks, self.weights = languages, grams, landmarks, weights

    def kernel(self, x: np.ndarray, others: np.ndarray | float = 0.0) -> np.ndarray:
        own = np.sqrt(np.maximum(x.sum(axis=1) + others, 1)).astype(np.float32)
        return (x @ self.landmarks.T) / own[:, None] / np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]

    def telling(self) -> np.ndarray:
        """1 for each n-gram (rows) of order n (columns) that holds an ASCII letter or the first byte of another script's letter."""
        out = np.zeros((len(self.grams), ORDERS), np.float32)
        for n in range(1, ORDERS + 1):
            own = self.grams - _BASE[n - 1]
            for k in range(n):
                out[:, n - 1] = np.maximum(out[:, n - 1], _TELLS[own >> 8 * k & 255])
            out[(own < 0) | (own >= 1 << 8 * n), n - 1] = 0
        return out

    def kernel_of(self, data: np.ndarray, at: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        others = np.zeros(len(at) - 1)
        return self.kernel(presence(data, at, lookup, len(self.grams), others), others)

    def lookup(self) -> np.ndarray:
        out = np.full((1 << 8) + (1 << 16) + (1 << 24), -1, np.int16 if len(self.grams) < 1 << 15 else np.int32)
        out[self.grams] = np.arange(len(self.grams))
        return out


def grams_of(data: np.ndarray) -> np.ndarray:
    """The different n-grams of a text, sorted."""
    return np.unique(np.concatenate([codes(data, n) for n in range(1, ORDERS + 1)]))


def landmark_model(languages: list[str], landmarks: list[np.ndarray]) -> Model:
    """A model without weights, of the landmarks' n-grams."""
    grams = np.unique(np.concatenate([np.zeros(0, np.int32), *landmarks])).astype(np.int64)
    rows = np.zeros((len(landmarks), len(grams)), np.float32)
    for i, own in enumerate(landmarks):
        rows[i, np.searchsorted(grams, own)] = 1
    return Model(languages, grams, rows, np.zeros((0, 0)))


def sums(model: Model, lookup: np.ndarray, column: pa.Array, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``k.T @ k`` and ``k.T @ y`` of labelled texts, k being their kernel with the landmarks and y 1 for their language and -1 for others."""
    m, names = len(model.landmarks), np.array(model.languages)
    a, b = np.zeros((m, m)), np.zeros((m, len(names)))
    for i, j, data, at in batches(column, len(model.grams)):
        k = model.kernel_of(data, at, lookup).astype(np.float64)
        a += k.T @ k
        b += k.T @ np.where(np.array(labels[i:j])[:, None] == names[None, :], 1.0, -1.0)
    return a, b


def solve(model: Model, a: np.ndarray, b: np.ndarray, rows: int) -> Model:
    """The model with the weights that ridge regression on the landmarks' span gives."""
    a = a + RIDGE * rows * model.kernel(model.landmarks).astype(np.float64)
    model.weights = np.linalg.lstsq(a + 1e-9 * np.trace(a) / len(a) * np.eye(len(a)), b, rcond=None)[0]
    return model


def chosen(labels: list[str]) -> tuple[list[str], list[int]]:
    """The languages, and which rows are landmarks: the first of each language."""
    languages = sorted(set(labels))
    each = max(1, LANDMARKS // max(1, len(languages)))
    return languages, [i for lang in languages for i in [k for k, x in enumerate(labels) if x == lang][:each]]


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """A model of labelled texts, given in the order in which landmarks are to be taken."""
    languages, landmarks = chosen(labels)
    if not languages:
        return None
    model = landmark_model(languages, [grams_of(np.frombuffer(texts[i].encode(), np.uint8)) for i in landmarks])
    return solve(model, *sums(model, model.lookup(), pa.array(texts), labels), len(texts))


def _model(broadcast, number: int) -> tuple[Model, np.ndarray]:
    """This worker's copy of a model and its table of n-grams."""
    if number not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[number] = (broadcast.value, broadcast.value.lookup())
    return _LOOKUPS[number]


_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[65:91] = _ASCII_LETTERS[97:123] = True


def lettered(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter."""
    return bool(_ASCII_LETTERS[data].any()) or (bool((data >= 128).any()) and any(map(str.isalpha, data.tobytes().decode(errors="replace"))))


def predict(column: pa.Array, model: Model, lookup: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, and whether a text shares an n-gram of a letter with a landmark, n being 3 or the bytes of a shorter text."""
    names, scores, known = [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
    telling = model.telling()
    for i, j, own, part in batches(column, len(model.grams)):
        others = np.zeros(j - i)
        x = presence(own, part, lookup, len(model.grams), others)
        f = model.kernel(x, others) @ model.weights
        known[i:j] = (x @ telling)[np.arange(j - i), np.clip(np.diff(part), 1, ORDERS) - 1] > 0
        best = f.argmax(axis=1)
        for d in range(i, j):
            if lettered(own[part[d - i] : part[d - i + 1]]):
                names[d] = model.languages[best[d - i]]
                scores[d] = min(1.0, max(0.0, (float(f[d - i, best[d - i]]) + 1) / 2))
    return names, scores, known


def _predictor(broadcast, number: int):
    @F.arrow_udf("struct<lang_pred:string, score:double, known:boolean>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, lookup = _model(broadcast, number)
        for column in columns:
            names, scores, known = predict(column, model, lookup)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(known)], ["lang_pred", "score", "known"])

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = 1000) -> Model | None:
    """Learn from rows with a language and an id that is not held out."""
    able = documents.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    able = able.select("text", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    most = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, per_language / n) * (1 << 30)) + 1))])
    sample = cut(able.where(F.col("h") < most[F.col("lang")]).dropDuplicates(["lang", "h"]), "labelled")
    keys = sorted((r["lang"], r["h"]) for r in sample.select("lang", "h").collect())
    languages, landmarks = chosen([lang for lang, _ in keys])
    if not languages:
        return None
    wanted = F.broadcast(documents.sparkSession.createDataFrame([keys[i] for i in landmarks], "lang string, h long"))

    def grams(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            own = [grams_of(np.frombuffer(x.encode(), np.uint8)).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.list_(pa.int32()))], ["lang", "h", "grams"])

    found = {(r["lang"], r["h"]): np.array(r["grams"], np.int32) for r in sample.join(wanted, ["lang", "h"]).select("lang", "h", "text").mapInArrow(grams, "lang string, h long, grams array<int>").collect()}
    model = landmark_model(languages, [found[keys[i]] for i in landmarks])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def partial(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, first = shared.value, None, None
        lookup = own.lookup()
        for batch in batches_:
            first = batch.column(0)[0].as_py() if first is None else first
            got = sums(own, lookup, batch.column(2), batch.column(1).to_pylist())
            total = got if total is None else (total[0] + got[0], total[1] + got[1])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in total]], ["h", "a", "b"])

    dealt = sample.select("h", "lang", "text").repartition(PARTS, "h").sortWithinPartitions("h", "lang")
    parts = sorted(dealt.mapInArrow(partial, "h long, a binary, b binary").collect(), key=lambda r: r["h"])
    a, b = (sum(np.frombuffer(r[c]) for r in parts) for c in ("a", "b"))
    shared.destroy()
    drop(sample)
    return solve(model, a.reshape(len(landmarks), -1), b.reshape(len(landmarks), -1), len(keys))


def identify(documents: DataFrame, per_language: int = 1000, known: bool = False) -> DataFrame:
    """``documents`` with ``held_out``, ``lang_pred`` and ``score``; with ``known`` also whether the text shares letters' n-grams with the landmarks (see ``predict``)."""
    model = train(documents, per_language)
    out = documents.withColumn("held_out", held_out(F.col("doc_id")))
    if model is None:
        return out.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)} | ({"known": F.lit(False)} if known else {}))
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    found = _predictor(broadcast, int(broadcast._jbroadcast.id()))(F.col("text").cast("string"))
    names = ["lang_pred", "score", *(["known"] if known else [])]
    own = free([*out.columns, *names], "found")[0]
    return out.withColumn(own, found).withColumns({x: F.col(f"{own}.{x}") for x in names}).drop(own)
