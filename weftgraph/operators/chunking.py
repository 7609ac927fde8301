"""Splitting documents into chunks.

The recursive splitter works per text, so it is an Arrow function over the text column and needs no shuffle. It
splits at the coarsest separator that occurs, splits pieces that are still too long at the next, and then joins
neighbours greedily up to ``size`` characters, carrying at most ``overlap`` characters of whole pieces into the
next chunk. A separator stays at the head of the piece after it; chunks are stripped, and empty ones go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *[separator + x for x in rest]] if p]


def _joined(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return [*out, "".join(held)] if held else out


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters (longer only if no separator is left to split at)."""
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    out: list[str] = []
    fitting: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) <= size:
            fitting.append(piece)
            continue
        out += _joined(fitting, size, overlap)
        fitting = []
        out += split_text(piece, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [piece]
    out += _joined(fitting, size, overlap)
    return [c for c in (x.strip() for x in out) if c]


def _splitter(size: int, overlap: int):
    @F.arrow_udf("array<string>")
    def split(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([split_text(x, size, overlap) if x else [] for x in column.to_pylist()], pa.list_(pa.string()))

    return split


def chunk_id(doc_id: Column, pos: Column, text: Column) -> Column:
    """32 hex digits that follow from the chunk itself."""
    return F.md5(F.concat_ws("\u0001", doc_id.cast("string"), pos.cast("string"), text))


def _with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select(chunk_id(F.col("doc_id"), F.col("pos"), F.col("text")).alias("chunk_id"), "doc_id", "pos", "source", "text")


def recursive_chunks(documents: DataFrame, size: int = 1500, overlap: int = 150) -> DataFrame:
    """``(chunk_id, doc_id, pos, source, text)`` of ``(doc_id, source, text)``."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    return _with_ids(documents.select("doc_id", "source", F.posexplode(_splitter(size, overlap)("text")).alias("pos", "text")))


def fixed_chunks(documents: DataFrame, size: int = 1500, overlap: int = 150) -> DataFrame:
    """Chunks at a fixed stride of ``size - overlap`` characters; DataFrame functions only."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(size - overlap))
    cut = documents.where("text <> ''").select("doc_id", "source", "text", F.posexplode(starts).alias("pos", "start"))
    return _with_ids(cut.withColumn("text", F.substring("text", F.col("start") + 1, F.lit(size))).select("doc_id", "source", "pos", "text"))


def chunk_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks at positions ``first`` to ``last`` - 1 of their documents."""
    return chunks.where((F.col("pos") >= first) & (F.col("pos") < last))
