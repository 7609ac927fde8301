"""Table functions: operators that make many rows of one, for use from SQL.

After ``register(spark)``::

    SELECT * FROM chunks(TABLE(documents), 1500, 150)
    SELECT * FROM relations(TABLE(SELECT chunk_id, text FROM parts), 4)
    SELECT * FROM successive(TABLE(events) PARTITION BY user_id ORDER BY (ts), 'user_id', 'event_type')
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weftgraph.operators.chunking import split_text
from weftgraph.operators.extract import RegexRelations


def _needs(table: AnalyzeArgument, *columns: str) -> StructType:
    if not table.isTable or any(c not in table.dataType.names for c in columns):
        raise ValueError(f"a table with the columns {', '.join(columns)} is needed")
    return table.dataType


class Chunks:
    """Recursive chunks ``(chunk_id, doc_id, pos, source, text)`` of a table with ``doc_id``, ``source`` and ``text``."""

    @staticmethod
    def analyze(documents: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        known = _needs(documents, "doc_id", "source", "text")
        if size.value is None or overlap.value is None or overlap.value >= size.value:
            raise ValueError("size and overlap are constants, and overlap is less than size")
        return AnalyzeResult(StructType([StructField("chunk_id", StringType()), known["doc_id"], StructField("pos", IntegerType()), known["source"], StructField("text", StringType())]))

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        for pos, text in enumerate(split_text(row["text"], size, overlap) if row["text"] else []):
            parts = [str(x) for x in (row["doc_id"], pos, text) if x is not None]
            yield hashlib.md5("\x01".join(parts).encode()).hexdigest(), row["doc_id"], pos, row["source"], text


class Relations:
    """``(chunk_id, source, target, relationship)`` of neighbouring words of at least so many letters, of a table with ``chunk_id`` and ``text``."""

    @staticmethod
    def analyze(chunks: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        known = _needs(chunks, "chunk_id", "text")
        return AnalyzeResult(StructType([known["chunk_id"], *[StructField(x, StringType()) for x in ("source", "target", "relationship")]]))

    def __init__(self) -> None:
        self.find = None

    def eval(self, row: Row, length: int) -> Iterator[tuple]:
        self.find = self.find or RegexRelations(length)
        for x in self.find.rows([row["text"] or ""])[0]:
            yield row["chunk_id"], x["source"], x["target"], x["relationship"]


class Successive:
    """The ``key`` column, ``place``, ``value`` and ``next``: each value of a column and the next one, in the order of the table's partition. Holds one row at a time."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        known = _needs(table, key.value, column.value)
        return AnalyzeResult(StructType([known[key.value], StructField("place", LongType()), StructField("value", StringType()), StructField("next", StringType())]))

    def __init__(self) -> None:
        self.place, self.last = 0, None

    def eval(self, row: Row, key: str, column: str) -> Iterator[tuple]:
        value = None if row[column] is None else str(row[column])
        if self.place:
            yield row[key], self.place, self.last, value
        self.place, self.last = self.place + 1, value


FUNCTIONS = {"chunks": Chunks, "relations": Relations, "successive": Successive}


def register(spark: SparkSession) -> None:
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
