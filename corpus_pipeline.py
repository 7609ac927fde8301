"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``, and no others: a stage's own columns and any further
ones of its input are left out.

Defined results, in every stage: an empty table gives an empty one; rows that repeat are judged alike, and rows that share a doc_id
are one document to near_dedup, so they stay or go together; a null doc_id is a value like any other, but near_dedup keeps such rows, as it
has no id to drop them by; null texts go at the first stage, and a stage that is given one keeps it as it is (packing: as an empty text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import queries
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.language_id import UNKNOWN, identify
from weftgraph.llm.line_dedup import dedup_lines
from weftgraph.llm.near_dedup import near_duplicates
from weftgraph.llm.packing import pack
from weftgraph.storage import cut, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go: no text, no letter, or no n-gram of letters that a learnt language has.

    No threshold of score: clean documents of one word score as low as text of a script that was not learnt.
    """
    return identify(docs, known=True).where((F.col("lang_pred") != UNKNOWN) & F.col("known")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from texts; a document of nothing else goes, as its lines stay where they came first. A null text stays."""
    out = dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id. Documents without words or id stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. A null text holds none."""
    return decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens; rows that repeat are packed as often as they occur."""
    return pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenising, kernels and near copies are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage wrote for itself, and the documents it read, are deleted when the next ones are written."""
    docs, path = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            out = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            last = made.pop()  # the stage's documents stay
            made += [path] if path else []
        docs, path = out, last
    return docs
