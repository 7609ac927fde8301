"""File sources and sinks. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.schemas import CHUNKS_CSV, CONCEPTS, RELATIONS

_CSV = {"sep": "|", "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, source, text)``: one document per file of a folder, read whole."""
    source = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(F.md5(source).alias("doc_id"), source.alias("source"), F.col("value").alias("text"))


def binary_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """``(doc_id, source, page, text)``: pages that ``parse`` finds in each file, for formats such as PDF."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = parse(content)
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["source", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(pages, "source string, page int, text string").select(F.md5(F.concat_ws("#", "source", "page")).alias("doc_id"), "source", "page", "text")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A ``|``-separated file with header; quoted values may hold line breaks. Columns are found by name: columns of the schema
    that the file lacks are null, and others stay text."""
    plain = spark.read.options(**_CSV).csv(path)
    known = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in plain.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return plain.select(*known, *[c for c in plain.columns if c not in schema.names])


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """A relation file, in whichever of the two schemas it is; all values as text."""
    plain = spark.read.options(**_CSV).csv(path)
    return plain if "node_1" in plain.columns else read_table(spark, path, RELATIONS)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CONCEPTS)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CHUNKS_CSV)


def write_table(table: DataFrame, path: str) -> None:
    """A folder of ``|``-separated files with header; arrays are joined by commas. Parent folders are made."""
    flat = table.select(*[F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in table.dtypes])
    flat.write.mode("overwrite").options(**{k: v for k, v in _CSV.items() if k != "multiLine"}).csv(path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], regenerate: bool = False) -> DataFrame:
    """The table at ``path`` if it is there and complete and not to be made again; else what ``compute`` gives, written there first.

    Complete means that the writer has left its mark of success, so a half-written table is made again.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if regenerate or not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_to_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Python rows as a table; keys that a row lacks are null and others are dropped."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
