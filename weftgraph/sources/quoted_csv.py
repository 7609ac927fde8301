"""``|``-separated files with line breaks in quoted values, read by many tasks.

Where a record begins can't be told from the middle of such a file: a line break may be inside quotes. It is known once the quotes before a place are counted,
as every quote, also of the two that stand for one inside a value, turns inside into outside. So files are cut into byte ranges; a first job counts each range's
quotes; and the sums tell whether a range begins inside. Then a data source (``quoted_csv``) reads ranges, one at a time, in tasks of ``TASK`` bytes or less: a record belongs to the range that
its first byte is in. Columns that aren't asked for aren't converted, and rows that ``only`` rules out don't leave the reader. Spark's own pushing of filters isn't
used: this version keeps a data frame's pushed filters for its next query, which would lose rows.

Files are opened through ``pyarrow.fs``, so they must be where it reads: local mounts, s3, gs, hdfs with libhdfs. Values are text; an empty value is null and a quoted
empty one is empty (null to ``files.read_table``); a record of too few values has nulls for the rest, and values beyond the header's are dropped. Quotes only stand around whole values.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_QUOTE, _BREAK = 34, 10
#: Bytes read at a time beyond a range's end.
_MORE = 1 << 16
#: Bytes of the ranges that a task reads, one after the other, so that short ranges don't cost a task each.
TASK = 16 << 20


def _open(path: str):
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return files.open_input_file(inner)


def _breaks(data: bytes, inside: bool) -> np.ndarray:
    """Places of line breaks outside quotes, if the data begins ``inside`` or outside."""
    signs = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(signs == _BREAK)
    quotes = np.searchsorted(np.flatnonzero(signs == _QUOTE), at)
    return at[(quotes % 2 == 1) == inside]


def _first_break(file, start: int, inside: bool) -> int | None:
    """The first line break outside quotes at ``start`` or later; None if there is none."""
    size = file.size()
    while start < size:
        data = file.read_at(min(_MORE, size - start), start)
        if len(found := _breaks(data, inside)):
            return start + int(found[0])
        inside ^= data.count(b'"') % 2 == 1
        start += len(data)
    return None


def _records(file, start: int, end: int, inside: bool) -> bytes:
    """The records whose first byte is in a range. ``inside``: whether the range begins inside quotes."""
    if start:
        first = start - 1 if not inside and file.read_at(1, start - 1) == b"\n" else _first_break(file, start, inside)
        if first is None or first + 1 >= end:
            return b""
        body, begin = file.read_at(end - first - 1, first + 1), first + 1
    else:
        body, begin = file.read_at(end, 0), 0
    if end < file.size() and not (body.endswith(b"\n") and body.count(b'"') % 2 == 0):
        last = _first_break(file, end, body.count(b'"') % 2 == 1)
        body += file.read_at((file.size() if last is None else last + 1) - end, end)
    return body if begin or body else b""


def _header(file) -> list[str]:
    last = _first_break(file, 0, False)
    line = file.read_at(file.size() if last is None else last, 0).decode()
    return next(csv.reader(io.StringIO(line.lstrip("﻿")), delimiter="|"), [])


def parse(body: bytes, names: list[str], wanted: list[str]) -> pa.Table:
    """Text columns of records, by name; columns that there aren't are null."""
    known = [x for x in wanted if x in names]
    if not body:
        table = pa.table({x: pa.array([], pa.string()) for x in known})
    else:
        try:
            table = pcsv.read_csv(
                pa.BufferReader(body), pcsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, len(body) + 1)),
                pcsv.ParseOptions(delimiter="|", newlines_in_values=True, ignore_empty_lines=True),
                pcsv.ConvertOptions(column_types={x: pa.string() for x in names}, include_columns=known or names[:1], null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False),
            )
        except pa.ArrowInvalid:  # records of other lengths than the header's
            rows = [r for r in csv.reader(io.StringIO(body.decode(), newline=""), delimiter="|", quoting=csv.QUOTE_NOTNULL) if r]
            table = pa.table({x: pa.array([r[k] if k < len(r) else None for r in rows], pa.string()) for x in (known or names[:1]) for k in [names.index(x)]})
    n = table.num_rows
    return pa.table({x: table.column(x) if x in names else pa.nulls(n, pa.string()) for x in wanted}) if wanted else table.select([])


class Range:
    def __init__(self, path: str, start: int, end: int, inside: bool):
        self.path, self.start, self.end, self.inside = path, start, end, inside


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class QuotedCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.ranges, self.only = schema.names, json.loads(options["ranges"]), json.loads(options.get("only", "{}"))

    def partitions(self) -> list[Ranges]:
        return [Ranges([Range(*x) for x in group]) for group in self.ranges]

    def read(self, some: Ranges) -> Iterator[pa.RecordBatch]:
        for part in some.ranges:
            yield from self._read(part)

    def _read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with _open(part.path) as file:
            names = _header(file)
            body = _records(file, part.start, part.end, part.inside)
            if not part.start:
                last = _first_break(pa.BufferReader(body), 0, False)
                body = b"" if last is None else body[last + 1 :]
        table = parse(body, names, [*self.names, *[x for x in self.only if x not in self.names]])
        for column, values in self.only.items():
            table = table.filter(pc.is_in(table.column(column), pa.array(values, pa.string())))
        yield from table.select(self.names).to_batches(10_000)


class QuotedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quoted_csv"

    def schema(self) -> StructType:
        return StructType([StructField(x, StringType()) for x in json.loads(self.options["names"])])

    def reader(self, schema: StructType) -> QuotedCsvReader:
        return QuotedCsvReader(schema, self.options)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(x.getPath().toString(), x.getLen()) for x in files.listStatus(target) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted((p, n) for p, n in found if n)


def ranges(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> list[tuple[str, int, int, bool]]:
    """Byte ranges of a file or of the files of a folder, and whether each begins inside quotes. The driver gets a number for each range."""
    cuts = [(p, a, min(a + split_bytes, n)) for p, n in _files(spark, path) for a in range(0, n, split_bytes)]
    if not cuts:
        return []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with _open(p) as file:
                    found.append(sum(file.read_at(min(1 << 20, b - x), x).count(b'"') for x in range(a, b, 1 << 20)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["path", "start", "quotes"])

    table = spark.createDataFrame(cuts, "path string, start long, end long").repartition(min(len(cuts), 4 * spark.sparkContext.defaultParallelism))
    counted = {(r["path"], r["start"]): r["quotes"] for r in table.mapInArrow(count, "path string, start long, quotes long").collect()}
    out = []
    for p, own in groupby(cuts, lambda x: x[0]):  # in order of files
        own = list(own)
        before = accumulate((counted[p, a] for _, a, _ in own), initial=0)
        out += [(p, a, b, k % 2 == 1) for (_, a, b), k in zip(own, before, strict=False)]
    return out


def grouped(found: list[tuple[str, int, int, bool]], tasks: int) -> list[list[tuple[str, int, int, bool]]]:
    """Ranges in their order, in groups of ``TASK`` bytes or less, or of a ``tasks``-th of all bytes if that is less; a longer range is a group."""
    most = min(TASK, sum(b - a for _, a, b, _ in found) // tasks)
    out, held = [], 0
    for x in found:
        size = x[2] - x[1]
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(x)
        held += size
    return out


def read_quoted(spark: SparkSession, path: str, columns: list[str] | None = None, only: dict[str, list[str | None]] | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """The columns of the files' headers, or those asked for, as text; of the rows whose values are among those of ``only``, by column. A folder without files is an error unless columns are given."""
    spark.dataSource.register(QuotedCsv)
    found = ranges(spark, path, split_bytes)
    if columns is None:
        if not found:
            raise ValueError(f"no file in {path} to take columns from")
        with _open(found[0][0]) as file:
            columns = _header(file)
    return spark.read.format("quoted_csv").option("ranges", json.dumps(grouped(found, 4 * spark.sparkContext.defaultParallelism))).option("names", json.dumps(columns)).option("only", json.dumps(only or {})).load()
