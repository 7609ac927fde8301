"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of page_id. The cuts come from a histogram of payload bytes over
the ids, refined where a bucket is heavier than a shard, so they follow from the data alone. Each shard
is one task: it writes its records in order, each its own gzip member, and begins a new file whenever the
compressed size passes ``file_bytes``. A page_id (or the lack of one) that alone is heavier than a shard has as many shards as it
needs, dealt by a hash of url and digest, which keeps rows that are alike together. A file is written under a temporary name with the attempt in it and
renamed when complete; its name and bytes depend only on the data, so a task that runs again after a lost
executor replaces a file by the same file. What attempts that failed have left is deleted when the manifest is there. When all are there, a manifest with every file's records, bytes
and digest is written the same way; the reader takes files from the manifest only.

Digests are made from the payload, as are lengths, record ids and HTTP headers. Of records with equal
payloads of at least ``revisit_bytes`` bytes the first by (page_id, url) is a response, and the others are
revisits of it without payload, which keep the HTTP headers with the payload's length.

Defined results: a null html is an empty payload; a null url gives records without target URI; control
characters, spaces and line breaks in a url are percent-encoded in its header; rows that repeat get a record
each, and the later ones revisit the first; a null page_id sorts first and is written as ``-``. Columns other
than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.storage import new_path

MANIFEST = "manifest.json"
DATE = "2024-01-01T00:00:00Z"
#: Buckets of the first histogram, as a power of two, and by how many bits a heavy one is refined.
FIRST_BITS, MORE_BITS = 12, 4
#: The place of a null page_id among the others.
NULL = -(1 << 63)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Rows that say what a record is sort before the record.
_ROLE = 0
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def shard_bytes(total: int) -> int:
    """Payload bytes of a shard: 4 MiB for small tables, up to 1 GiB for large ones."""
    return max(4 << 20, min(1 << 30, total // 4096))


def cut_points(rows: DataFrame) -> list[int]:
    """Least page_id of each shard but the first, from ``(page_id, bytes)``. An id is there once more for each further shard that it needs; ``NULL`` stands for none."""
    weight = F.sum(F.col("bytes") + 500)
    low, high, total, absent = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes") + 500))).first()
    target = shard_bytes(total or 0)
    out = [NULL] * ((absent or 0) // target)
    if low is None:
        return out
    known = rows.where("page_id is not null")
    bits = max(0, int(high - low).bit_length() - FIRST_BITS)
    at = F.col("page_id") - F.lit(low)
    found = {(r["k"], bits): r["n"] for r in known.groupBy(F.shiftright(at, bits).alias("k")).agg(weight.alias("n")).collect()}
    while bits:
        heavy = [k for (k, b), n in found.items() if b == bits and n > target]
        if not heavy:
            break
        finer = max(0, bits - MORE_BITS)
        some = rows.sparkSession.createDataFrame([(k,) for k in heavy], "h long")
        split = known.withColumn("h", F.shiftright(at, bits)).join(some, "h").groupBy(F.shiftright(at, finer).alias("k")).agg(weight.alias("n"))
        for k in heavy:
            del found[(k, bits)]
        found |= {(r["k"], finer): r["n"] for r in split.collect()}
        bits = finer
    held, fresh = 0, not out
    for begin, n in sorted((low + (k << b), n) for (k, b), n in found.items()):
        if n > target:  # a single id: its own shards, and the next id begins another
            out += [begin] * -(-n // target)
            held = target
            fresh = False
        elif (held and held + n > target) or not (held or fresh):
            out.append(begin)
            held = n
        else:
            held += n
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _record(kind: str, page: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda p: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{p}')}>"
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else None
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page if kind == 'response' else f'{page}/revisit')}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] if target else []
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page: {'-' if first is None else first}"]
    head += [
        f"X-Page: {'-' if page is None else page}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """The files of one shard."""

    def __init__(self, root: str, shard: int, attempt: str, limit: int):
        self.fs, self.root = _open(root)
        self.shard, self.attempt, self.limit = shard, attempt, limit
        self.number, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.tmp = f"{self.root}/.tmp-{self.attempt}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def give_up(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.tmp)
            self.out = None

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None
            self.number += 1


def _writer(root: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{context.taskAttemptId()}-{context.attemptNumber()}"
        files, done, role, used = None, [], None, False
        try:
            for batch in batches:
                for shard, page, url, digest, kind, size, payload, first, first_url in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if kind == _ROLE:
                        if role is None or role[0] != (page, url, digest):
                            role, used = ((page, url, digest), first, first_url), False
                        continue
                    if files is None or files.shard != shard:
                        if files is not None:
                            files.close()
                            done += files.done
                        files = _Files(root, shard, attempt, file_bytes)
                    shared = role is not None and role[0] == (page, url, digest)
                    # Equal rows are neighbours here: the first of them is the response.
                    revisit = shared and (used or (page, url or "") != role[1:])
                    used = True
                    files.add(_record("revisit" if revisit else "response", page, url, b"" if revisit else payload, size, digest, role[1] if shared else None))
            if files is not None:
                files.close()
                done += files.done
        except BaseException:
            if files is not None:
                files.give_up()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["name", "records", "bytes", "sha256"])

    return write


def write_warc(pages: DataFrame, root: str, file_bytes: int = 256 << 20, revisit_bytes: int = 0) -> None:
    """Write ``pages`` as WARC files and a manifest into the folder ``root``."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.nullif(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    # The first of equal payloads, by (page_id, url): one small row for each digest.
    place = F.struct(F.col("page_id").alias("first"), F.coalesce("url", F.lit("")).alias("first_url"))
    firsts = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(F.min(place).alias("f"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("digest", "bytes", "f.first", "f.first_url")
    cuts = cut_points(rows.select("page_id", "bytes"))
    shard = _shard_of(spark, cuts)(F.col("page_id"), F.xxhash64("url", "digest")).alias("shard")
    # Payloads move once: what a repeated payload's records are is joined without them, and meets them in the sort.
    key = [shard, "page_id", "url", "digest"]
    roles = rows.select("page_id", "url", "digest", "bytes").join(firsts, ["digest", "bytes"])
    roles = roles.select(*key, F.lit(_ROLE).alias("kind"), "bytes", F.lit(None).cast("binary").alias("payload"), "first", "first_url")
    records = rows.select(*key, F.lit(_ROLE + 1).alias("kind"), "bytes", "payload", F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("first_url"))
    placed = records.unionByName(roles)
    fs, path = _open(root)
    fs.create_dir(path, recursive=True)
    parts = max(1, min(len(cuts) + 1, 100_000))
    made = placed.repartitionByRange(parts, "shard").sortWithinPartitions("shard", "page_id", "url", "digest", "kind")
    files = made.mapInArrow(_writer(root, file_bytes), "name string, records long, bytes long, sha256 string").collect()
    text = json.dumps({"files": [r.asDict() for r in sorted(files, key=lambda r: r["name"])]}, indent=0)
    with fs.open_output_stream(f"{path}/.tmp-{MANIFEST}", compression=None) as out:
        out.write(text.encode())
    fs.move(f"{path}/.tmp-{MANIFEST}", f"{path}/{MANIFEST}")
    for left in fs.get_file_info(pafs.FileSelector(path)):
        if left.base_name.startswith(".tmp-"):
            fs.delete_file(left.path)


def _shard_of(spark: SparkSession, cuts: list[int]):
    import numpy as np

    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.arrow_udf("int")
    def shard(column: pa.Array, hashes: pa.Array) -> pa.Array:
        ids = column.fill_null(NULL).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(shared.value, ids, side) for side in ("left", "right"))
        return pa.array((high - hashes.to_numpy(zero_copy_only=False) % np.maximum(1, high - low + (ids == NULL))).astype(np.int32))

    return shard


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().decode().rstrip("\r\n")):
            key, _, value = line.partition(":")
            headers[key.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        stream.read(4)
        yield headers, block


def _reader(root: str, payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(root)
        fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    digest = hashlib.sha256()
                    while chunk := raw.read(1 << 20):
                        digest.update(chunk)
                if digest.hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as plain:
                    for headers, block in parse(io.BufferedReader(plain, 1 << 20)):
                        if f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != headers["warc-block-digest"]:
                            raise ValueError(f"block digest in {name}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = headers["warc-type"] == "response"
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else headers["warc-payload-digest"].removeprefix("sha1:")
                        if f"sha1:{own}" != headers["warc-payload-digest"]:
                            raise ValueError(f"payload digest in {name}")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        number = lambda x: None if x in (None, "-") else int(x)
                        rows.append((number(headers["x-page"]), headers.get("warc-target-uri"), payload if response and payloads else None, size, own, headers["warc-type"], number(headers.get("x-refers-to-page"))))
                        held += 200 + (len(payload) if payloads else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], fields)

    return read


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)`` of the files of a manifest, verified.

    Without ``payloads`` they are read and verified all the same, but stay where they are read and come out null.
    """
    fs, path = _open(root)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as stream:
        files = json.loads(stream.read())["files"]
    if not files:
        return spark.createDataFrame([], "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    listed = spark.createDataFrame([(f["name"], f["sha256"]) for f in files], "name string, sha256 string").repartition(min(len(files), 10_000))
    return listed.mapInArrow(_reader(root, payloads), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back, without payloads."""
    spark = pages.sparkSession
    root = new_path(spark, "warc")
    write_warc(pages, root, revisit_bytes=revisit_bytes)
    return read_warc(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB's SQL: base32 digit by digit from the 40 hex digits of the SHA-1.
SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), n AS (
  SELECT page_id, payload_bytes, h, list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(1 + 5 * k AS INTEGER), 5) AS BIGINT)) AS fives FROM p
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32768 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 1024 % 32 AS INTEGER) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32 % 32 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 AS INTEGER) + 1, 1)), '') AS payload_digest FROM n
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""
