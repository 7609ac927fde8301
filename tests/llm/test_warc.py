import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import warc
from weftgraph.storage import new_path

ROWS = [(7, "http://a/é x\r\nEvil: 1", "<p>é</p>"), (3, None, "same"), (1, "http://b", "same"), (1, "http://b", "same"), (9, "http://c", None), (10, "", ""), (12, "http://d", "x" * 300_000), (None, "http://e", "same"), (40_000_000_000, "http://f", "far")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"shard": F.lit("x"), "digest": F.lit(1)})


def written(spark, rows=ROWS, **options):
    root = new_path(spark, "warc-test")
    warc.write_warc(frame(spark, rows), root, **options)
    return root


def test_records_round_trip(spark):
    rows = warc.read_warc(spark, written(spark)).collect()
    assert len(rows) == len(ROWS)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in rows) == sorted((str(p), len((t or "").encode()), digest(t)) for p, _, t in ROWS)
    assert {r["page_id"]: r["payload"].decode() for r in rows if r["record_type"] == "response"} == {7: "<p>é</p>", None: "same", 9: "", 12: "x" * 300_000, 40_000_000_000: "far"}
    assert sorted((str(r["page_id"]), str(r["refers_to"])) for r in rows if r["record_type"] == "revisit") == [("1", "None"), ("1", "None"), ("10", "9"), ("3", "None")]
    assert {r["url"] for r in rows if r["page_id"] == 7} == {"http://a/é%20x%0D%0AEvil:%201"}


def test_first_of_equal_rows_is_the_response(spark):
    out = warc.archive(frame(spark, [(2, "u", "t"), (2, "u", "t"), (5, "u", "t")])).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == [(2, "response", None), (2, "revisit", 2), (5, "revisit", 2)]


def test_small_payloads_are_never_revisits(spark):
    out = warc.archive(frame(spark, [(1, "u", "t"), (2, "u", "t"), (3, "u", "long"), (4, "u", "long")]), revisit_bytes=2).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in out) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_files_are_the_same_whatever_the_partitions(spark):
    def files(root):
        path = root.removeprefix("file://")
        from pathlib import Path

        return {p.name: p.read_bytes() for p in Path(path).iterdir()}

    rows = [(i, f"http://h/{i}", f"{i % 50}" * 5000) for i in range(900)]
    a = files(written(spark, rows, file_bytes=4000))
    root = new_path(spark, "warc-test")
    warc.write_warc(frame(spark, rows).repartition(7), root, file_bytes=4000)
    assert a == files(root) and len(a) > 6 and not any(n.startswith(".tmp") for n in a)
    names = sorted(n for n in a if n != warc.MANIFEST)
    ids = [int(h["x-page"]) for n in names for h, _ in warc.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(a[n]))))]
    assert ids == sorted(ids) == list(range(900))
    assert len({n[:12] for n in names}) > 1


def test_damaged_files_are_found(spark):
    root = written(spark)
    from pathlib import Path

    name = next(p for p in Path(root.removeprefix("file://")).iterdir() if p.name != warc.MANIFEST)
    data = bytearray(name.read_bytes())
    data[-6] ^= 1
    name.write_bytes(bytes(data))
    with pytest.raises(Exception, match="manifest"):
        warc.read_warc(spark, root).collect()


def test_empty_table(spark):
    assert warc.archive(frame(spark, ROWS[:0])).collect() == []


def test_cuts_follow_the_bytes_even_when_ids_are_far_apart(spark):
    rows = spark.createDataFrame([(i, 1 << 21) for i in range(20)] + [(1 << 60, 1)], "page_id long, bytes long")
    cuts = warc.cut_points(rows)
    assert cuts == sorted(set(cuts)) and 8 <= len(cuts) <= 21 and all(0 < c <= 1 << 60 for c in cuts)


def test_heavy_ids_and_rows_without_one_are_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(warc, "shard_bytes", lambda total: 20_000)
    rows = [(p, f"http://h/{i % 40}", f"{i % 60}" * 900) for i in range(120) for p in (None, 5)] + [(k, "http://x", "y" * 100) for k in range(3, 9)]
    cuts = warc.cut_points(spark.createDataFrame([(p, len(t)) for p, _, t in rows], "page_id long, bytes long"))
    assert cuts == sorted(cuts) and cuts.count(5) > 5 and cuts.count(warc.NULL) > 5 and max(cuts.count(c) for c in cuts if c not in (5, warc.NULL)) == 1
    root = written(spark, rows)
    found = warc.read_warc(spark, root).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in found) == sorted((str(p), len(t)) for p, _, t in rows)
    assert sum(r["record_type"] == "response" for r in found) == len({t for _, _, t in rows})
    bare = warc.read_warc(spark, root, payloads=False)
    assert bare.where("payload is not null").isEmpty() and sorted(map(str, bare.drop("payload").collect())) == sorted(str(r) for r in warc.read_warc(spark, root).drop("payload").collect())
    from pathlib import Path

    assert len({p.name[:12] for p in Path(root.removeprefix("file://")).glob("shard-*")}) > 10


def test_what_failed_attempts_left_is_deleted(spark):
    from pathlib import Path

    root = new_path(spark, "warc-test")
    folder = Path(root.removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / ".tmp-0-0-shard-000000-0000.warc.gz").write_bytes(b"x")
    warc.write_warc(frame(spark), root)
    assert not list(folder.glob(".tmp*"))
    files = warc._Files(root, 9, "a", 1 << 20)
    files.add(b"r")
    files.give_up()
    assert not list(folder.glob(".tmp*")) and not list(folder.glob("shard-000009*"))
