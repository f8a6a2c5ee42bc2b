"""WARC bundles: round trips, the seek table, random access, nulls, repeats and damage."""

import base64
import hashlib
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from lumigrid.llm import warc

SCHEMA = "page_id long, url string, html string"
LONG = "<p>é</p>" * 100_000
ROWS = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>two</p>"),
    (3, "http://a/3 x\r\ny", "<p>one</p>"),
    (4, None, None),
    (5, "http://a/5", ""),
    (6, "http://a/6", LONG),
    (7, "http://a/7", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    (None, "http://a/n", "<p>two</p>"),
    (None, None, "<p>alone</p>"),
    (None, None, "<p>alone</p>"),
    (9, "http://a/9", "<p>nine</p>"),
    (9, "http://a/9", "<p>nine</p>"),
    (10, "http://a/9", "<p>nine</p>"),
]
CLASH = ["sha1", "first", "n", "record_id", "bundle", "frame", "offset", "payload", "refers_to"]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in CLASH})


def local(archive):
    return archive.folder.removeprefix("file:").replace("//", "/") + "/bundles"


def test_every_page_comes_back(spark):
    archive = warc.archived(pages(spark), frame=1000)
    found = archive.records().collect()
    expected = []
    for page_id, _, html in ROWS:
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        to = first if first is not None and first != page_id else None
        data = (html or "").encode()
        expected.append((page_id, "response" if to is None else "revisit", to, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), data if to is None else None))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_index_leads_to_the_records(spark):
    archive = warc.archived(pages(spark), frame=1000)
    found = {(r["record_id"], r["bundle"], r["frame"], r["offset"], r["length"]) for r in archive.records(payloads=False).collect()}
    assert found == {tuple(r[c] for c in ("record_id", "bundle", "frame", "offset", "length")) for r in archive.index.collect()}
    for r in archive.index.where("page_id = 2").collect():
        with open(f"{local(archive)}/{r['bundle']}", "rb") as f:
            data = f.read()
        n = struct.unpack("<I", data[-9:-5])[0]
        sizes = [struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - k)) for k in range(n)]
        start = sum(a for a, _ in sizes[: r["frame"]])
        plain = zstandard.ZstdDecompressor().decompress(data[start : start + sizes[r["frame"]][0]])
        assert plain[r["offset"] :][: r["length"]].endswith(b"<p>two</p>\r\n\r\n")


def test_bundles_are_plain_zstandard(spark):
    archive = warc.archived(pages(spark), frame=1000, bundle=2000)
    names = {r["bundle"] for r in archive.index.select("bundle").distinct().collect()}
    assert names == set(os.listdir(local(archive))) and len(names) > 1
    for name in names:
        with open(f"{local(archive)}/{name}", "rb") as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_random_access(spark):
    archive = warc.archived(pages(spark), frame=1000)
    wanted = spark.createDataFrame([(3,), (6,), (3,), (77,)], "page_id long")
    assert {r["page_id"] for r in archive.fetch(wanted).collect()} == {3, 6}
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in archive.resolved(wanted).collect()}
    assert got == {3: "<p>one</p>", 6: LONG}


def test_files_of_lost_tasks_do_not_count(spark):
    archive = warc.archived(pages(spark))
    with open(f"{local(archive)}/left-by-a-lost-task.warc.zst", "wb") as f:
        f.write(b"half a bundle")
    assert archive.records().count() == len(ROWS)


def test_damage_is_found(spark):
    archive = warc.archived(pages(spark, [(1, "u", "<p>one</p>" * 50)]))
    name = os.listdir(local(archive))[0]
    with open(f"{local(archive)}/{name}", "rb") as f:
        data = f.read()
    (packed, plain), table = struct.unpack_from("<II", data, len(data) - 17), len(data) - 25
    broken = zstandard.ZstdDecompressor().decompress(data[:packed]).replace(b"<p>one", b"<p>ten", 1)
    again = zstandard.ZstdCompressor().compress(broken)
    with open(f"{local(archive)}/{name}", "wb") as f:
        f.write(again + warc.seek_table([(len(again), plain)]))
    assert table == packed
    with pytest.raises(Exception, match="is damaged"):
        archive.records().collect()


def test_empty_table(spark):
    archive = warc.archived(pages(spark, []))
    assert archive.records().count() == 0 and archive.fetch(pages(spark)).count() == 0
