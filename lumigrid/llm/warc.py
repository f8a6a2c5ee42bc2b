"""Operator 11: WARC archives as seekable Zstandard bundles.

Records are written in frames: independent Zstandard frames of about ``FRAME``
bytes of records.  A bundle is a file of frames; behind the last one a skippable
frame holds the seek table (compressed and plain size of each frame) and, at its end,
their number, as the public seekable format lays them down.  So a reader takes the
footer, the table and the frames that it wants, and any Zstandard tool reads the whole.
An index row maps each record to its bundle, frame, offset in the frame's plain bytes and length.

A page becomes a ``response`` record with its payload or, if a page of a smaller
id has an equal one, a ``revisit`` record that names that page and repeats the HTTP
head (with the payload's length) alone.  Equal payloads are known by their SHA-1, which
meet in one small aggregation; the pages themselves are shuffled once.

Tasks write their own bundles straight into the folder, under names that no other
attempt uses; the index, which Spark commits, says which bundles count.  So a
lost executor leaves files that nothing reads, and never half an archive.

Defined results: a null payload counts as empty; a null url is written as the
record's own id; pages with a null id are never named by others while one
with an id has the same payload, and are responses if none has; repeated rows of the
page that others name are responses each; a payload longer than a frame has a frame of
its own; an empty table gives an archive without bundles; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.llm.common import shared_dir, tidy, written

#: Plain bytes of a frame and of a bundle, about.
FRAME, BUNDLE = 1 << 18, 1 << 28
#: Fixed values of the seekable format: a skippable frame's magic number, that of the footer, and the footer's size.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
#: Fixed values of the record format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """The bytes of a response, or of a revisit of page ``first``."""
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = record_id(page_id)
    target = name if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, head fields (in lower case) and block of each record."""
    at, view = 0, memoryview(plain)
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        yield at, stop + 4 - at, head, view[end + 4 : stop]
        at = stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame of (compressed, plain) sizes that ends a bundle."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + FOOTER) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


def frames_of(file: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", file.read_at(FOOTER, size - FOOTER))
    if magic != SEEKABLE:
        raise ValueError("the file has no seek table")
    each = 12 if flags & 128 else 8  # with check sums
    table = file.read_at(n * each, size - FOOTER - n * each)
    found, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * each)
        found.append((at, packed, plain))
        at += packed
    return found


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Where the folder is, as seen from a task: any store that pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder) if ":" in folder else f"file://{folder}")


@dataclass(frozen=True)
class Archive:
    """Bundles in a folder, and the index that Spark committed of them."""

    spark: SparkSession
    folder: str

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")

    def records(self, payloads: bool = True) -> DataFrame:
        """All records, frame by frame; a payload whose digest differs is an error.  Without
        ``payloads`` they are checked but not returned."""
        bundles = self.index.select("bundle").distinct()
        return self._dealt(bundles, bundles.count()).mapInArrow(tidy(_reader(self.folder, payloads)), RECORDS)

    @staticmethod
    def _dealt(rows: DataFrame, bundles: int) -> DataFrame:
        """As many partitions as bundles.  By a hash, as Spark takes rows that are already grouped by ``bundle``
        for dealt, and would make one task of so few."""
        return rows.repartition(max(bundles, 1), F.xxhash64("bundle"))

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """The records of the pages in ``wanted`` (page_id): their frames alone are read, each once."""
        places = self.index.join(wanted.select("page_id").distinct().hint("merge"), "page_id", "left_semi")
        frames = places.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
        frames = written(frames)
        dealt = self._dealt(frames, frames.select("bundle").distinct().count()).sortWithinPartitions("bundle", "frame")
        return dealt.mapInArrow(tidy(_reader(self.folder)), RECORDS)

    def resolved(self, wanted: DataFrame) -> DataFrame:
        """Page id and payload of the pages in ``wanted``: a revisit has that of the page it refers to."""
        found = self.fetch(wanted).select("page_id", "refers_to", "payload")
        far = found.where("refers_to IS NOT NULL").select("page_id", "refers_to")
        others = self.fetch(far.select(F.col("refers_to").alias("page_id"))).select(F.col("page_id").alias("refers_to"), "payload").dropDuplicates(["refers_to"])
        return found.where("refers_to IS NULL").select("page_id", "payload").unionByName(far.join(others.hint("merge"), "refers_to").select("page_id", "payload"))


def first_pages(pages: DataFrame) -> DataFrame:
    """Of each payload that more than one page has: its SHA-1 and the least page id."""
    found = pages.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return found.where("n > 1").select("sha1", "first")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", folder: str | None = None, frame: int = FRAME, bundle: int = BUNDLE) -> Archive:
    """Writes ``pages`` to bundles in ``folder`` (one of the shared folder if none is named)."""
    spark = pages.sparkSession
    folder = (folder or f"{shared_dir(spark)}/lumigrid-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}").rstrip("/")
    store, path = _filesystem(folder)
    store.create_dir(f"{path}/bundles")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    firsts = written(first_pages(rows.select("page_id", "sha1")))
    rows = rows.join(firsts.hint("merge"), "sha1", "left").select("page_id", "url", "html", "first")
    rows.mapInArrow(tidy(_writer(folder, date, frame, bundle)), INDEX).write.parquet(f"{folder}/index")
    return Archive(spark, folder)


class _Bundle:
    """A bundle that is being written; ``rows`` are those of the index."""

    def __init__(self, store: pyarrow.fs.FileSystem, path: str):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = store.open_output_stream(f"{path}/bundles/{self.name}", compression=None)
        self.packer, self.frames, self.plain, self.rows, self.size, self.packed = zstandard.ZstdCompressor(level=3), [], [], [], 0, 0

    def add(self, page_id: int | None, data: bytes, frame: int) -> None:
        if self.size and self.size + len(data) > frame:
            self.flush()
        self.rows.append((record_id(page_id), page_id, self.name, len(self.frames), self.size, len(data)))
        self.plain.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.size:
            done = self.packer.compress(b"".join(self.plain))
            self.file.write(done)
            self.frames.append((len(done), self.size))
            self.packed += self.size
            self.plain, self.size = [], 0

    def closed(self) -> pa.RecordBatch:
        self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], [c.split()[0] for c in INDEX.split(", ")])


def _writer(folder: str, date: str, frame: int, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        now = None
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(k) for k in range(4))):
                now = now or _Bundle(store, path)
                payload = html.as_buffer().to_pybytes()
                now.add(page_id.as_py(), record(page_id.as_py(), url.as_py(), payload, first.as_py(), date), frame)
                if now.packed + now.size >= size:
                    yield now.closed()
                    now = None
        if now:
            yield now.closed()

    return write


def _reader(folder: str, payloads: bool = True):
    """Rows (bundle), or (bundle, frame, offsets of the records that are wanted), to records."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        unpacker, name, file, table = zstandard.ZstdDecompressor(), None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name = row["bundle"]
                    file = store.open_input_file(f"{path}/bundles/{name}")
                    table = frames_of(file, file.size())
                only = set(row["offsets"]) if "offsets" in row else None
                for k in [row["frame"]] if only else range(len(table)):
                    start, packed, size = table[k]
                    plain = unpacker.decompress(file.read_at(packed, start), max_output_size=size)
                    yield _records(plain, name, k, only, payloads)

    return read


def _records(plain: bytes, bundle: str, frame: int, only: set[int] | None, payloads: bool) -> pa.RecordBatch:
    rows = []
    for offset, length, head, block in parsed(plain):
        if only is not None and offset not in only:
            continue
        http, _, payload = bytes(block).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{head['warc-record-id']} is damaged")
        to = page_of(head["warc-refers-to"]) if revisit else None
        rows.append((head["warc-record-id"], page_of(head["warc-record-id"]), head["warc-type"], to, n, digest, payload if payloads and not revisit else None, bundle, frame, offset, length))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RECORDS.split(", ")])
