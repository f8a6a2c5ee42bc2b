"""Image files as a data source: ``spark.read.format("scene_images").load(folder)``.

A folder has a FITS file for each image, of three parts: colours, positions, labels; an image that lacks pixels has a
fourth, its pids.  Files are dealt to
partitions by their size when a query is planned; conditions on ``image_id`` leave out files before
any is opened, and a part of which no column is read is not read either (name the columns by
``.schema(..)``, as Spark gives Python sources no list of columns).  ``saved`` writes such a folder:
an image that is there already is left as it is, and a file appears whole or not at all.

``registered`` makes the source known to a session and switches its pushed conditions on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumigrid.model import COLOUR, NORMAL, PIXELS, POSITION
from lumigrid.sources.dataset import BLOCK, NONE, TYPES, fits_bytes, image_parts, pids

#: Bytes of files in a partition, about.
BYTES = 1 << 27
#: The part that each column lies in, and its plane there.
PARTS = {**{c: (0, k) for k, c in enumerate(COLOUR)}, **{c: (1, k) for k, c in enumerate(POSITION)}, "label": (2, None)}
_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that a path names, as seen from a task, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path) if ":" in path else f"file://{path}")


def file_of(image: int) -> str:
    return f"image_nyu_v2_{image}.fits"


@dataclass
class Files(InputPartition):
    files: list[tuple[int, str]]


def part_heads(file: pa.NativeFile) -> Iterator[tuple[int, tuple[int, ...], np.dtype, float, float]]:
    """Start, shape, type, scale and zero of each image part of a FITS file, read by its heads alone."""
    at, size = 0, file.size()
    while at < size:
        cards, more = {}, True
        while more and at < size:
            block = file.read_at(BLOCK, at).decode("ascii", "replace")
            at += BLOCK
            for card in (block[k : k + 80] for k in range(0, len(block), 80)):
                if card.startswith("END "):
                    more = False
                    break
                if card[8:10] == "= ":
                    cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
        shape = tuple(int(cards[f"NAXIS{i}"]) for i in range(int(cards.get("NAXIS", "0")), 0, -1))
        if shape:
            kind = np.dtype(TYPES[int(cards["BITPIX"])])
            yield at, shape, kind, float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0))
            at += -(-int(np.prod(shape)) * kind.itemsize // BLOCK) * BLOCK


class ImageReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path, self.tests = schema, path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("image_id",):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = filesystem(self.path)
        found = [(int(m[1]), x.path, x.size) for x in store.get_file_info(pyarrow.fs.FileSelector(path)) if (m := re.search(r"_(\d+)\.fits$", x.path))]
        out, held = [Files([])], 0
        for image, name, size in sorted(f for f in found if all(_TESTS[type(t)](f[0], t.value) for t in self.tests)):
            if held and held + size > BYTES:
                out.append(Files([]))
                held = 0
            out[-1].files.append((image, name))
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        shape, names = to_arrow_schema(self.schema), self.schema.names
        for image, name in partition.files:
            with store.open_input_file(name) as file:
                yield from self._rows(image, file, names, shape)

    @staticmethod
    def _rows(image: int, file: pa.NativeFile, names: list[str], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
        heads = list(part_heads(file))
        h, w = heads[0][1][-2:]
        parts = {}
        for k in {PARTS[c][0] for c in names if c in PARTS}:
            at, size, kind, scale, zero = heads[k]
            values = np.frombuffer(file.read_at(int(np.prod(size)) * kind.itemsize, at), kind).reshape(size)
            values = values * scale + zero if (scale, zero) != (1.0, 0.0) else values
            parts[k] = values / 255 if k == 0 and kind == np.dtype(">u1") else values
        r, c = np.mgrid[1 : h + 1, 1 : w + 1]
        own = pids(h, w)
        if len(heads) > 3 and heads[3][2] == np.dtype(">i8"):
            at, size, kind, _, _ = heads[3]
            own = np.frombuffer(file.read_at(h * w * kind.itemsize, at), kind).reshape(size)
        columns = {"image_id": np.full(h * w, image), "pid": own.ravel(), "row": r.ravel(), "col": c.ravel(), **{n: np.zeros(h * w) for n in NORMAL}}
        for n in names:
            if n in PARTS:
                k, plane = PARTS[n]
                columns[n] = (parts[k] if plane is None else parts[k][plane]).ravel()
        there = own.ravel() != NONE
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][there].astype(columns[f.name].dtype.newbyteorder("="))).cast(f.type) for f in shape], schema=shape)


@dataclass
class Written(WriterCommitMessage):
    files: int


class ImageWriter(DataSourceWriter):
    """Writes rows (image_id, content), each into a file of its own."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        store, path = filesystem(self.path)
        store.create_dir(path)
        n = 0
        for row in rows:
            name = f"{path}/{file_of(row['image_id'])}"
            if store.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
                part = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(row["content"])
                store.move(part, name)
                n += 1
        return Written(n)


class SceneImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_images"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        if overwrite:
            raise ValueError("files that are there are kept: use mode append")
        return ImageWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneImages)
    return spark


def saved(df: DataFrame, folder: str) -> None:
    """Writes the images that the folder lacks."""

    def content(table: pa.Table) -> pa.Table:
        planes = {c: table.column(c).to_numpy() for c in ("row", "col", "pid", *PARTS)}
        parts = image_parts(planes["row"], planes["col"], planes["pid"], planes, (COLOUR, POSITION, "label"))
        return pa.table({"image_id": table.column("image_id")[:1], "content": pa.array([fits_bytes(parts)], pa.binary())})

    files = df.select("image_id", "row", "col", "pid", *PARTS).groupBy("image_id").applyInArrow(content, "image_id long, content binary")
    registered(df.sparkSession)
    files.write.format("scene_images").mode("append").save(folder)


def images(spark: SparkSession, folder: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Pixels of a folder's images; of the named columns alone, if there are some."""
    kinds = dict(c.split() for c in PIXELS.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return registered(spark).read.format("scene_images").schema(schema).load(folder)
