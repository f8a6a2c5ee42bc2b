"""Image files: FITS with three parts, PNG of region colours, and the Parquet data set.

Readers take bytes from Spark's ``binaryFile`` source, so any store that Spark
reads will do.  The reader and writer of FITS cover uncompressed image parts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.model import PIXELS
from lumigrid.operators import grid, projections

#: Bytes of a block of the FITS format, and numpy types by its BITPIX.
BLOCK = 2880
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_parts(data: bytes) -> list[np.ndarray]:
    """Image parts of a FITS file, axes in C order."""
    out, at = [], 0
    while at < len(data):
        cards, more = {}, True
        while more and at < len(data):
            block = data[at : at + BLOCK].decode("ascii", "replace")
            at += BLOCK
            for k in range(0, len(block), 80):
                card = block[k : k + 80]
                if card.startswith("END "):
                    more = False
                    break
                if card[8:10] == "= ":
                    cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
        axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", "0")))]
        if not axes:
            continue
        kind = np.dtype(TYPES[int(cards["BITPIX"])])
        n = int(np.prod(axes)) * kind.itemsize
        part = np.frombuffer(data[at : at + n], kind).reshape(axes[::-1])
        scale, zero = float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0))
        out.append(part * scale + zero if (scale, zero) != (1.0, 0.0) else part)
        at += -(-n // BLOCK) * BLOCK
    return out


def fits_bytes(parts: list[np.ndarray]) -> bytes:
    out = b""
    for k, x in enumerate(parts):
        bits = next(b for b, t in TYPES.items() if np.dtype(t).kind == x.dtype.kind and np.dtype(t).itemsize == x.dtype.itemsize)
        first = "SIMPLE  =                    T" if k == 0 else "XTENSION= 'IMAGE   '"
        cards = [first, f"BITPIX  = {bits:>20}", f"NAXIS   = {x.ndim:>20}"] + [f"NAXIS{i + 1:<3}= {n:>20}" for i, n in enumerate(x.shape[::-1])]
        head = "".join(c.ljust(80) for c in [*cards, "END"]).encode()
        body = x.astype(TYPES[bits]).tobytes()
        out += head + b" " * (-len(head) % BLOCK) + body + b"\0" * (-len(body) % BLOCK)
    return out


#: In a part of pids, a place that has no pixel.
NONE = -(1 << 63)


def image_parts(row: np.ndarray, col: np.ndarray, pid: np.ndarray, planes: dict[str, np.ndarray], groups: tuple) -> list[np.ndarray]:
    """Arrays of an image's parts: a group of names is a part of as many planes, a name alone a part of one.  An image that lacks
    pixels, or whose pids are not those of its places, has its pids as a last part."""
    h, w = int(row.max()), int(col.max())

    def plane(values: np.ndarray, kind: type, fill: object = 0) -> np.ndarray:
        out = np.full((h, w), fill, kind)
        out[row - 1, col - 1] = values
        return out

    parts = [plane(planes[g], np.int32) if isinstance(g, str) else np.stack([plane(planes[c], np.float64) for c in g]) for g in groups]
    own = plane(pid, np.int64, NONE)
    return parts if (own == pids(h, w)).all() else [*parts, own]


def pids(h: int, w: int) -> np.ndarray:
    """The pids of the places of an image, column by column."""
    return np.arange(1, h * w + 1).reshape(w, h).T


def png_bytes(rgb: np.ndarray) -> bytes:
    """An 8-bit colour PNG of an array of rows, columns and three channels."""
    h, w = rgb.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def painted_png(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Per image a PNG of its regions' mean colours."""
    rows = projections.painted(df, regions).join(df.select("image_id", "pid", "row", "col"), ["image_id", "pid"])

    def draw(image: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((image["row"].max(), image["col"].max(), 3), np.uint8)
        rgb[image["row"] - 1, image["col"] - 1] = np.rint(np.clip(image[["p1", "p2", "p3"]].to_numpy(), 0, 1) * 255)
        return pd.DataFrame({"image_id": [image["image_id"].iloc[0]], "png": [png_bytes(rgb)]})

    return rows.groupBy("image_id").applyInPandas(draw, "image_id long, png binary")


def raw_file(path: str) -> str:
    return f"{path}/raw/nyu_depth_v2_labeled.mat"


def transformed_file(path: str, image: int) -> str:
    return f"{path}/transformed/image_nyu_v2_{image}.fits"


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (image_id from the file's number) of FITS files with colour, position and labels."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(path)
    files = files.select(F.regexp_extract("path", r"_([0-9]+)\.fits$", 1).cast("long").alias("image_id"), "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, content in zip(batch["image_id"], batch["content"]):
                rgb, xyz, labels, *own = fits_parts(content)
                h, w = labels.shape
                r, c = np.mgrid[1 : h + 1, 1 : w + 1]
                own = own[0].astype(np.int64) if own and own[0].dtype == np.dtype(">i8") else pids(h, w)
                out = {"image_id": image, "pid": own.ravel(), "row": r.ravel(), "col": c.ravel()}
                out |= {f"c{k + 1}": rgb[k].ravel().astype(float) / 255 for k in range(3)}
                out |= {n: xyz[k].ravel().astype(float) for k, n in enumerate(("x", "y", "z"))}
                out |= {n: 0.0 for n in ("nx", "ny", "nz")}
                yield pd.DataFrame(out | {"label": labels.ravel().astype(np.int32)})[own.ravel() != NONE]

    return files.mapInPandas(rows, PIXELS)


class Dataset:
    """Images as Parquet partitioned by image; normals, crop and label shift when an image is taken."""

    def __init__(self, spark: SparkSession, path: str, name: str = "NYU"):
        self.spark, self.path, self.name = spark, path, name

    def pixels(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def preprocess(self, source: DataFrame, n: int = 0) -> None:
        """Writes the images (the first ``n``, or all) that are not there yet."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            source = source.join(self.pixels().select("image_id").distinct(), "image_id", "left_anti")
        if n:
            first = source.select("image_id").distinct().orderBy("image_id").limit(n)
            source = source.join(first, "image_id", "left_semi")
        source.write.mode("append").partitionBy("image_id").parquet(self.path)

    def __len__(self) -> int:
        return self.pixels().select("image_id").distinct().count()

    def __getitem__(self, image: int) -> DataFrame:
        return self.images(F.col("image_id") == image)

    def images(self, condition=None, margin: int = 15, normals: bool = True, window: int = 3, relative: float = 0.01) -> DataFrame:
        """Pixels with normals of local planes, without the margin, labels from 1."""
        df = self.pixels() if condition is None else self.pixels().where(condition)
        if normals:
            found = grid.filled_normals_in_place(grid.planes(df, window, relative).select("image_id", "pid", "row", "col", "nx", "ny", "nz"), window)
            df = df.drop("nx", "ny", "nz").join(found.select("image_id", "pid", "nx", "ny", "nz"), ["image_id", "pid"])
        return projections.shifted_labels(projections.crop(df, margin))
