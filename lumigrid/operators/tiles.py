"""Tiles with a rim: windows over an image without a join.

A pixel goes once to the tile that owns it and once more to each tile that it lies within
``halo`` rows and columns of, so with tiles of ``side`` pixels some (1 + 2 halo / side)^2 rows
are shuffled for each pixel, however wide the window is.  A tile is a task's unit, so an image of any size
takes bounded memory; in it the window is a slice of a numpy array for each offset, or
two sums along the axes where the window is a plain box.

Pixels that an image lacks are left out of windows.  With ``clamp`` an image repeats its last
pixels beyond its border; the border is that of the pixels there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SIDE = 128


def dealt(df: DataFrame, columns: list[str], halo: int, side: int = SIDE) -> DataFrame:
    """(tile_row, tile_col, own, image_id, pid, row, col, columns): each pixel for all tiles that need it."""
    names = list(dict.fromkeys(["image_id", "pid", "row", "col", *columns]))
    tile = lambda c, by: F.floor((F.col(c) - 1 + by) / F.lit(side)).cast("int")
    reach = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), tile(c, -halo)), F.greatest(F.lit(0), tile(c, halo))))
    out = df.select(*names).select("*", reach("row").alias("tile_row")).select("*", reach("col").alias("tile_col"))
    return out.withColumn("own", (F.col("tile_row") == tile("row", 0)) & (F.col("tile_col") == tile("col", 0)))


class Tile:
    """A tile's pixels as arrays; ``near`` gives what stands at an offset from each place of its core."""

    def __init__(self, table: pa.Table, halo: int, clamp: bool = False):
        self.table, self.halo, self.clamp = table, halo, clamp
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        self.own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
        first, last = (np.array([f(row), f(col)]) for f in (np.min, np.max))
        self.shape, self._at = last - first + 1, (row - first[0], col - first[1])
        low, high = (np.array([f(row[self.own]), f(col[self.own])]) for f in (np.min, np.max))
        self.low, self.size = low - first, high - low + 1
        self._out = (row[self.own] - low[0], col[self.own] - low[1])
        self.row, self.col = np.ogrid[low[0] : high[0] + 1, low[1] : high[1] + 1]
        self.there = self._padded(np.ones(len(row), bool), False)

    @classmethod
    def whole(cls, image: pd.DataFrame, columns: list[str], halo: int, clamp: bool = False) -> Tile:
        """An image as one tile."""
        table = pa.Table.from_pandas(image[list(dict.fromkeys(["row", "col", *columns]))], preserve_index=False)
        return cls(table.append_column("own", pa.array(np.ones(len(image), bool))), halo, clamp)

    def _padded(self, values: np.ndarray, fill: object) -> np.ndarray:
        out = np.full(self.shape, fill, values.dtype)
        out[self._at] = values
        return np.pad(out, self.halo, mode="edge") if self.clamp else np.pad(out, self.halo, constant_values=fill)

    def grid(self, name: str) -> np.ndarray:
        """A column as an array with its rim; 0 where no pixel is, which ``there`` tells."""
        values = self.table.column(name).to_numpy()
        return self._padded(values, values.dtype.type(0))

    def near(self, grid: np.ndarray, dr: int = 0, dc: int = 0) -> np.ndarray:
        r, c = self.low + self.halo + (dr, dc)
        return grid[r : r + self.size[0], c : c + self.size[1]]

    def box(self, grid: np.ndarray, w: int) -> np.ndarray:
        """Sums over the box of 2 w + 1 rows and columns around each place of the core, one axis after the other."""
        (r, c), (h, b) = self.low + self.halo, self.size
        rows = sum(grid[r + d : r + d + h] for d in range(-w, w + 1))
        return sum(rows[:, c + d : c + d + b] for d in range(-w, w + 1))

    def of(self, core: np.ndarray) -> np.ndarray:
        """Values of an array of the core for the tile's own pixels, in the order of the table."""
        return np.broadcast_to(core, self.size)[self._out]

    def rows(self, name: str) -> pa.ChunkedArray:
        return self.table.column(name).take(pa.array(self.own))


def by_tile(df: DataFrame, columns: list[str], halo: int, kernel: Callable[[Tile], dict], schema: str, clamp: bool = False, side: int = SIDE) -> DataFrame:
    """What ``kernel`` makes of each tile: columns of ``schema`` after the image_id."""
    schema = f"image_id long, {schema}"
    shape = to_arrow_schema(T._parse_datatype_string(schema))
    names = shape.names

    def run(table: pa.Table) -> pa.Table:
        found = kernel(Tile(table, halo, clamp)) if pa.compute.any(table.column("own")).as_py() else {n: [] for n in names[1:]}
        image, n = table.column("image_id")[0].as_py(), len(found[names[1]])
        columns = [pa.array(np.full(n, image), pa.int64()), *(found[k] for k in names[1:])]
        return pa.table([c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    return dealt(df, columns, halo, side).groupBy("image_id", "tile_row", "tile_col").applyInArrow(run, schema)


def stencil(df: DataFrame, columns: list[str], halo: int, kernel: Callable[[Tile], dict[str, np.ndarray]], schema: str, clamp: bool = False, side: int = SIDE) -> DataFrame:
    """A row for each pixel: (image_id, pid, schema).  ``kernel`` gives arrays of the core, and may give a mask
    ``keep`` of those to return."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def rows(t: Tile) -> dict:
        found = kernel(t)
        keep = np.flatnonzero(t.of(found["keep"])) if "keep" in found else np.arange(len(t.own))
        return {"pid": t.rows("pid").take(pa.array(keep)), **{n: t.of(found[n])[keep] for n in names}}

    return by_tile(df, columns, halo, rows, f"pid long, {schema}", clamp, side)


def added(found: DataFrame) -> DataFrame:
    """Rows of a stencil that share a pid, added up: pixels of one pid are one, and its window is those of all its places."""
    return found.groupBy("image_id", "pid").agg(*[F.sum(c).alias(c) for c in found.columns if c not in ("image_id", "pid")])


def neighbours(df: DataFrame, offsets: list[tuple[int, int]], columns: list[str], clamp: bool = False, side: int = SIDE) -> DataFrame:
    """(image_id, pid, dr, dc, own columns as o_*, row, col, n_pid and columns of the neighbour)."""
    halo = max(max(abs(r), abs(c)) for r, c in offsets)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in columns}
    schema = "pid long, dr int, dc int, " + "".join(f"o_{c} {kinds[c]}, " for c in columns) + "row int, col int, n_pid long" + "".join(f", {c} {kinds[c]}" for c in columns)

    def pairs(t: Tile) -> dict:
        place = t._padded(np.arange(t.table.num_rows), -1)
        ours, others, dr, dc = [], [], [], []
        for r, c in offsets:
            other = t.of(t.near(place, r, c))
            met = np.flatnonzero(other >= 0)
            ours.append(t.own[met])
            others.append(other[met])
            dr.append(np.full(len(met), r))
            dc.append(np.full(len(met), c))
        one, two = (t.table.take(pa.array(np.concatenate(x))) for x in (ours, others))
        found = {"pid": one.column("pid"), "dr": np.concatenate(dr), "dc": np.concatenate(dc), **{f"o_{c}": one.column(c) for c in columns}}
        return found | {"row": two.column("row"), "col": two.column("col"), "n_pid": two.column("pid"), **{c: two.column(c) for c in columns}}

    return by_tile(df, columns, halo, pairs, schema, clamp, side)
