"""Edge-ordered graph merging of images that no task can hold, with the result of the one sequence.

``merged_graph`` takes all edges of an image in order, and what an edge does depends on the
components that earlier edges made.  Here an image is dealt to tiles.  A tile takes its edges in
order, those that leave it too.  An edge between two components that no edge across
the rim has met is decided there and then, exactly, as all earlier edges of both were.  A component that meets
an edge across the rim is frozen as it is; an inner edge that meets a frozen component
freezes the other as well, and is put off.  So when a tile is done, each component has the state that
it has in the one sequence just before the first edge that was put off or leaves, and what is
left is a smaller graph: components, and the edges put off and across.  Four tiles
become one and it goes on, until nothing leaves.  Small components are merged by a
second sequence over all edges between what the first one left, in the same way.

Which of two roots stays, and so which stale size, follows from ranks, which go along with the components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.model import GraphConfig
from lumigrid.operators import regions
from lumigrid.sources.shared import written

SIDE = 256
#: Rows of a tile: vertices (a with rank, size and limits w1..w3), edges within (a, b) and edges that leave (a).
VERTEX, INNER, LEAVING, NAMED = 0, 1, 2, 3
ROWS = "image_id long, tile_row int, tile_col int, kind int, a long, b long, src long, dst long, w1 double, w2 double, w3 double, rank int, size long"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: ``rule(w, limits, sizes)`` says whether to merge two components; ``joined`` gives size and limits of both.
Rule = Callable[[tuple, tuple, tuple], bool]


class Sequence:
    """Components of a tile while it takes its edges in order."""

    def __init__(self, rank: list[int], size: list[int], limits: list[tuple], config: GraphConfig, small: bool):
        self.up, self.rank, self.size, self.limits = list(range(len(rank))), rank, size, limits
        self.frozen = [False] * len(rank)
        self.config, self.small = config, small

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def meets(self, a: int, b: int, w: tuple) -> bool:
        """Takes an inner edge; whether it is put off."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if self.frozen[a] or self.frozen[b]:
            self.frozen[a] = self.frozen[b] = True
            return True
        size, limits = self.size, self.limits
        both = size[a] + size[b]
        if self.small:
            if size[a] < self.config.min_size or size[b] < self.config.min_size:
                root = self._union(a, b)
                if self.config.update_sizes:
                    size[root] = both
        elif all(x <= p and x <= q for x, p, q in zip(w, limits[a], limits[b])):
            root = self._union(a, b)
            size[root], limits[root] = both, tuple(x + self.config.scale_k / both for x in w)
        return False

    def leaves(self, a: int) -> None:
        self.frozen[self.root(a)] = True

    def _union(self, a: int, b: int) -> int:
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.up[b] = a
        self.rank[a] += self.rank[a] == self.rank[b]
        return a


def tile_merged(table: pa.Table, config: GraphConfig, small: bool) -> pa.Table:
    """A tile's vertices and edges after its sequence: new vertices, the edges put off, and the new name of each old vertex."""
    kind = table.column("kind").to_numpy()
    column = lambda name, some: table.column(name).to_numpy(zero_copy_only=False)[some]
    v = np.flatnonzero(kind == VERTEX)
    v = v[np.argsort(column("a", v))]
    names = column("a", v).astype(np.int64)
    w = lambda some: list(zip(*(column(c, some).tolist() for c in ("w1", "w2", "w3"))))
    s = Sequence(column("rank", v).astype(int).tolist(), column("size", v).astype(int).tolist(), w(v), config, small)
    e = np.flatnonzero(kind != VERTEX)
    e = e[np.lexsort((column("dst", e), column("src", e), column("w1", e)))]
    a = np.searchsorted(names, column("a", e)).tolist()
    inner = kind[e] == INNER
    b = np.searchsorted(names, np.where(inner, column("b", e), names[0] if len(names) else 0).astype(np.int64)).tolist()
    off = []
    for k, (i, j, edge, within) in enumerate(zip(a, b, w(e), inner.tolist())):
        if not within:
            s.leaves(i)
        elif s.meets(i, j, edge):
            off.append(k)
    roots = np.array([s.root(i) for i in range(len(names))], np.int64)
    own = np.flatnonzero(roots == np.arange(len(names)))
    limits, put = np.array([s.limits[i] for i in own]).reshape(-1, 3), e[off]
    ends = [np.array([s.root(x[k]) for k in off], np.int64) for x in (a, b)]
    parts = [
        {"kind": np.full(len(own), VERTEX), "a": names[own], "w1": limits[:, 0], "w2": limits[:, 1], "w3": limits[:, 2], "rank": np.array(s.rank, int)[own], "size": np.array(s.size, int)[own]},
        {"kind": np.full(len(put), INNER), "a": names[ends[0]], "b": names[ends[1]], **{c: column(c, put) for c in ("src", "dst", "w1", "w2", "w3")}},
        {"kind": np.full(len(names), NAMED), "a": names, "b": names[roots]},
    ]
    place = {c: table.column(c)[0].as_py() for c in _NAMES[:3]}
    kinds = {"w1": pa.float64(), "w2": pa.float64(), "w3": pa.float64(), "kind": pa.int32(), "tile_row": pa.int32(), "tile_col": pa.int32(), "rank": pa.int32()}
    out = []
    for p in parts:
        n = len(p["kind"])
        out.append(pa.table({c: pa.array(np.full(n, place[c]), kinds.get(c, pa.int64())) if c in place else pa.array(p[c]).cast(kinds.get(c, pa.int64())) if c in p else pa.nulls(n, kinds.get(c, pa.int64())) for c in _NAMES}))
    return pa.concat_tables(out)


def _rows(df: DataFrame, **given) -> DataFrame:
    have = set(df.columns)
    kinds = dict(c.split() for c in ROWS.split(", "))
    return df.select(*[(given[c] if c in given else F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in _NAMES])


def _sequence(vertices: DataFrame, edges: DataFrame, config: GraphConfig, small: bool) -> tuple[DataFrame, DataFrame]:
    """(image_id, vid, root) of all vertices, and the components' last states.  ``edges`` has the ends' tiles as ar, ac, br, bc."""
    named, edges = None, written(edges)
    while True:
        within = (F.col("ar") == F.col("br")) & (F.col("ac") == F.col("bc"))
        inner = _rows(edges.where(within), kind=F.lit(INNER), tile_row=F.col("ar"), tile_col=F.col("ac"))
        across = edges.where(~within)
        ends = [_rows(across, kind=F.lit(LEAVING), a=F.col(e), b=F.lit(None), tile_row=F.col(f"{e}r"), tile_col=F.col(f"{e}c")) for e in "ab"]
        rows = vertices.unionByName(inner).unionByName(ends[0]).unionByName(ends[1])
        found = written(rows.groupBy("image_id", "tile_row", "tile_col").applyInArrow(lambda t: tile_merged(t, config, small), ROWS))
        new = found.where(F.col("kind") == NAMED).select("image_id", F.col("a").alias("vid"), F.col("b").alias("root"))
        if named is None:
            named = new
        else:
            named = written(named.withColumnRenamed("root", "old").join(new.withColumnRenamed("vid", "old"), ["image_id", "old"]).select("image_id", "vid", "root"))
        if not across.limit(1).count():
            return named, found.where(F.col("kind") == VERTEX)
        for e in "ab":
            across = across.join(new.select("image_id", F.col("vid").alias(e), F.col("root").alias(f"_{e}")), ["image_id", e])
        across = across.drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})
        off = found.where(F.col("kind") == INNER).withColumns({f"{e}{x}": F.col(f"tile_{y}") for e in "ab" for x, y in (("r", "row"), ("c", "col"))})
        half = lambda df, names: df.withColumns({c: F.shiftright(c, 1) for c in names})
        edges = written(half(across.unionByName(off.select(across.columns)), ["ar", "ac", "br", "bc"]))
        vertices = half(found.where(F.col("kind") == VERTEX), ["tile_row", "tile_col"])


def spread_graph(df: DataFrame, edges: DataFrame, config: GraphConfig, side: int = SIDE) -> DataFrame:
    """Labels (image_id, pid, label) as ``merged_graph`` gives them, tile by tile."""
    tile = lambda c: F.expr(f"cast(({c} - 1) div {side} as int)")
    place = written(df.select("image_id", "pid", tile("row").alias("tile_row"), tile("col").alias("tile_col")))
    k = F.lit(float(config.scale_k))
    vertices = _rows(place, kind=F.lit(VERTEX), a=F.col("pid"), w1=k, w2=k, w3=k, rank=F.lit(0), size=F.lit(1))
    edges = written(edges.select("image_id", "src", "dst", F.col("w_rgb").alias("w1"), F.col("w_xyz").alias("w2"), F.col("w_n").alias("w3")))

    def placed(e: DataFrame, of: DataFrame) -> DataFrame:
        """Edges with the names and tiles of their ends, but for those within a component."""
        for name, end in (("a", "src"), ("b", "dst")):
            e = e.join(of.select("image_id", F.col("pid").alias(end), F.col("root").alias(name), F.col("tile_row").alias(f"{name}r"), F.col("tile_col").alias(f"{name}c")), ["image_id", end])
        return e.where("a <> b")

    named, states = _sequence(vertices, placed(edges, place.withColumn("root", F.col("pid"))), config, False)
    home = place.withColumnRenamed("pid", "root")
    of = written(named.withColumnRenamed("vid", "pid").join(home, ["image_id", "root"]))
    vertices = _rows(states.drop("tile_row", "tile_col").join(home.withColumnRenamed("root", "a"), ["image_id", "a"]))
    last, _ = _sequence(vertices, placed(edges, of), config, True)
    roots = of.select("image_id", "pid", F.col("root").alias("vid")).join(last, ["image_id", "vid"])
    return regions.renumber(written(roots.select("image_id", "pid", F.col("root").alias("label"))))
