"""Regions of a labelling: summaries, adjacency, components, pruning and merging."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.functions.distributions import Watson
from lumigrid.model import COLOUR, NORMAL, POSITION, MergeConfig
from lumigrid.operators import grid
from lumigrid.operators.projections import watson_statistic
from lumigrid.operators.tiles import Tile
from lumigrid.sources.shared import written


def summary(df: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Per label: pixels, mean colour and position, and the direction of the summed normals."""
    sums = [F.avg(c).alias(f"m{c}") for c in (*COLOUR, *POSITION)] + [F.sum(n).alias(f"_{n}") for n in NORMAL]
    out = df.groupBy(*by, "label").agg(F.count("*").alias("cnt"), *sums)
    length = F.sqrt(sum((F.col(f"_{n}") * F.col(f"_{n}") for n in NORMAL), F.lit(0.0)))
    return out.select(*by, "label", "cnt", *[f"m{c}" for c in (*COLOUR, *POSITION)], *[(F.col(f"_{n}") / F.when(length != 0, length)).alias(f"m{n}") for n in NORMAL])


def areas(df: DataFrame) -> DataFrame:
    """Per label its pixels and its share of the image."""
    out = df.groupBy("image_id", "label").agg(F.count("*").alias("cnt"))
    return out.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("image_id")))


def labels(df: DataFrame) -> DataFrame:
    return df.select("image_id", "label").distinct()


def adjacency(df: DataFrame) -> DataFrame:
    """Pairs of labels that touch, with the number of 8-connected edges between them."""
    e = grid.edges(df, ["label"]).where("o_label != label")
    pair = e.select("image_id", F.least("o_label", "label").alias("a"), F.greatest("o_label", "label").alias("b"))
    return pair.groupBy("image_id", "a", "b").agg(F.count("*").alias("n_edges"))


def boundary_strength(df: DataFrame, gradient: DataFrame) -> DataFrame:
    """Per pair of labels the mean gradient over the pixels that both boundaries hold."""
    b = grid.boundaries(df)
    left = b.select("image_id", "pid", F.col("label").alias("a"))
    right = b.select("image_id", "pid", F.col("label").alias("b"))
    both = left.join(right, ["image_id", "pid"]).where("a < b").join(gradient.select("image_id", "pid", "mog"), ["image_id", "pid"])
    return both.groupBy("image_id", "a", "b").agg(F.avg("mog").alias("wb"), F.count("*").alias("n"))


def watson_of_regions(df: DataFrame) -> DataFrame:
    t = watson_statistic(*[F.col(n) for n in NORMAL])
    return df.groupBy("image_id", "label").agg(*[F.avg(x).alias(f"t{i + 1}") for i, x in enumerate(t)], F.count("*").alias("cnt"))


def covariances(df: DataFrame, names: tuple[str, ...] = COLOUR) -> DataFrame:
    """Per label the sample covariances of the named columns, as a_b for a not after b."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy("image_id", "label").agg(*[F.covar_samp(a, b).alias(f"{a}_{b}") for a, b in pairs])


def components(df: DataFrame, label: str = "label") -> DataFrame:
    """4-connected components of equal labels, numbered by first pixel; one image per task."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values("pid")
        return pd.DataFrame({"image_id": image["image_id"], "pid": image["pid"], "label": renumbered(flooded(*as_grid(image, label)))})

    return df.select("image_id", "pid", "row", "col", label).groupBy("image_id").applyInPandas(run, "image_id long, pid long, label int")


def as_grid(image: pd.DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pixels and, of the 4-connected edges with equal labels, both ends."""
    h, w = int(image["row"].max()), int(image["col"].max())
    at = np.full((h, w), -1)
    r, c = image["row"].to_numpy() - 1, image["col"].to_numpy() - 1
    at[r, c] = np.arange(len(image))
    v = image[label].to_numpy()
    pairs = np.concatenate([np.stack([at[:-1].ravel(), at[1:].ravel()]), np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()])], axis=1)
    pairs = pairs[:, (pairs >= 0).all(axis=0)]
    same = v[pairs[0]] == v[pairs[1]]
    return np.arange(len(image)), pairs[0][same], pairs[1][same], at


def flooded(own: np.ndarray, a: np.ndarray, b: np.ndarray, *_) -> np.ndarray:
    """Least place of each component, by spreading least labels with pointer jumping."""
    up = own.copy()
    while len(a):
        x, y = up[a], up[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        far = low != high
        if not far.any():
            break
        np.minimum.at(up, high[far], low[far])
        while (up != (nxt := up[up])).any():
            up = nxt
        a, b = a[far], b[far]
    return up


def renumbered(roots: np.ndarray) -> np.ndarray:
    """Labels 1.. by first appearance."""
    _, first, inverse = np.unique(roots, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(1, len(first) + 1)
    return rank[inverse]


def renumber(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels 1.. by the first pixel of each, as a plan: rank of the least pid."""
    first = df.groupBy("image_id", label).agg(F.min("pid").alias("_first"))
    rank = first.withColumn("_new", F.dense_rank().over(Window.partitionBy("image_id").orderBy("_first")).cast("int"))
    return df.join(rank, ["image_id", label]).select("image_id", "pid", F.col("_new").alias("label"))


def components_relational(df: DataFrame, label: str = "label") -> DataFrame:
    """The same components for one image too large for a task."""
    e = grid.edges(df, [label], ((1, 0), (0, 1))).where(f"o_{label} = {label}").select("image_id", "src", "dst")
    return renumber(linked(df.select("image_id", "pid").distinct(), e).withColumnRenamed("root", "label"))


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, pid, root): the least pid that a node is joined with by edges (src, dst).

    Each round sends every node to the first neighbour of its first neighbour, in an order by hash that is another
    one each time, and keeps the edges between different targets: so a long chain of ascending pids takes as many rounds as the
    logarithm of its length.  Rounds are written; the driver sees whether edges are left.
    """
    least, most = F.least("src", "dst"), F.greatest("src", "dst")
    e = written(edges.where("src <> dst").select("image_id", least.alias("src"), most.alias("dst")).distinct())
    root, turn = nodes.select("image_id", "pid", F.col("pid").alias("root")), 0
    while e.limit(1).count():
        turn += 1
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        both = e.unionByName(e.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = both.groupBy("image_id", F.col("src").alias("node")).agg(F.min(rank("dst")).alias("rank"), F.min_by("dst", rank("dst")).alias("to"))
        to = written(to.select("image_id", "node", F.when(rank("node") <= F.col("rank"), F.col("node")).otherwise(F.col("to")).alias("to")))
        far = to.select("image_id", F.col("node").alias("to"), F.col("to").alias("far"))
        to = written(to.join(far, ["image_id", "to"]).select("image_id", "node", F.col("far").alias("to")))
        found = root.join(to.withColumnRenamed("node", "root"), ["image_id", "root"], "left")
        root = written(found.select("image_id", "pid", F.coalesce("to", "root").alias("root")))
        for end in ("src", "dst"):
            e = e.join(to.select("image_id", F.col("node").alias(end), F.col("to").alias(f"_{end}")), ["image_id", end]).drop(end)
        e = e.withColumnsRenamed({"_src": "src", "_dst": "dst"}).where("src <> dst")
        e = written(e.select("image_id", least.alias("src"), most.alias("dst")).distinct())
    if not turn:
        return root
    first = root.groupBy("image_id", "root").agg(F.min("pid").alias("_first"))
    return root.join(first, ["image_id", "root"]).select("image_id", "pid", F.col("_first").alias("root"))


def prune_once(df: DataFrame, below: int = 350) -> DataFrame:
    """Each label under ``below`` pixels takes the touching label with most pixels (then the least)."""
    n = df.groupBy("image_id", "label").agg(F.count("*").alias("cnt"))
    pairs = adjacency(df).select("image_id", F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("near")), F.struct(F.col("b").alias("label"), F.col("a").alias("near")))).alias("p"))
    pairs = pairs.select("image_id", "p.*").join(n.select("image_id", F.col("label").alias("near"), F.col("cnt").alias("near_cnt")), ["image_id", "near"])
    best = pairs.groupBy("image_id", "label").agg(F.max_by("near", F.struct("near_cnt", -F.col("near"))).alias("into"))
    into = n.where(F.col("cnt") < below).join(best, ["image_id", "label"]).select("image_id", "label", "into")
    out = df.select("image_id", "pid", "row", "col", "label").join(into, ["image_id", "label"], "left")
    return out.select("image_id", "pid", "row", "col", F.coalesce("into", "label").alias("label"))


def prune_map(size: dict[int, int], near: dict[int, set[int]], below: int, delete: Callable[[int], bool] | None = None, replace: Callable[[int, int], float] | None = None) -> dict[int, int]:
    """The label that each region ends with: smallest regions first, each into its neighbour with most pixels, until none is too small.

    ``delete`` says by its pixels whether a region goes, ``replace`` gives the cost, by the pixels of both, of
    taking a neighbour's label: the one of least cost, then of least number, is taken.
    """
    size, near, end = dict(size), {k: set(x) for k, x in near.items()}, {k: k for k in size}
    delete, replace = delete or (lambda n: n < below), replace or (lambda n, m: -m)
    while True:
        small = sorted((n, k) for k, n in size.items() if delete(n) and near.get(k))
        if not small:
            break
        into: dict[int, int] = {}
        taken: set[int] = set()
        for _, k in small:
            if k not in taken:
                best = min(near[k], key=lambda m: (replace(size[k], size[m]), m))
                if best not in into:
                    into[k] = best
                    taken.add(best)
        for k, m in into.items():
            end[k] = m
            size[m] += size.pop(k)
            for x in near.pop(k):
                near[x].discard(k)
                if x != m:
                    near[x].add(m)
                    near[m].add(x)

    def last(k: int) -> int:
        while end[k] != k:
            k = end[k]
        return k

    return {k: last(k) for k in end}


def pruned(labels_: np.ndarray, pairs: np.ndarray, below: int, delete: Callable[[int], bool] | None = None, replace: Callable[[int, int], float] | None = None) -> np.ndarray:
    """The labels of pixels after ``prune_map``; ``pairs``: places of pixels that touch."""
    names, at, counts = np.unique(labels_, return_inverse=True, return_counts=True)
    x, y = labels_[pairs[0]], labels_[pairs[1]]
    near: dict[int, set[int]] = defaultdict(set)
    for a, b in np.unique(np.stack([x[x != y], y[x != y]], axis=1), axis=0).tolist():
        near[a].add(b)
        near[b].add(a)
    into = prune_map(dict(zip(names.tolist(), counts.tolist())), near, below, delete, replace)
    return np.array([into[k] for k in names.tolist()])[at]


def prune(df: DataFrame, below: int = 350, delete: Callable[[int], bool] | None = None, replace: Callable[[int, int], float] | None = None) -> DataFrame:
    """``df`` with the labels after ``prune_map``; a task gets an image's table of regions (4-connected), not its pixels."""
    n = df.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    e = grid.edges(df, ["label"], ((1, 0), (0, 1))).where("o_label <> label").select("image_id", F.col("o_label").alias("label"), F.col("label").alias("near"))
    both = e.unionByName(e.select("image_id", F.col("near").alias("label"), F.col("label").alias("near"))).groupBy("image_id", "label").agg(F.collect_set("near").alias("near"))

    def run(table: pa.Table) -> pa.Table:
        names, sizes, near = (table.column(c).to_pylist() for c in ("label", "n", "near"))
        into = prune_map(dict(zip(names, sizes)), {k: set(x or ()) for k, x in zip(names, near)}, below, delete, replace)
        return pa.table({"image_id": table.column("image_id"), "label": pa.array(names, pa.int32()), "into": pa.array([into[k] for k in names], pa.int32())})

    found = n.join(both, ["image_id", "label"], "left").groupBy("image_id").applyInArrow(run, "image_id long, label int, into int")
    return df.join(found, ["image_id", "label"]).select(*[F.col("into").alias("label") if c == "label" else c for c in df.columns])


class Graph:
    """A region adjacency graph whose vertices merge: data by ``merge``, edges by ``weigh``."""

    def __init__(self, weigh: Callable = lambda a, b: None, merge: Callable = lambda a, b: a):
        self.weigh, self.merge = weigh, merge
        self.data: dict[int, object] = {}
        self.near: dict[int, dict[int, object]] = {}

    def add(self, data: object = None, name: int | None = None) -> int:
        name = max(self.data, default=0) + 1 if name is None else name
        self.data[name], self.near[name] = data, {}
        return name

    def connect(self, a: int, b: int, weight: object = None) -> None:
        if a != b:
            weight = self.weigh(self.data[a], self.data[b]) if weight is None else weight
            self.near[a][b] = self.near[b][a] = weight

    def disconnect(self, a: int, b: int) -> None:
        self.near[a].pop(b, None)
        self.near[b].pop(a, None)

    def remove(self, a: int) -> None:
        for b in list(self.near[a]):
            self.disconnect(a, b)
        del self.near[a], self.data[a]

    def adjacent(self, a: int) -> list[int]:
        return sorted(self.near[a])

    def degree(self, a: int) -> int:
        return len(self.near[a])

    def vertices(self) -> list[int]:
        return sorted(self.data)

    def __contains__(self, a: int) -> bool:
        return a in self.data

    def __getitem__(self, a: int) -> object:
        return self.data[a]

    def contract(self, a: int, b: int) -> int:
        """Replaces two vertices by a new one with the neighbours of both."""
        others = (set(self.near[a]) | set(self.near[b])) - {a, b}
        new = self.add(self.merge(self.data[a], self.data[b]))
        self.remove(a)
        self.remove(b)
        for c in others:
            self.connect(new, c)
        return new


class Rims:
    """Boundaries of regions that merge.  A region's boundary is its dilation without its erosion,
    and that of two merged ones is the union of both.

    Pixels count by the set of regions whose boundaries hold them, as the number and sum of their
    values; so contraction adds up records and looks at no pixel.
    """

    def __init__(self) -> None:
        self.sets: dict[frozenset, list[float]] = {}
        self.of: dict[int, set[frozenset]] = defaultdict(set)
        self.edges: dict[int, dict[int, list[float]]] = defaultdict(dict)

    def add(self, regions: frozenset, total: float, n: float) -> None:
        """More pixels whose value adds up to ``total`` on the boundaries of just these regions."""
        self._put(regions, total, n)
        for a in regions:
            for b in regions:
                if a < b:
                    self._edge(a, b, total, n)

    def _put(self, regions: frozenset, total: float, n: float) -> None:
        found = self.sets.setdefault(regions, [0.0, 0])
        found[0] += total
        found[1] += n
        for a in regions:
            self.of[a].add(regions)

    def _edge(self, a: int, b: int, total: float, n: float) -> None:
        found = self.edges[a].setdefault(b, [0.0, 0])
        self.edges[b][a] = found
        found[0] += total
        found[1] += n

    def contract(self, a: int, b: int, new: int) -> None:
        """Puts ``new`` in place of both; a pixel on both boundaries counts once."""
        for regions in self.of[a] | self.of[b]:
            total, n = self.sets.pop(regions)
            for c in regions:
                self.of[c].discard(regions)
            others = regions - {a, b}
            self._put(others | {new}, total, n)
            for c in others:
                self._edge(new, c, total, n)
        for x in (a, b):
            for c in self.edges.pop(x, {}):
                self.edges[c].pop(x, None)
            self.of.pop(x, None)

    def mean(self, a: int, b: int) -> float:
        """Mean value on both boundaries; 1 if they share no pixel."""
        total, n = self.edges[a].get(b, (0.0, 0))
        return total / n if n else 1.0


def rims_of(t: Tile, values: np.ndarray) -> Rims:
    """The boundaries' records of a labelled image (column ``label``), with the values of its core."""
    label, found = t.grid("label"), Rims()
    near = np.stack([np.where(t.near(t.there, *o), t.near(label, *o), t.near(label)) for o in grid.window(1)])
    rim = t.near(t.there) & (near != near[0]).any(axis=0)
    sums: dict[frozenset, list[float]] = {}
    for names, value in zip(np.sort(near[:, rim], axis=0).T.tolist(), values[rim].tolist()):
        one = sums.setdefault(frozenset(names), [0.0, 0])
        one[0] += value
        one[1] += 1
    for names, (total, n) in sums.items():
        found.add(names, total, n)
    return found


def _regions(image: pd.DataFrame) -> dict[int, dict]:
    t = np.column_stack([image[n] for n in NORMAL])
    from lumigrid.functions.distributions import watson_statistic as statistic

    t, out = statistic(t), {}
    for k, rows in image.groupby("label").indices.items():
        out[int(k)] = {"n": len(rows), "eta": t[rows].mean(axis=0), "colour": image[list(COLOUR)].to_numpy()[rows].mean(axis=0), "rows": rows}
    return out


def _merged(a: dict, b: dict) -> dict:
    n = a["n"] + b["n"]
    return {"n": n, "eta": (a["eta"] * a["n"] + b["eta"] * b["n"]) / n, "colour": (a["colour"] + b["colour"]) / 2, "rows": np.concatenate([a["rows"], b["rows"]])}


def plane_share(points: np.ndarray, distance: float, seed: int, tries: int = 60) -> float:
    """Share of points within a distance of the best plane through three of them (seeded)."""
    if len(points) <= 3:
        return 0.0
    rng, best = np.random.default_rng(seed), 0.0
    for _ in range(tries):
        p = points[rng.choice(len(points), 3, replace=False)]
        n = np.cross(p[1] - p[0], p[2] - p[0])
        size = np.linalg.norm(n)
        if size > 0:
            best = max(best, float((np.abs((points - p[0]) @ (n / size)) <= distance).mean()))
    return best


def graph_of(image: pd.DataFrame) -> Graph:
    """The adjacency (8-connected) of an image's regions, whose data merge."""
    g = Graph(merge=_merged)
    for k, data in _regions(image).items():
        g.add(data, k)
    at = np.full((int(image["row"].max()), int(image["col"].max())), -1)
    at[image["row"] - 1, image["col"] - 1] = image["label"]
    for x, y in ((at[:-1], at[1:]), (at[:, :-1], at[:, 1:]), (at[:-1, :-1], at[1:, 1:]), (at[1:, :-1], at[:-1, 1:])):
        for a, b in np.unique(np.stack([x[x != y], y[x != y]], 1), axis=0).tolist():
            if a in g and b in g:
                g.connect(a, b, True)
    return g


def labels_of(g: Graph, n: int) -> np.ndarray:
    label = np.zeros(n, np.int64)
    for k in g.vertices():
        label[g[k]["rows"]] = k
    return renumbered(label)


def without_small(g: Graph, small_area: int, merged: Callable[[int, int, int], None] = lambda a, b, new: None) -> None:
    """Merges each region under an area into the neighbour of closest mean colour (the least of equal ones).

    A pass takes the regions that it starts with, smallest first; regions that it makes wait for the
    next one.  Passes go on while they merge.  A region without neighbours stays.
    """
    again = True
    while again:
        again = False
        for _, k in sorted((g[k]["n"], k) for k in g.vertices()):
            if k in g and g[k]["n"] < small_area and g.degree(k):
                into = min(g.adjacent(k), key=lambda m: (float(np.linalg.norm(g[m]["colour"] - g[k]["colour"])), m))
                merged(k, into, g.contract(k, into))
                again = True


def merge_regions(g: Graph, rims: Rims, points: np.ndarray, config: MergeConfig) -> None:
    """Small regions first; then the first region (by number) with a neighbour to merge with takes the closest one
    that is planar, not parted by a boundary and on one plane with it, again and again.

    Pairs wait in a queue by region, divergence and neighbour.  A pair is looked at once, as nothing
    that decides about it changes while both are there; pairs of regions that are gone are skipped.
    """
    without_small(g, config.small_area, rims.contract)
    fits: dict[int, Watson] = {}
    queue: list[tuple[int, float, int]] = []

    def enter(a: int, b: int) -> None:
        wa, wb = fits[a], fits[b]
        if wa.kappa > config.kappa and wb.kappa > config.kappa:
            wd = min(wa.divergence(wb), wb.divergence(wa))
            if wd < config.thd and rims.mean(a, b) < config.thb:
                heapq.heappush(queue, (a, wd, b))
                heapq.heappush(queue, (b, wd, a))

    for k in g.vertices():
        fits[k] = Watson(g[k]["eta"])
    for k in g.vertices():
        for m in g.adjacent(k):
            if k < m:
                enter(k, m)
    while queue:
        a, _, b = heapq.heappop(queue)
        if a in g and b in g and plane_share(points[np.sort(np.concatenate([g[a]["rows"], g[b]["rows"]]))], config.distance, config.seed) > config.inliers:
            new = g.contract(a, b)
            rims.contract(a, b, new)
            fits[new] = Watson(g[new]["eta"])
            for c in g.adjacent(new):
                enter(new, c)


def planar_labels(image: pd.DataFrame, config: MergeConfig = MergeConfig()) -> np.ndarray:
    """Labels of a labelled image (rows by pid) after merging its planar regions."""
    names = ["c1", "c2", "c3", "z"]
    t = Tile.whole(image, [*names, "label"], 1, clamp=True)
    mog = grid.gradients_of(t, names)["mog"]
    top = float(t.of(mog).max())
    g, inner = graph_of(image), Tile.whole(image, ["label"], 1)
    merge_regions(g, rims_of(inner, mog / top if top > 0 else np.zeros_like(mog)), image[list(POSITION)].to_numpy(), config)
    return labels_of(g, len(image))


def _by_image(df: DataFrame, act: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    def run(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values("pid").reset_index(drop=True)
        return pd.DataFrame({"image_id": image["image_id"], "pid": image["pid"], "label": act(image)})

    return df.groupBy("image_id").applyInPandas(run, "image_id long, pid long, label int")


def remove_small(df: DataFrame, small_area: int = 1000) -> DataFrame:
    """Regions under an area go into the touching region of closest mean colour: see ``without_small``."""

    def act(image: pd.DataFrame) -> np.ndarray:
        g = graph_of(image)
        without_small(g, small_area)
        return labels_of(g, len(image))

    return _by_image(df, act)


def merge_planar(df: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """Greedy merging of planar regions with like normals and weak boundaries: see ``merge_regions``."""
    return _by_image(df, lambda image: planar_labels(image, config))


def merged_boundaries(df: DataFrame, value: str, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(image_id, a, b, n, total): pixels on the boundaries of both regions, and the sum of a value there, after
    the contractions (a, b, new) of labels that the image has."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values("pid").reset_index(drop=True)
        t = Tile.whole(image, ["label", value], 1)
        rims, have = rims_of(t, t.near(t.grid(value))), set(image["label"])
        for a, b, new in merges:
            if a in have and b in have:
                rims.contract(a, b, new)
                have = (have - {a, b}) | {new}
        rows = [(image["image_id"].iloc[0], a, b, int(n), total) for a in rims.edges for b, (total, n) in rims.edges[a].items() if a < b]
        return pd.DataFrame(rows, columns=["image_id", "a", "b", "n", "total"])

    return df.groupBy("image_id").applyInPandas(run, "image_id long, a int, b int, n long, total double")


def consistent(points: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """Per region the share of points on its best plane and whether it passes as a plane."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        share = plane_share(part.sort_values("pid")[list(POSITION)].to_numpy(), config.distance, config.seed)
        return pd.DataFrame({"image_id": [part["image_id"].iloc[0]], "label": [part["label"].iloc[0]], "share": [share], "planar": [share > config.inliers]})

    return points.groupBy("image_id", "label").applyInPandas(run, "image_id long, label int, share double, planar boolean")
