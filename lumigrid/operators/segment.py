"""Segmentation algorithms behind one call: ``segment(pixels, config)``.

An image that fits a task is segmented in it, start to end, and Spark runs as many images at once as
it has slots.  With ``spread`` images of any size are taken apart: graph merging by tiles,
mixtures and spectral clustering by blocks of pixels, turn by turn for all images at once.  Both give
the same labels, but for the last digits of sums.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.model import CHANNELS, COLOUR, NORMAL, POSITION, DiametricalConfig, GraphConfig, MixtureConfig, SpectralConfig, WatsonConfig
from lumigrid.operators import grid, iterated, merging, mixture, regions, spectral
from lumigrid.operators.projections import to_lab
from lumigrid.operators.spectral import disparity, gaussian, landmarks, nystrom  # noqa: F401
from lumigrid.operators.tiles import Tile

LABELS = "image_id long, pid long, label int"
ATTEMPTS = "image_id long, algorithm int, pid long, label int, elapsed double, error string"
#: By kind of parameters: labels of one image (rows by pid), and the plan for images of any size.
_IMAGE: dict[type, Callable[[pd.DataFrame, object], np.ndarray]] = {}
_SPREAD: dict[type, Callable[[DataFrame, object, int], DataFrame]] = {}


def _of_image(config: type) -> Callable:
    return lambda f: _IMAGE.setdefault(config, f)


def _spread(config: type) -> Callable:
    return lambda f: _SPREAD.setdefault(config, f)


def segment(df: DataFrame, config: object, spread: int = 0) -> DataFrame:
    """Labels (image_id, pid, label) of all images, from 1 by first pixel.

    ``spread``: 0 for an image a task, else the rows and columns of a tile, which are taken apart.
    """
    if type(config) not in _IMAGE:
        raise NotImplementedError(f"no algorithm for {type(config).__name__}")
    if isinstance(config, SpectralConfig):
        df = lab(df, config)
    if spread:
        return _by_place(df, lambda pixels: _SPREAD[type(config)](pixels, config, spread))
    if isinstance(config, GraphConfig) and config.weigh:
        return weighed_segments(df, config)
    act = _IMAGE[type(config)]
    return df.groupBy("image_id").applyInPandas(lambda image: _labelled(image, lambda rows: act(rows, config)), LABELS)


def _by_place(df: DataFrame, act: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Labels of pixels that go by their place while an image is taken apart, as several may share a pid."""
    height = df.groupBy("image_id").agg(F.max("row").alias("_h"))
    place = ((F.col("col") - 1) * F.col("_h") + F.col("row")).cast("long")
    rows = df.withColumnRenamed("pid", "_pid").join(height, "image_id").withColumn("pid", place).drop("_h")
    labels = act(rows.select(df.columns))
    return rows.select("image_id", "pid", "_pid").join(labels, ["image_id", "pid"]).select("image_id", F.col("_pid").alias("pid"), "label")


def timed(df: DataFrame, config: object, action: Callable[[DataFrame], object] = DataFrame.count) -> float:
    """Wall seconds of the segmentation alone."""
    began = time.perf_counter()
    action(segment(df, config))
    return time.perf_counter() - began


def attempted(df: DataFrame, configs: list[object], todo: DataFrame) -> DataFrame:
    """Segments images by several algorithms in one job: rows (image_id, algorithm, pid, label), and a row without pid for
    each attempt with its elapsed seconds, or with its error, which costs no other image.

    ``todo``: rows (image_id, algorithm), the place of the parameters in ``configs``.
    """
    missing = [type(c).__name__ for c in configs if type(c) not in _IMAGE]
    if missing:
        raise NotImplementedError(f"no algorithm for {missing[0]}")
    wanted = todo.groupBy("image_id").agg(F.sort_array(F.collect_set("algorithm")).alias("wanted"))

    def run(image: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for k in image["wanted"].iloc[0]:
            began = time.perf_counter()
            try:
                rows = lab_image(image, configs[k]) if isinstance(configs[k], SpectralConfig) else image
                labels = _labelled(rows, lambda x: _IMAGE[type(configs[k])](x, configs[k]))  # noqa: B023
                elapsed, error = time.perf_counter() - began, None
            except Exception as e:  # the batch goes on; the row says why
                labels, elapsed, error = None, None, f"{type(e).__name__}: {str(e)[:500]}"
            status = pd.DataFrame({"image_id": [image["image_id"].iloc[0]], "algorithm": [k], "pid": [None], "label": [None], "elapsed": [elapsed], "error": [error]})
            parts += [status] if labels is None else [status, labels.assign(algorithm=k, elapsed=None, error=None)]
        names = [c.split()[0] for c in ATTEMPTS.split(", ")]
        return pd.concat([p[names].astype({"pid": "Int64", "label": "Int32", "elapsed": "Float64", "error": object}) for p in parts])

    return df.join(wanted, "image_id").groupBy("image_id").applyInPandas(run, ATTEMPTS)


class _Sets:
    """Union by rank, as the order of roots matters where sizes are left stale."""

    def __init__(self, n: int):
        self.up, self.rank = list(range(n)), [0] * n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def union(self, a: int, b: int) -> int:
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.up[b] = a
        self.rank[a] += self.rank[a] == self.rank[b]
        return a


def merged_graph(n: int, edges: np.ndarray, weights: np.ndarray, config: GraphConfig) -> np.ndarray:
    """Roots of pixels 0..n-1 after merging along edges in order of colour weight, then of small segments."""
    sets, size = _Sets(n), [1] * n
    limits = [[config.scale_k] * 3 for _ in range(n)]
    order = np.lexsort((edges[:, 1], edges[:, 0], weights[:, 0]))
    pairs, values = edges[order].tolist(), weights[order].tolist()
    for (i, j), w in zip(pairs, values):
        a, b = sets.root(i), sets.root(j)
        if a != b and all(x <= min(p, q) for x, p, q in zip(w, limits[a], limits[b])):
            both = size[a] + size[b]
            r = sets.union(a, b)
            size[r] = both
            limits[r] = [x + config.scale_k / both for x in w]
    for i, j in pairs:
        a, b = sets.root(i), sets.root(j)
        if a != b and (size[a] < config.min_size or size[b] < config.min_size):
            both = size[a] + size[b]
            r = sets.union(a, b)
            if config.update_sizes:
                size[r] = both
    return np.array([sets.root(i) for i in range(n)])


def _pairs(image: pd.DataFrame, offsets=grid.HALF) -> np.ndarray:
    """Places of both ends of an image's edges."""
    t = Tile.whole(image.assign(place=np.arange(len(image))), ["place"], 1)
    place, parts = t.grid("place"), []
    for o in offsets:
        there = t.near(t.there) & t.near(t.there, *o)
        parts.append(np.stack([t.near(place)[there], t.near(place, *o)[there]], axis=1))
    return np.concatenate(parts)


@_of_image(GraphConfig)
def graph_labels(image: pd.DataFrame, config: GraphConfig) -> np.ndarray:
    if config.weigh:
        raise ValueError("given weights are frames: segment() takes them")
    pairs = _pairs(image)
    one, other = (image[list(CHANNELS)].to_numpy()[pairs[:, k]] for k in (0, 1))
    far = [np.sqrt(((one - other)[:, s] ** 2).sum(axis=1)) for s in (slice(0, 3), slice(3, 6))]
    angle = np.arccos(np.clip((one[:, 6:] * other[:, 6:]).sum(axis=1), 0, 1))
    return regions.renumbered(merged_graph(len(image), pairs, np.column_stack([*far, angle]), config))


def weighed_segments(df: DataFrame, config: GraphConfig) -> DataFrame:
    """Graph merging by given weights: edges meet their image's pixels."""
    edges, pixels = config.weigh(df), df.select(F.col("image_id").alias("image"), "pid")

    def run(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        pid = np.sort(p["pid"].to_numpy())
        pairs = np.searchsorted(pid, e[["src", "dst"]].to_numpy()) if len(e) else np.empty((0, 2), int)
        roots = merged_graph(len(pid), pairs, e[["w_rgb", "w_xyz", "w_n"]].to_numpy().reshape(-1, 3), config)
        image = p["image"].iloc[0] if len(p) else 0
        return pd.DataFrame({"image_id": image, "pid": pid, "label": regions.renumbered(roots) if len(pid) else []}).astype({"label": "int32"})

    return pixels.groupBy("image").cogroup(edges.groupBy("image_id")).applyInPandas(run, LABELS)


@_spread(GraphConfig)
def graph_spread(df: DataFrame, config: GraphConfig, side: int) -> DataFrame:
    return merging.spread_graph(df, (config.weigh or grid.weights)(df), config, side)


def _labelled(image: pd.DataFrame, act: Callable[[pd.DataFrame], np.ndarray]) -> pd.DataFrame:
    image = image.sort_values("pid").reset_index(drop=True)
    return pd.DataFrame({"image_id": image["image_id"], "pid": image["pid"], "label": np.asarray(act(image), np.int32)})


def _smooth(image: pd.DataFrame, labels: np.ndarray) -> np.ndarray:
    """Components of an image's labels after their median."""
    t = Tile.whole(image.assign(label=labels), ["label"], 1, clamp=True)
    image = image.assign(label=t.of(grid.median_of(t)).astype(int))
    return regions.renumbered(regions.flooded(*regions.as_grid(image, "label")))


@_of_image(MixtureConfig)
def mixture_labels(image: pd.DataFrame, config: MixtureConfig) -> np.ndarray:
    labels = _smooth(image, mixture.joint_em(image[list(CHANNELS)].to_numpy(), config).argmax(axis=1) + 1)
    return regions.planar_labels(image.assign(label=labels)) if config.merge_regions else labels


@_spread(MixtureConfig)
def mixture_spread(df: DataFrame, config: MixtureConfig, side: int) -> DataFrame:
    placed = df.select("image_id", "pid", "row", "col")
    median = grid.median3x3(placed.join(iterated.joint_em(df, config, block=side * side), ["image_id", "pid"]))
    out = regions.components_relational(placed.join(median, ["image_id", "pid"]))
    return regions.merge_planar(df.drop("label").join(out, ["image_id", "pid"])) if config.merge_regions else out


@_of_image(WatsonConfig)
def watson_labels(image: pd.DataFrame, config: WatsonConfig) -> np.ndarray:
    return regions.renumbered(mixture.watson_mixture(image[list(NORMAL)].to_numpy(), config))


@_spread(WatsonConfig)
def watson_spread(df: DataFrame, config: WatsonConfig, side: int) -> DataFrame:
    return regions.renumber(iterated.watson_mixture(df, config, side * side))


@_of_image(DiametricalConfig)
def diametrical_labels(image: pd.DataFrame, config: DiametricalConfig) -> np.ndarray:
    return regions.renumbered(mixture.diametrical(image[list(NORMAL)].to_numpy(), config)[1])


@_spread(DiametricalConfig)
def diametrical_spread(df: DataFrame, config: DiametricalConfig, side: int) -> DataFrame:
    return regions.renumber(iterated.diametrical_labels(df, config, side * side))


def landmark_pixels(df: DataFrame, proportion: float) -> DataFrame:
    """The pixels of the evenly spaced places that ``landmarks`` names, as a plan: places by pid in each image, of one pid by row."""
    n = F.count("*").over(Window.partitionBy("image_id"))
    rows = df.withColumns({"_at": F.row_number().over(Window.partitionBy("image_id").orderBy("pid", "row", "col")) - 1, "_n": n})
    m = F.greatest(F.lit(2), F.least("_n", F.rint(F.col("_n") * proportion).cast("long")))
    # place p is floor(k n / m) for some k if and only if k = ceil(p m / n) gives it back
    k = F.expr("(_at * _m + _n - 1) div _n")
    return rows.withColumn("_m", m).withColumn("_k", k).where("_k < _m and (_k * _n) div _m = _at").drop("_at", "_n", "_m", "_k")


def affinity(df: DataFrame, marks: DataFrame, names: tuple[str, ...] = (*COLOUR, *POSITION)) -> DataFrame:
    """Gaussian affinity of all pixels to the landmarks of their image (some hundreds of them)."""
    other = marks.select("image_id", F.col("pid").alias("mark"), *[F.col(c).alias(f"o_{c}") for c in names])
    gap = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in names), F.lit(0.0))
    # one image is one key: its pixels are dealt out, and the landmarks go to all of them
    pixels = df.select("image_id", "pid", *names).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "pid")
    return pixels.join(F.broadcast(other), "image_id").select("image_id", "pid", "mark", F.exp(-gap).alias("a"))


def best_of(scores: DataFrame) -> DataFrame:
    """Of rows (image_id, place, .., score) each image's row of the greatest score, the first place of equal ones."""
    order = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "place")
    return scores.where("score IS NOT NULL AND NOT isnan(score)").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def lab(df: DataFrame, config: SpectralConfig) -> DataFrame:
    return to_lab(df) if config.lab_mode == "reference" else to_lab(df.withColumns({c: F.col(c) * 255 for c in COLOUR}))


@_of_image(SpectralConfig)
def spectral_labels(image: pd.DataFrame, config: SpectralConfig) -> np.ndarray:
    """The labels of the weight of greatest score; colours are CIE Lab already."""
    x = image[list(CHANNELS[:6])].to_numpy()
    spread = x.std(axis=0, ddof=1)
    own, a, b, _ = regions.as_grid(image.assign(one=1), "one")
    best = None
    for weight in config.lambdas:
        f = x * spectral.scales(spread, weight)
        _, group = mixture.kmeans(nystrom(f, landmarks(len(x), config.proportion), config.nev, config.affinity), config.k, config.seed)
        same = group[a] == group[b]
        labels = regions.renumbered(regions.flooded(own, a[same], b[same]))
        small = regions.pruned(labels, np.stack([a, b]), config.prune_below, config.delete, config.replace)
        score = disparity(f, small)
        if not np.isnan(score) and (best is None or score > best[0]):
            best = score, regions.renumbered(small) if config.return_pruned else labels
    if best is None:
        raise ValueError("no segmentation has a score")
    return best[1]


@_spread(SpectralConfig)
def spectral_spread(df: DataFrame, config: SpectralConfig, side: int) -> DataFrame:
    return spectral.spread(df, config, landmark_pixels(df, config.proportion), best_of, side * side)
