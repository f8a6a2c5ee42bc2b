"""Quality of segmentations, with and without ground truth.

Definitions are pinned from the literature (natural logarithms, 8-connected
boundaries); every metric is a frame (image_id, value).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.model import COLOUR
from lumigrid.operators import grid, tiles
from lumigrid.sources.shared import written

KEYS = ["image_id", "pid"]


def contingency(seg: DataFrame, truth: DataFrame) -> DataFrame:
    """Pixels by label ``a`` of the segmentation and label ``b`` of the truth."""
    both = seg.select(*KEYS, F.col("label").alias("a")).join(truth.select(*KEYS, F.col("label").alias("b")), KEYS)
    return both.groupBy("image_id", "a", "b").agg(F.count("*").alias("n"))


def _marginals(t: DataFrame) -> DataFrame:
    by = lambda *c: Window.partitionBy("image_id", *c)
    return t.withColumns({"na": F.sum("n").over(by("a")), "nb": F.sum("n").over(by("b")), "all": F.sum("n").over(by())})


def _pairs(c: str) -> Column:
    return F.col(c) * (F.col(c) - 1) / 2.0


def _pair_sums(t: DataFrame) -> DataFrame:
    pairs = lambda x: x * (x - 1) / 2.0
    cells = t.groupBy("image_id").agg(F.sum(_pairs("n")).alias("both"), F.sum("n").alias("all"))
    a = t.groupBy("image_id", "a").agg(F.sum("n").alias("n")).groupBy("image_id").agg(F.sum(_pairs("n")).alias("in_a"))
    b = t.groupBy("image_id", "b").agg(F.sum("n").alias("n")).groupBy("image_id").agg(F.sum(_pairs("n")).alias("in_b"))
    return cells.join(a, "image_id").join(b, "image_id").withColumn("pairs", pairs(F.col("all")))


def rand_index(t: DataFrame) -> DataFrame:
    return _pair_sums(t).select("image_id", ((F.col("pairs") + 2 * F.col("both") - F.col("in_a") - F.col("in_b")) / F.col("pairs")).alias("value"))


def pair_precision(t: DataFrame) -> DataFrame:
    return _pair_sums(t).select("image_id", (F.col("both") / F.col("in_a")).alias("value"))


def pair_f_measure(t: DataFrame) -> DataFrame:
    return _pair_sums(t).select("image_id", (2 * F.col("both") / (F.col("in_a") + F.col("in_b"))).alias("value"))


def variation_of_information(t: DataFrame) -> DataFrame:
    m = _marginals(t)
    p = F.col("n") / F.col("all")
    return m.groupBy("image_id").agg((-F.sum(p * (F.log(F.col("n") / F.col("na")) + F.log(F.col("n") / F.col("nb"))))).alias("value"))


def segmentation_covering(t: DataFrame) -> DataFrame:
    """Truth regions covered by their best overlapping segment, weighted by area."""
    m = _marginals(t).withColumn("iou", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = m.groupBy("image_id", "b").agg(F.max("iou").alias("iou"), F.first("nb").alias("nb"), F.first("all").alias("all"))
    return best.groupBy("image_id").agg((F.sum(F.col("nb") * F.col("iou")) / F.first("all")).alias("value"))


def region_f_measure(t: DataFrame, share: float = 0.5) -> DataFrame:
    """F of matched regions: a pair matches if it covers more than ``share`` of both."""
    m = _marginals(t)
    hits = m.groupBy("image_id").agg(F.sum(F.when((F.col("n") > share * F.col("na")) & (F.col("n") > share * F.col("nb")), 1).otherwise(0)).alias("hits"), F.countDistinct("a").alias("ra"), F.countDistinct("b").alias("rb"))
    return hits.select("image_id", (2 * F.col("hits") / (F.col("ra") + F.col("rb"))).alias("value"))


def objects_and_parts(t: DataFrame, whole: float = 0.9, part: float = 0.25, beta: float = 0.1) -> DataFrame:
    """F of regions matched as objects (both overlaps reach ``whole``) or, with weight ``beta``,
    as parts (one overlap reaches ``whole``, the other ``part``)."""
    m = _marginals(t)
    ia, ib = F.col("n") / F.col("na"), F.col("n") / F.col("nb")
    kind = F.when((ia >= whole) & (ib >= whole), F.lit(1.0)).when((F.greatest(ia, ib) >= whole) & (F.least(ia, ib) >= part), F.lit(beta)).otherwise(0.0)
    m = m.withColumn("hit", kind)
    side = lambda c: m.groupBy("image_id", c).agg(F.max("hit").alias("hit")).groupBy("image_id").agg(F.avg("hit").alias(f"s{c}"))
    both = side("a").join(side("b"), "image_id")
    total = F.col("sa") + F.col("sb")
    return both.select("image_id", F.when(total > 0, 2 * F.col("sa") * F.col("sb") / total).otherwise(0.0).alias("value"))


def edge_pixels(df: DataFrame) -> DataFrame:
    """Pixels with an 8-neighbour of another label."""

    def rim(t: tiles.Tile) -> dict[str, np.ndarray]:
        label = t.grid("label")
        met = [t.near(t.there, *o) & (t.near(label, *o) != t.near(label)) for o in grid.window(1)]
        return {"row": t.row, "col": t.col, "keep": np.logical_or.reduce(met)}

    return tiles.stencil(df, ["label"], 1, rim, "row int, col int")


def _reached(a: DataFrame, b: DataFrame, r: int) -> DataFrame:
    """The pixels of ``a`` that have one of ``b`` within ``r`` rows and columns."""
    both = a.select("image_id", "pid", "row", "col", F.lit(1).alias("mine"), F.lit(0).alias("other"))
    both = both.unionByName(b.select("image_id", "pid", "row", "col", F.lit(0).alias("mine"), F.lit(1).alias("other")))
    both = both.groupBy("image_id", "pid", "row", "col").agg(F.max("mine").alias("mine"), F.max("other").alias("other"))

    def met(t: tiles.Tile) -> dict[str, np.ndarray]:
        return {"mine": t.near(t.grid("mine")), "keep": (t.near(t.grid("mine")) > 0) & (t.box(t.grid("other"), r) > 0)}

    return tiles.stencil(both, ["mine", "other"], r, met, "mine int")


def boundary_f(seg: DataFrame, truth: DataFrame, r: int = 1) -> DataFrame:
    """F of boundary pixels matched within ``r`` rows and columns."""
    return _boundary_f(edge_pixels(seg), edge_pixels(truth), r)


def _boundary_f(a: DataFrame, b: DataFrame, r: int = 1) -> DataFrame:
    n = lambda x, name: x.groupBy("image_id").agg(F.count("*").alias(name))
    parts = [n(a, "na"), n(b, "nb"), n(_reached(a, b, r), "ha"), n(_reached(b, a, r), "hb")]
    m = reduce(lambda x, y: x.join(y, "image_id", "left"), parts)
    p, q = F.coalesce("ha", F.lit(0)) / F.col("na"), F.coalesce("hb", F.lit(0)) / F.col("nb")
    return m.select("image_id", F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0).alias("value"))


def boundary_displacement(seg: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean of both directed mean distances to the nearest boundary pixel; null if either has none."""
    return _boundary_displacement(edge_pixels(seg), edge_pixels(truth))


def _boundary_displacement(a: DataFrame, b: DataFrame) -> DataFrame:
    sides = [nearest_boundary(x, y).groupBy("image_id").agg(F.avg("distance").alias(n)) for x, y, n in ((a, b, "_a"), (b, a, "_b"))]
    images = a.select("image_id").union(b.select("image_id")).distinct()
    both = images.join(sides[0], "image_id", "left").join(sides[1], "image_id", "left")
    return both.select("image_id", ((F.col("_a") + F.col("_b")) / 2).alias("value"))


#: Rows of a strip in which distances along the columns meet; columns that a task takes at once.
STRIP, COLUMNS = 32, 16


def nearest_boundary(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, pid, distance): from each pixel of ``a`` to the nearest of ``b`` in its image, however far it is.

    The exact distance transform in two steps that each split an image: along each column first
    (a task has some columns), then across them (a task has strips of some rows).
    """
    last = a.groupBy("image_id").agg(F.max("row").alias("last"))
    columns = b.select("image_id", "row", "col").join(last, "image_id")

    def down(table: pa.Table) -> pa.Table:
        every, n = [table.column(c).to_numpy().astype(np.int64) for c in ("col", "row")], table.column("last")[0].as_py()
        at = np.arange(1, -(-n // STRIP) * STRIP + 1)
        cols, strips = np.unique(every[0]), []
        for c in cols:
            rows = np.unique(every[1][every[0] == c])
            after = np.searchsorted(rows, at)
            far = np.minimum(np.where(after > 0, at - rows[after - 1], 1 << 30), np.where(after < len(rows), rows[np.minimum(after, len(rows) - 1)] - at, 1 << 30))
            strips += list(far.reshape(-1, STRIP))
        k = len(at) // STRIP
        image, strip = pa.array([table.column("image_id")[0].as_py()] * len(strips), pa.int64()), pa.array(np.tile(np.arange(k), len(cols)), pa.int32())
        return pa.table({"image_id": image, "strip": strip, "col": pa.array(np.repeat(cols, k), pa.int32()), "far": pa.array(strips, pa.list_(pa.int64()))})

    met = columns.groupBy("image_id", F.expr(f"col div {COLUMNS}").alias("_part")).applyInArrow(down, "image_id long, strip int, col int, far array<long>")
    own = a.select("image_id", F.expr(f"cast((row - 1) div {STRIP} as int)").alias("strip"), "pid", "row", "col")

    def across(mine: pa.Table, strip: pa.Table) -> pa.Table:
        row, col, pid = (mine.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "pid"))
        out = np.zeros(0)
        if len(pid) and strip.num_rows:
            far = np.array(strip.column("far").to_pylist(), float) ** 2
            at = strip.column("col").to_numpy()
            step = max(1, CELLS // len(at))
            out = np.concatenate([np.sqrt((far[:, (row[i : i + step] - 1) % STRIP] + (at[:, None] - col[i : i + step]) ** 2).min(axis=0)) for i in range(0, len(row), step)])
        n = len(out)
        return pa.table({"image_id": pa.array([mine.column("image_id")[0].as_py()] * n if n else [], pa.int64()), "pid": pid[:n], "distance": out})

    return own.groupBy("image_id", "strip").cogroup(met.groupBy("image_id", "strip")).applyInArrow(across, "image_id long, pid long, distance double")


def colour_errors(df: DataFrame) -> DataFrame:
    """Per region its area and the sum of squared colour distances to its mean, in one pass."""
    n = F.count("*")
    e2 = sum((F.var_pop(c) * n for c in COLOUR), F.lit(0.0))
    return df.groupBy("image_id", "label").agg(n.alias("area"), e2.alias("e2"))


def liu_yang(df: DataFrame) -> DataFrame:
    e = colour_errors(df)
    return e.groupBy("image_id").agg((F.sqrt(F.count("*").cast("double")) * F.sum(F.col("e2") / F.sqrt(F.col("area").cast("double")))).alias("value"))


def _same_area(df: DataFrame) -> DataFrame:
    return colour_errors(df).withColumn("same", F.count("*").over(Window.partitionBy("image_id", "area")))


def f_prime(df: DataFrame) -> DataFrame:
    e = _same_area(df)
    by_area = F.sum(F.pow(F.col("same").cast("double"), 1 + 1 / F.col("area")) / F.col("same"))
    return e.groupBy("image_id").agg((F.sqrt(by_area) * F.sum(F.col("e2") / F.sqrt(F.col("area").cast("double"))) / (1000 * F.sum("area"))).alias("value"))


def q_metric(df: DataFrame) -> DataFrame:
    e = _same_area(df)
    term = F.col("e2") / (1 + F.log(F.col("area").cast("double"))) + F.pow(F.col("same") / F.col("area"), F.lit(2.0))
    return e.groupBy("image_id").agg((F.sqrt(F.count("*").cast("double")) * F.sum(term) / (1000 * F.sum("area"))).alias("value"))


def values_entropy(df: DataFrame, levels: int = 16, value: str = "c1") -> DataFrame:
    """Entropy of quantised values in each region, weighted by area."""
    v = F.floor(F.col(value) * levels).alias("v")
    n = df.select("image_id", "label", v).groupBy("image_id", "label", "v").agg(F.count("*").alias("n"))
    n = n.withColumns({"area": F.sum("n").over(Window.partitionBy("image_id", "label")), "all": F.sum("n").over(Window.partitionBy("image_id"))})
    return n.groupBy("image_id").agg((-F.sum(F.col("n") / F.col("all") * F.log(F.col("n") / F.col("area")))).alias("value"))


def zeboudj(df: DataFrame, radius: int = 2, values: tuple[str, ...] = ("c1",)) -> DataFrame:
    """Contrast inside and at the edge of each region over a window; the mean over ``values``.

    A tile gives the sums of its part of each region.
    """

    def contrasts(t: tiles.Tile) -> dict:
        label, own = t.grid("label"), t.near(t.grid("label"))
        names, at = np.unique(t.of(own), return_inverse=True)
        same = {o: (t.near(t.there, *o) & (t.near(label, *o) == own), t.near(t.there, *o) & (t.near(label, *o) != own)) for o in grid.window(radius)}
        edge = t.of(np.logical_or.reduce([out for _, out in same.values()]))
        found = {"label": [], "channel": [], "area": [], "inside": [], "outside": [], "rims": []}
        for k, c in enumerate(values):
            v = t.grid(c)
            inside, outside = np.zeros(t.size), np.zeros(t.size)
            for o, (near, far) in same.items():
                gap = np.abs(t.near(v, *o) - t.near(v))
                inside, outside = np.maximum(inside, np.where(near, gap, 0)), np.maximum(outside, np.where(far, gap, 0))
            sums = (np.bincount(at), np.bincount(at, t.of(inside)), np.bincount(at, t.of(outside)), np.bincount(at, edge).astype(np.int64))
            for name, x in zip(found, (names, np.full(len(names), k), *sums)):
                found[name].append(x)
        return {k: np.concatenate(v) for k, v in found.items()}

    parts = tiles.by_tile(df, ["label", *values], radius, contrasts, "label int, channel int, area long, inside double, outside double, rims long")
    total = [F.sum(c).alias(c) for c in ("area", "inside", "outside", "rims")]
    r = parts.groupBy("image_id", "channel", "label").agg(*total)
    r = r.select("image_id", "channel", "area", (F.col("inside") / F.col("area")).alias("i"), F.when(F.col("rims") > 0, F.col("outside") / F.col("rims")).otherwise(0.0).alias("e"))
    c = F.when((F.col("i") > 0) & (F.col("i") < F.col("e")), 1 - F.col("i") / F.col("e")).when(F.col("i") == 0, F.col("e")).otherwise(0.0)
    by = r.groupBy("image_id", "channel").agg((F.sum(F.col("area") * c) / F.sum("area")).alias("value"))
    return by.groupBy("image_id").agg(F.avg("value").alias("value"))


def _with_means(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    means = df.groupBy("image_id", "label").agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    return df.select("image_id", "pid", "row", "col", "label", *names).join(means, ["image_id", "label"])


def ecw(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of pixels far from their region's mean plus share of region borders between like means."""
    m = _with_means(df, COLOUR)
    far = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in COLOUR), F.lit(0.0)))
    intra = m.groupBy("image_id").agg(F.avg(F.when(far > threshold, 1.0).otherwise(0.0)).alias("intra"))
    e = grid.edges(m, ["label", *[f"m_{c}" for c in COLOUR]]).where("label != o_label")
    like = F.sqrt(sum(((F.col(f"m_{c}") - F.col(f"o_m_{c}")) * (F.col(f"m_{c}") - F.col(f"o_m_{c}")) for c in COLOUR), F.lit(0.0))) < threshold
    inter = e.groupBy("image_id").agg(F.avg(F.when(like, 1.0).otherwise(0.0)).alias("inter"))
    return intra.join(inter, "image_id", "left").select("image_id", (F.col("intra") + F.coalesce("inter", F.lit(0.0))).alias("value"))


#: Regions of a block of distances, and distances that are held at once.
REGIONS, CELLS = 1024, 1 << 21


def distance_sums(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` the sum of its distances to all of ``others``, by blocks."""
    step, out = max(1, CELLS // max(len(others), 1)), []
    for i in range(0, len(x), step):
        square = sum((x[i : i + step, k, None] - others[None, :, k]) ** 2 for k in range(x.shape[1]))
        out.append(np.sqrt(square).sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0)


def _disparity(df: DataFrame, names: tuple[str, ...], out: str) -> DataFrame:
    """Distances between regions are added up by blocks: a task has ``REGIONS`` regions and the means of all of their image."""
    m = _with_means(df, names)
    far = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in names), F.lit(0.0)))
    intra = m.groupBy("image_id").agg(F.avg(far).alias("intra"), F.count("*").alias("all"))
    r = df.groupBy("image_id", "label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])
    count = r.groupBy("image_id").agg(F.count("*").alias("_r")).withColumn("blocks", F.ceil(F.col("_r") / REGIONS).cast("int")).drop("_r")
    own = F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int")
    r = r.join(count, "image_id").select("image_id", "n", *names, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def sums(table: pa.Table) -> pa.Table:
        x, n = np.column_stack([table.column(c).to_numpy() for c in names]), table.column("n").to_numpy()
        some = table.column("own").to_numpy() == table.column("block").to_numpy()
        value = float((distance_sums(x[some], x) / max(len(x) - 1, 1) * n[some]).sum())
        return pa.table({"image_id": table.column("image_id")[:1], "inter": pa.array([value])})

    parts = r.groupBy("image_id", "block").applyInArrow(sums, "image_id long, inter double")
    both = intra.join(parts.groupBy("image_id").agg(F.sum("inter").alias("inter")), "image_id")
    return both.select("image_id", ((F.col("inter") / F.col("all") - F.col("intra")) / 2).alias(out))


def frc_rgbd(df: DataFrame) -> DataFrame:
    """Half of inter-region minus intra-region disparity; the mean of colour and depth."""
    both = _disparity(df, COLOUR, "c").join(_disparity(df, ("z",), "d"), "image_id")
    return both.select("image_id", ((F.col("c") + F.col("d")) / 2).alias("value"))


def of_channels(metric: Callable[..., DataFrame], names: tuple[str, ...] = COLOUR, **options) -> Callable[[DataFrame], DataFrame]:
    """A metric of one value as one of several: the mean over the named columns."""

    def mean(df: DataFrame) -> DataFrame:
        every = reduce(DataFrame.unionByName, [metric(df, value=c, **options) for c in names])
        return every.groupBy("image_id").agg(F.avg("value").alias("value"))

    return mean


SUPERVISED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "RandIndex": rand_index,
    "VariationOfInformation": variation_of_information,
    "SegmentationCovering": segmentation_covering,
    "Precision": pair_precision,
    "FMeasure": pair_f_measure,
    "FMeasureRegions": region_f_measure,
    "PRObjectsAndParts": objects_and_parts,
}
BOUNDARY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"FBoundary": boundary_f, "BoundaryDisplacementError": boundary_displacement}
#: The same of the boundary pixels of both.
_OF_EDGES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"FBoundary": _boundary_f, "BoundaryDisplacementError": _boundary_displacement}
UNSUPERVISED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ECW": ecw,
    "Zeboudj": partial(zeboudj, radius=5, values=COLOUR),
    "ValuesEntropy": of_channels(values_entropy),
    "LiuYangF": liu_yang,
    "FPrime": f_prime,
    "Q": q_metric,
    "FRCRGBD": frc_rgbd,
}


def _rows(frames: dict[str, DataFrame], algorithm: str) -> DataFrame:
    one = [f.select("image_id", F.lit(algorithm).alias("algorithm"), F.lit(k).alias("metric"), F.col("value").cast("double").alias("value")) for k, f in frames.items()]
    return reduce(DataFrame.unionByName, one)


def supervised(seg: DataFrame, truth: DataFrame, algorithm: str) -> DataFrame:
    """Rows (image_id, algorithm, metric, value) of all metrics against ground truth."""
    t = written(contingency(seg, truth))
    rims = written(edge_pixels(seg)), written(edge_pixels(truth))
    return _rows({**{k: f(t) for k, f in SUPERVISED.items()}, **{k: _OF_EDGES[k](*rims) for k in BOUNDARY}}, algorithm)


def unsupervised(df: DataFrame, algorithm: str) -> DataFrame:
    return _rows({k: f(df) for k, f in UNSUPERVISED.items()}, algorithm)


def summarised(rows: DataFrame, by: tuple[str, ...] = ("algorithm", "metric")) -> DataFrame:
    """Mean by algorithm and metric, without missing values."""
    return rows.where(F.col("value").isNotNull()).groupBy(*by).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def pivoted(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.groupBy("algorithm").pivot("metric", metrics).agg(F.avg("value"))


def rolled_up(rows: DataFrame) -> DataFrame:
    """Means by algorithm and metric, by algorithm, and of all (an extension)."""
    return rows.where(F.col("value").isNotNull()).rollup("algorithm", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
