"""Spectral clustering from landmarks (Nystrom), by blocks of rows.

The affinity of all rows to the landmarks is never held whole.  A first pass over blocks of rows adds up
their affinities to each landmark, from which the degrees follow; a second one makes each block's rows of
the eigenvectors.  A task holds a stretch of a block times landmarks, and one of them, for the landmarks' own affinities, the
landmarks times their numerical rank (pivoted Cholesky), as the affinities of close landmarks say the same.  Up to ``DENSE``
landmarks, where the rank is above a quarter of them, and with affinities of one's own, which need not be positive, it holds
landmarks times landmarks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.model import CHANNELS, SpectralConfig
from lumigrid.operators import iterated, metrics, projections, regions
from lumigrid.sources.shared import written

#: Affinities that a stretch of a block holds, and landmarks whose affinities to each other are held whole.
CELLS, DENSE = 1 << 20, 2048
#: What a factor may leave of the affinities' trace, and the least eigenvalue, as a share of the greatest, that is not 0.
REST, LEAST = 1e-12, 1e-10
Affinity = Callable[[np.ndarray, np.ndarray], np.ndarray]


def landmarks(n: int, proportion: float) -> np.ndarray:
    """Evenly spaced places, at least two."""
    m = max(2, min(n, int(np.rint(n * proportion))))
    return np.unique(np.floor(np.arange(m) * n / m).astype(int))


def gaussian(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """exp of minus the squared distances, from norms and one product."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)
    square -= 2 * x @ y.T
    np.negative(np.maximum(square, 0, out=square), out=square)
    return np.exp(square, out=square)


def scales(spread: np.ndarray, weight: float) -> np.ndarray:
    """Factors of colours and positions from the channels' deviations."""
    return np.r_[[3 / max(spread[:3].sum(), 1e-12)] * 3, [weight * 3 / max(spread[3:].sum(), 1e-12)] * 3]


def _cut(x: np.ndarray, m: int) -> list[np.ndarray]:
    step = max(1, CELLS // m)
    return [x[i : i + step] for i in range(0, len(x), step)]


def sums(x: np.ndarray, marks: np.ndarray, affinity: Affinity = gaussian) -> np.ndarray:
    """The rows' affinities to each landmark, added up."""
    return sum((affinity(part, marks).sum(axis=0) for part in _cut(x, len(marks))), np.zeros(len(marks)))


def projection(marks: np.ndarray, total: np.ndarray, nev: int, affinity: Affinity = gaussian) -> tuple[np.ndarray, np.ndarray]:
    """From all rows' ``sums``: what gives a row's degree, and its place in the leading eigenvectors, from its affinities."""
    part = factor(marks) if affinity is gaussian and len(marks) > DENSE else None
    if part is not None:
        return _projection(part, total, nev)
    c = affinity(marks, marks)
    weights = np.linalg.pinv(c, hermitian=True, rcond=LEAST) @ total
    root = np.sqrt(np.maximum(c @ weights, 1e-12))
    c = c / root[:, None] / root
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = np.argsort(-values)[: min(nev, len(marks))]
    return weights, vectors[:, keep] / np.where(np.abs(values[keep]) > 1e-10, values[keep], 1e-10) / root[:, None]


def factor(marks: np.ndarray) -> np.ndarray | None:
    """L of which L L' are the landmarks' affinities to each other, but for ``REST`` of their trace; a column for each landmark
    that those before it don't say, taken where most is left.  None where a quarter of the landmarks don't say the rest."""
    n, k = len(marks), 0
    left, found = np.ones(n), np.empty((n, 16), order="F")
    while left.sum() > REST * n:
        if k >= n / 4:
            return None
        at = int(left.argmax())
        if k == found.shape[1]:
            more = np.empty((n, 2 * k), order="F")
            more[:, :k], found = found, more
        found[:, k] = (gaussian(marks, marks[at : at + 1])[:, 0] - found[:, :k] @ found[at, :k]) / np.sqrt(left[at])
        left = np.maximum(left - found[:, k] ** 2, 0)
        left[at] = 0
        k += 1
    return found[:, :k]


def _projection(part: np.ndarray, total: np.ndarray, nev: int) -> tuple[np.ndarray, np.ndarray]:
    """``projection`` from a factor of the landmarks' affinities."""
    u, size, _ = np.linalg.svd(part, full_matrices=False)
    u, values = u[:, size**2 > LEAST * size[0] ** 2], size[size**2 > LEAST * size[0] ** 2] ** 2
    own = u.T @ total
    root = np.sqrt(np.maximum(u @ own, 1e-12))
    vectors, sizes, _ = np.linalg.svd(part / root[:, None], full_matrices=False)
    vectors = vectors[:, :nev] / np.maximum(sizes[:nev] ** 2, 1e-10) / root[:, None]
    # beyond the rank there is no direction
    return u @ (own / values), np.pad(vectors, ((0, 0), (0, min(nev, len(part)) - vectors.shape[1])))


def embedded(x: np.ndarray, marks: np.ndarray, weights: np.ndarray, vectors: np.ndarray, affinity: Affinity = gaussian) -> np.ndarray:
    out = [c @ vectors / np.sqrt(np.maximum(c @ weights, 1e-12))[:, None] for c in (affinity(part, marks) for part in _cut(x, len(marks)))]
    return np.concatenate(out) if out else np.zeros((0, vectors.shape[1]))


def nystrom(f: np.ndarray, at: np.ndarray, nev: int, affinity: Affinity | None = None) -> np.ndarray:
    """Leading eigenvectors of the normalised affinity, extended from landmarks to all rows."""
    affinity, marks = affinity or gaussian, f[at]
    return embedded(f, marks, *projection(marks, sums(f, marks, affinity), nev, affinity), affinity)


def disparity(f: np.ndarray, labels: np.ndarray) -> float:
    """Half of inter-region minus intra-region disparity, weighted by area; the mean over feature sets."""
    _, inverse, n = np.unique(labels, return_inverse=True, return_counts=True)
    scores = []
    for x in (f[:, :3], f[:, 5:6]):
        mean = np.stack([np.bincount(inverse, x[:, k]) / n for k in range(x.shape[1])], axis=1)
        intra = float(np.sqrt(((x - mean[inverse]) ** 2).sum(axis=1)).mean())
        far = metrics.distance_sums(mean, mean)
        scores.append((float((far / max(len(n) - 1, 1) * n).sum() / n.sum()) - intra) / 2)
    return float(np.mean(scores))


# All images at once


def _embedding(scaled: DataFrame, marks: DataFrame, config: SpectralConfig, block: int) -> DataFrame:
    """Blocks (image_id, pids, x) of rows in the eigenvectors."""
    affinity, names, nev = config.affinity or gaussian, CHANNELS[:6], config.nev
    # each block meets all landmarks of its image, so blocks grow with them and the landmarks sent don't outgrow the rows
    most = marks.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    blocks = iterated.packed(scaled, names, max(block, most // 8))
    chosen = scaled.join(marks.select("image_id", "pid"), ["image_id", "pid"]).select("image_id", F.struct("pid", F.array(*names).alias("p")).alias("r"))
    state = written(chosen.groupBy("image_id").agg(F.flatten(F.sort_array(F.collect_list("r")).getField("p")).alias("v")))
    totals = iterated.summed(blocks, state, 6, lambda x, v: sums(x, v.reshape(-1, 6), affinity))

    def project(old: pa.Table, parts: pa.Table) -> pa.Table:
        if not old.num_rows:
            return pa.table({"image_id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        v = np.array(old.column("v")[0].as_py())
        found = projection(v.reshape(-1, 6), sum(p.values.to_numpy() for p in parts.column("s")), nev, affinity)
        return pa.table({"image_id": old.column("image_id"), "v": pa.array([np.concatenate([v, *(x.ravel() for x in found)])], pa.list_(pa.float64()))})

    state = written(state.groupBy("image_id").cogroup(totals.groupBy("image_id")).applyInArrow(project, "image_id long, v array<double>"))

    def embed(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        m = len(v) // (7 + nev)
        m = m if m >= nev and m * (7 + nev) == len(v) else next(m for m in range(1, nev) if m * (7 + m) == len(v))
        return embedded(x, v[: 6 * m].reshape(m, 6), v[6 * m : 7 * m], v[7 * m :].reshape(m, -1), affinity)

    return written(iterated.mapped(blocks, state, 6, embed))


def spread(df: DataFrame, config: SpectralConfig, marks: DataFrame, best_of: Callable[[DataFrame], DataFrame], block: int = iterated.BLOCK) -> DataFrame:
    """Labels (image_id, pid, label) of the weight of greatest score, image by image; colours are CIE Lab already."""
    scores, found, marks = [], [], written(marks.select("image_id", "pid"))
    for place, weight in enumerate(config.lambdas):
        scaled = written(projections.scaled_features(df, weight).select("image_id", "pid", "row", "col", *CHANNELS[:6]))
        blocks = _embedding(scaled, marks, config, block)
        group = iterated.clustered(blocks, config.nev, config.k, config.seed)
        labels = regions.components_relational(scaled.select("image_id", "pid", "row", "col").join(group, ["image_id", "pid"]))
        labels = written(scaled.join(labels, ["image_id", "pid"]))
        small = written(regions.prune(labels, config.prune_below, config.delete, config.replace))
        scores.append(metrics.frc_rgbd(small).select("image_id", F.lit(place).alias("place"), F.col("value").alias("score")))
        kept = regions.renumber(small) if config.return_pruned else labels.select("image_id", "pid", "label")
        found.append(kept.withColumn("place", F.lit(place)))
    best = written(best_of(reduce(DataFrame.unionByName, scores)))
    return reduce(DataFrame.unionByName, found).join(best.select("image_id", "place"), ["image_id", "place"]).select("image_id", "pid", "label")
