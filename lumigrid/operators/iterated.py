"""Clustering and mixture fitting of all images at once, each turn one plan.

For images that no task can hold.  Pixels are packed once into blocks (rows of
some thousand pixels of one image), parameters are a table with a row for each image.  A turn joins
the blocks with the parameters by image, takes each block's sums (numpy, in Arrow
batches), adds them up by image in one aggregation, and computes the next parameters
from them.  An image leaves as soon as it has converged; the driver sees the number of
images left.  Partial sums are added up within a task first, so an image gives at most a row for each
task, whatever its size.

The numbers are those of the kernels of ``mixture``, of which the steps are shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.model import CHANNELS, NORMAL, DiametricalConfig, MixtureConfig, WatsonConfig
from lumigrid.operators import mixture
from lumigrid.sources.shared import written

#: Pixels of a block, and numbers of all images' parameters that are few enough to send to all executors (32 MB).
BLOCK, FEW = 4096, 1 << 22
STATE = "image_id long, turn int, done boolean, score double, v array<double>, kept array<double>"
Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def packed(df: DataFrame, names: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """(image_id, pids, x): blocks of pixels in the order of their pids, channels one after the other in each pixel."""
    rows = df.select("image_id", "pid", F.floor((F.col("pid") - 1) / F.lit(size)).alias("block"), F.array(*[F.col(c).cast("double") for c in names]).alias("p"))
    block = rows.groupBy("image_id", "block").agg(F.sort_array(F.collect_list(F.struct("pid", "p"))).alias("r"))
    return written(block.select("image_id", F.col("r.pid").alias("pids"), F.flatten("r.p").alias("x")))


def _matrix(x: pa.Scalar, width: int) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _joined(blocks: DataFrame, state: DataFrame, numbers: int | None = None) -> DataFrame:
    """Blocks with their image's parameters; beyond ``FEW`` numbers in all Spark joins them as it sees fit."""
    numbers = state.agg(F.sum(F.size("v"))).first()[0] or 0 if numbers is None else numbers
    return blocks.join(F.broadcast(state) if numbers <= FEW else state, "image_id")


def summed(blocks: DataFrame, state: DataFrame, width: int, sums: Step, numbers: int | None = None) -> DataFrame:
    """(image_id, s): ``sums`` of each block under its image's parameters, added up by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for image, x, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                s = sums(_matrix(x, width), v.values.to_numpy())
                total[image] = total[image] + s if image in total else s
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["image_id", "s"])

    return _joined(blocks, state.select("image_id", "v"), numbers).select("image_id", "x", "v").mapInArrow(run, "image_id long, s array<double>")


def iterate(blocks: DataFrame, state: DataFrame, width: int, sums: Step, step: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    """Turns until all images are done.  ``sums(pixels, v)`` is a block's part, ``step(row, sums)`` gives
    the changed fields of an image's state; the state keeps its row of ``STATE`` columns."""

    def update(old: pa.Table, parts: pa.Table) -> pa.Table:
        rows = []
        for row in old.to_pylist():
            s = sum(p.values.to_numpy() for p in parts.column("s"))
            now = row | step({**row, "v": np.array(row["v"])}, s) | {"turn": row["turn"] + 1}
            rows.append(now)
        columns = [c.split()[0] for c in STATE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds)], names=columns)

    state = written(state)
    while True:
        active = state.where("NOT done")
        images, numbers = active.agg(F.count("*"), F.sum(F.size("v"))).first()
        if not images:
            return state
        parts = summed(blocks, active, width, sums, numbers)
        found = active.groupBy("image_id").cogroup(parts.groupBy("image_id")).applyInArrow(update, STATE)
        state = written(found.unionByName(state.where("done")))


def labelled(blocks: DataFrame, state: DataFrame, width: int, label: Step, column: str = "kept") -> DataFrame:
    """(image_id, pid, label) under the parameters in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, pids, x, v in zip(*(batch.column(k) for k in range(4))):
                own = label(_matrix(x, width), v.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), image.as_py())), pids.values, pa.array(own, pa.int32())], ["image_id", "pid", "label"])

    rows = _joined(blocks, state.select("image_id", F.col(column).alias("v"))).select("image_id", "pids", "x", "v")
    return rows.mapInArrow(run, "image_id long, pid long, label int")


def mapped(blocks: DataFrame, state: DataFrame, width: int, f: Step) -> DataFrame:
    """Blocks whose rows are what ``f`` makes of the pixels under their image's parameters ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, pids, x, v in zip(*(batch.column(k) for k in range(4))):
                new = f(_matrix(x, width), v.values.to_numpy())
                columns = [pa.array([image.as_py()], pa.int64()), pa.array([pids.as_py()], pa.list_(pa.int64())), pa.array([new.ravel()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "pids", "x"])

    rows = _joined(blocks, state).select("image_id", "pids", "x", "v")
    return rows.mapInArrow(run, "image_id long, pids array<long>, x array<double>")


def _started(rows: DataFrame, v: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The state before the first turn, from the rows of each image (bounded ones)."""

    def run(table: pa.Table) -> pa.Table:
        first = [np.asarray(v(table), float).ravel()]
        return pa.table({"image_id": table.column("image_id")[:1], "turn": pa.array([0], pa.int32()), "done": [False], "score": pa.array([np.inf]), "v": pa.array(first), "kept": pa.array(first)})

    return rows.groupBy("image_id").applyInArrow(run, STATE)


def sampled(blocks: DataFrame, width: int) -> DataFrame:
    """(image_id, pid, x): evenly spaced pixels of each image, ``mixture.SEEDS`` to twice as many at most; all of a small one."""
    n = blocks.groupBy("image_id").agg(F.max(F.array_max("pids")).alias("n"))
    rows = blocks.join(n, "image_id").select("image_id", "n", F.posexplode("pids").alias("at", "pid"), "x")
    rows = rows.where(F.col("pid") % F.ceil(F.col("n") / mixture.SEEDS) == 0)
    return rows.select("image_id", "pid", F.slice("x", F.col("at") * width + 1, width).alias("x"))


def _sorted(table: pa.Table) -> np.ndarray:
    return np.array(table.sort_by("pid").column("x").to_pylist())


# k-means and the joint start


def kmeans(blocks: DataFrame, modes: tuple[slice, ...], width: int, k: int, seed: int, rounds: int = 100) -> DataFrame:
    """Centres of each mode (channels of equal number), clustered by itself: state with v of (modes, k, channels) numbers, by image.

    Starts are drawn from evenly spaced pixels, Lloyd's turns go over all pixels.
    """
    n, wide = len(modes), modes[0].stop - modes[0].start

    def first(table: pa.Table) -> np.ndarray:
        x = _sorted(table)
        return np.stack([mixture.seeded(x[:, s], k, seed) for s in modes])

    def sums(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.stack([mixture.cluster_sums(x[:, s], mixture.nearest_centre(x[:, s], c), len(c)) for s, c in zip(modes, v.reshape(n, -1, wide))]).ravel()

    def step(row: dict, s: np.ndarray) -> dict:
        old, s = row["v"].reshape(n, -1, wide), s.reshape(n, -1, wide + 1)
        new = np.stack([mixture.moved(c, t) for c, t in zip(old, s)])
        same = np.allclose(new, old, rtol=0, atol=1e-12)
        return {"v": new.ravel(), "done": same or row["turn"] + 1 >= rounds}

    return iterate(blocks, _started(sampled(blocks, width), first), width, sums, step)


def clustered(blocks: DataFrame, width: int, k: int, seed: int) -> DataFrame:
    """(image_id, pid, label): the nearest centre by k-means over all channels of the blocks."""
    state = kmeans(blocks, (slice(0, width),), width, k, seed)
    return labelled(blocks, state, width, lambda x, v: mixture.nearest_centre(x, v.reshape(-1, width)), "v")


def joint_start(blocks: DataFrame, k: int, seed: int) -> DataFrame:
    """State whose ``kept`` has the centres (k, 9) of the joint distance."""

    def unit(table: pa.Table) -> np.ndarray:
        return mixture.joined_centres(np.array(table.column("v")[0].as_py()).reshape(3, -1, 3))

    def sums(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        c = v.reshape(-1, 9)
        own, least = mixture.joint_assigned(x, c)
        return np.append(mixture.cluster_sums(x, own, len(c)).ravel(), least.sum())

    def step(row: dict, s: np.ndarray) -> dict:
        value, stop = s[-1], row["turn"] + 1 >= mixture.JOINT_TURNS
        stop = stop or abs(value - (100.0 if row["turn"] == 0 else row["score"])) <= 0.1
        return {"kept": row["v"], "v": mixture.joint_centres(s[:-1].reshape(-1, 10)).ravel(), "score": value, "done": stop}

    return iterate(blocks, _started(kmeans(blocks, mixture.MODES, 9, k, seed), unit), 9, sums, step)


# The joint mixture


def model_of(df: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(image_id, comp, weight, means, mean products and mean statistic): the mixture's model of labels 0.. to k - 1."""
    blocks = packed(df, (*CHANNELS, "label"), block)
    none = blocks.select("image_id").distinct().withColumn("v", F.array(F.lit(0.0)))
    parts = summed(blocks, none, 10, lambda x, v: mixture.statistics(x[:, :9], np.eye(k)[x[:, 9].astype(int)]).ravel())
    names = [n for g in ("c1 c2 c3", "x y z") for n in [*g.split(), *(f"{a}_{b}" for i, a in enumerate(g.split()) for b in g.split()[i:])]] + [f"t{i}" for i in range(1, 7)]
    total = parts.select("image_id", F.posexplode("s").alias("at", "s")).groupBy("image_id", "at").agg(F.sum("s").alias("s"))
    rows = total.groupBy("image_id", F.expr(f"cast(at div {mixture.WIDE} as int)").alias("comp"))
    place = F.col("at") % mixture.WIDE
    rows = rows.agg(*[F.sum(F.when(place == i, F.col("s"))).alias(n) for i, n in enumerate(["n", *names])])
    every = F.sum("n").over(Window.partitionBy("image_id"))
    return rows.withColumn("weight", F.col("n") / every).where("n > 0").select("image_id", "comp", "weight", *[(F.col(n) / F.col("n")).alias(n) for n in names])


def joint_em(df: DataFrame, config: MixtureConfig, start: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(image_id, pid, label) of the joint mixture; ``start``: labels 0.. to begin from in place of the joint start."""
    blocks = packed(df, CHANNELS, block)
    if start is None:
        state = joint_start(blocks, config.k, config.seed)
        first = lambda x, v: mixture.statistics(x, np.eye(len(v) // 9)[mixture.joint_assigned(x, v.reshape(-1, 9))[0]])
        parts = summed(blocks, state.select("image_id", F.col("kept").alias("v")), 9, lambda x, v: first(x, v).ravel())
    else:
        k = start.agg(F.max("label")).first()[0] + 1
        rows = packed(df.drop("label").join(start, ["image_id", "pid"]), (*CHANNELS, "label"), block)
        of = rows.select("image_id").distinct().withColumn("v", F.array(F.lit(0.0)))
        parts = summed(rows, of, 10, lambda x, v: mixture.statistics(x[:, :9], np.eye(k)[x[:, 9].astype(int)]).ravel())
    parts = written(parts)

    def begin(table: pa.Table) -> np.ndarray:
        return sum(p.values.to_numpy() for p in table.column("s"))

    def sums(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        nll, p = mixture.posterior(x, mixture.components_of(v.reshape(-1, mixture.WIDE)))
        return np.append(nll, mixture.statistics(x, p).ravel()) if p is not None else np.zeros(1)

    def step(row: dict, s: np.ndarray) -> dict:
        stop = len(s) == 1 or (row["turn"] >= config.min_iterations and not s[0] < row["score"])
        if stop:
            return {"done": True}
        return {"kept": row["v"], "v": s[1:], "score": s[0], "done": row["turn"] + 1 >= max(config.max_iterations, 1)}

    state = iterate(blocks, _started(parts, begin), 9, sums, step)
    return labelled(blocks, state, 9, lambda x, v: _hard(x, v) + 1)


def _hard(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    _, p = mixture.posterior(x, mixture.components_of(v.reshape(-1, mixture.WIDE)))
    return np.zeros(len(x), int) if p is None else p.argmax(axis=1)


# Directions


def diametrical(blocks: DataFrame, config: DiametricalConfig) -> DataFrame:
    """State whose v has the axes (k, 3) of clusters of directions up to sign."""
    ones = blocks.select("image_id").distinct().withColumn("v", F.array(F.lit(0.0)))
    means = written(summed(blocks, ones, 3, lambda x, v: np.append(x.sum(axis=0), len(x))))

    def first(table: pa.Table) -> np.ndarray:
        s = sum(p.values.to_numpy() for p in table.column("s"))
        return mixture.first_axes(s[:3] / s[3], config)

    def sums(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        own, value = mixture.axis_assigned(x, v.reshape(-1, 3))
        return np.append(mixture.axis_scatter(x, own, len(v) // 3).ravel(), value)

    def step(row: dict, s: np.ndarray) -> dict:
        old = -np.inf if row["turn"] == 0 else row["score"]
        if s[-1] - old <= config.threshold:
            return {"done": True, "kept": row["v"]}
        new = mixture.moved_axes(row["v"].reshape(-1, 3), s[:-1].reshape(-1, 3, 3))
        return {"v": new.ravel(), "kept": new.ravel(), "score": s[-1], "done": row["turn"] + 1 >= config.max_iterations}

    return iterate(blocks, _started(means, first), 3, sums, step)


def diametrical_labels(df: DataFrame, config: DiametricalConfig, block: int = BLOCK) -> DataFrame:
    """(image_id, pid, label): the closest axis."""
    blocks = packed(df, NORMAL, block)
    return labelled(blocks, diametrical(blocks, config), 3, lambda x, v: mixture.axis_assigned(x, v.reshape(-1, 3))[0] + 1)


def watson_mixture(df: DataFrame, config: WatsonConfig, block: int = BLOCK) -> DataFrame:
    """(image_id, pid, label) of the Watson mixture, reduced to ``k`` components."""
    blocks = packed(df, NORMAL, block)
    axes = diametrical(blocks, DiametricalConfig(k=config.k_init, seed=config.seed))

    def hard(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        own, _ = mixture.axis_assigned(x, v.reshape(-1, 3))
        return mixture.watson_sums(x, np.eye(len(v) // 3)[own]).ravel()

    parts = written(summed(blocks, axes.select("image_id", F.col("kept").alias("v")), 3, hard))

    def begin(table: pa.Table) -> np.ndarray:
        return mixture.watson_parts(sum(p.values.to_numpy() for p in table.column("s")).reshape(-1, 7), hard=True)

    def sums(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return mixture.watson_sums(x, mixture.watson_posterior(x, v.reshape(-1, 7))).ravel()

    def step(row: dict, s: np.ndarray) -> dict:
        new, done = mixture.watson_parts(s.reshape(-1, 7)), row["turn"] + 1 >= config.iterations
        return {"v": new.ravel(), "kept": mixture.watson_reduced(new, config.k).ravel() if done else row["kept"], "done": done}

    state = iterate(blocks, _started(parts, begin), 3, sums, step)
    return labelled(blocks, state, 3, lambda x, v: mixture.watson_logs(x, v.reshape(-1, 7)).argmax(axis=1) + 1)
