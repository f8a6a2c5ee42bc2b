"""Batches over many images: segment, evaluate and summarise by a configuration.

A configuration is a mapping as a YAML file of it would give:

    {"algorithms": {"CDNGraph": {"min_size": 200}, "JCSA": {"k": 8}}, "scale": 0.5}

An algorithm is its name, its parameters and the scale; its number is a hash of all three.  One job
segments all images by all algorithms that the store lacks: an image goes to a task once, which gives
the labels of each algorithm with its elapsed seconds, or its error as a row.  Results go to a
``Store``: the rows ``segmented`` and the labels; evaluation adds metric rows of what has none yet.
"""

from __future__ import annotations

import argparse
import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigrid.model import DiametricalConfig, GraphConfig, MixtureConfig, SpectralConfig, WatsonConfig, params
from lumigrid.operators import grid, metrics, regions
from lumigrid.operators.segment import attempted
from lumigrid.sources import store as stores
from lumigrid.sources.store import Store

ALGORITHMS = {"CDNGraph": GraphConfig, "JCSA": MixtureConfig, "GCF": SpectralConfig, "DepthWMM": WatsonConfig, "Diametrical": DiametricalConfig}
SEGMENTED = "image_id BIGINT, algorithm STRING, algorithm_id BIGINT, elapsed DOUBLE, error STRING"
METRICS = "image_id BIGINT, algorithm STRING, algorithm_id BIGINT, metric STRING, value DOUBLE"
KEY = ["image_id", "algorithm_id"]


def configs(config: Mapping) -> dict[str, object]:
    """Parameter records by algorithm; an unknown algorithm or parameter is an error."""
    return {name: ALGORITHMS[name](**(options or {})) for name, options in config["algorithms"].items()}


def store_id(name: str, record: object, scale: float = 1) -> int:
    """The algorithm's number: a hash of its name, parameters (functions by name and code) and scale."""
    given = {k: f"{v.__module__}.{v.__qualname__}:{v.__code__.co_code.hex()}:{v.__code__.co_consts}" for k, v in asdict(record).items() if callable(v) and hasattr(v, "__code__")}
    return int.from_bytes(hashlib.md5(f"{name}{sorted({**params(record), **given}.items())}{float(scale)}".encode()).digest()[:7], "big")


def algorithms(config: Mapping) -> list[tuple[str, int, object]]:
    """Name, number and parameters of each algorithm; an unknown algorithm or parameter is an error."""
    return [(name, store_id(name, record, config.get("scale", 1)), record) for name, record in configs(config).items()]


def _scaled(df: DataFrame, config: Mapping) -> DataFrame:
    scale = config.get("scale", 1)
    return df if scale == 1 else grid.resized_nearest(df, scale)


def _named(df: DataFrame, found: list[tuple[str, int, object]]) -> DataFrame:
    """(image_id, algorithm, algorithm_id, place) of each image and algorithm."""
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("algorithm"), F.lit(i).alias("algorithm_id"), F.lit(k).alias("place")) for k, (n, i, _) in enumerate(found)]))
    return df.select("image_id").distinct().select("image_id", of.alias("a")).select("image_id", "a.*")


def segment_batch(df: DataFrame, config: Mapping, store: Store) -> DataFrame:
    """Segments what the store lacks, in one job; images whose attempt failed are tried again.  Returns all rows ``segmented``."""
    found = algorithms(config)
    done = store.read("segmented", SEGMENTED).where(F.col("error").isNull())
    todo = store.kept(stores.missing(_named(df, found), done, KEY))
    if todo.limit(1).count():
        pixels = store.kept(_scaled(df.join(todo.select("image_id").distinct(), "image_id", "left_semi"), config))
        rows = store.kept(attempted(pixels, [r for _, _, r in found], todo.select("image_id", F.col("place").alias("algorithm"))))
        rows = rows.withColumnRenamed("algorithm", "place").join(F.broadcast(todo.select("place", "algorithm", "algorithm_id").distinct()), "place")
        labels = rows.where("pid IS NOT NULL").select("image_id", "algorithm_id", "pid", "label")
        means = regions.summary(pixels.drop("label").join(labels, ["image_id", "pid"]), ("image_id", "algorithm_id"))
        store.save_segments(labels, means)
        store.update("segmented", SEGMENTED, rows.where("pid IS NULL").select("image_id", "algorithm", "algorithm_id", "elapsed", "error"), KEY)
    store.dropped()
    return store.read("segmented", SEGMENTED)


def evaluate_batch(df: DataFrame, config: Mapping, store: Store) -> DataFrame:
    """Metric rows of the stored segmentations that have none, with and without ground truth, of all algorithms in one job.
    Returns all metric rows."""
    labels = None
    for name, number, _ in algorithms(config):
        one = store.labels(number)
        if one is None:
            raise LookupError(f"{name} with these parameters is not segmented at scale {config.get('scale', 1)}")
        one = one.select("image_id", "pid", "label", F.lit(name).alias("algorithm"), F.lit(number).alias("algorithm_id"))
        labels = one if labels is None else labels.unionByName(one)
    todo = stores.missing(labels.select("image_id", "algorithm", "algorithm_id").distinct(), store.read("metrics", METRICS), KEY)
    todo = store.kept(todo.withColumn("unit", F.monotonically_increasing_id()))
    if todo.limit(1).count():
        # an image and algorithm is a unit, which the metrics take for an image
        unit = lambda rows, on: rows.join(todo.select("unit", *on), on).drop(*on).withColumnRenamed("unit", "image_id")
        truth = store.kept(unit(_scaled(df, config), ["image_id"]))
        labels = unit(labels.drop("algorithm"), KEY)
        found = store.kept(truth.drop("label").join(labels, ["image_id", "pid"]))
        rows = metrics.supervised(found.select("image_id", "pid", "row", "col", "label"), truth, "").unionByName(metrics.unsupervised(found, ""))
        rows = rows.drop("algorithm").withColumnRenamed("image_id", "unit").join(todo, "unit").select(*[c.split()[0] for c in METRICS.split(", ")])
        store.update("metrics", METRICS, rows, [*KEY, "metric"])
    store.dropped()
    return store.read("metrics", METRICS)


def summarize(store: Store, config: Mapping | None = None) -> DataFrame:
    """Mean of each metric by algorithm, in order; of the configuration's algorithms if there is one."""
    rows = store.read("metrics", METRICS)
    if config is not None:
        rows = rows.where(F.col("algorithm_id").isin([i for _, i, _ in algorithms(config)]))
    return metrics.summarised(rows, ("algorithm", "algorithm_id", "metric")).orderBy("algorithm", "algorithm_id", "metric")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("step", choices=("segment", "evaluate", "summarize"))
    parser.add_argument("--config", required=True, help="JSON file of the configuration, with keys pixels and store")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    config = json.loads("\n".join(r["value"] for r in spark.read.text(given.config).collect()))
    store = Store(spark, config["store"])
    if given.step == "summarize":
        summarize(store, config).show(1000, False)
        return
    run = segment_batch if given.step == "segment" else evaluate_batch
    run(spark.read.parquet(config["pixels"]), config, store).show(1000, False)


if __name__ == "__main__":
    main()
