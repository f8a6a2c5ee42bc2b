"""Pixel frames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 20


def _grid(e: DataFrame, rows: DataFrame) -> DataFrame:
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(9)]
    norm = F.sqrt(v[6] * v[6] + v[7] * v[7] + v[8] * v[8])
    out = rows.select(
        "image_id",
        "row",
        "col",
        "h",
        *[v[i].alias(f"c{i + 1}") for i in range(3)],
        v[3].alias("x"),
        v[4].alias("y"),
        (v[5] + 2).alias("z"),
        *[(v[6 + i] / norm).alias(n) for i, n in enumerate(("nx", "ny", "nz"))],
        "label",
    )
    pid = ((F.col("col") - 1) * F.col("h") + F.col("row")).cast("long")
    return out.withColumn("pid", pid).select("image_id", "pid", "row", "col", "c1", "c2", "c3", "x", "y", "z", "nx", "ny", "nz", "label")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image of 20 columns from ``embeddings``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    height = e.agg(F.expr("count(*) div 20").alias("h"))
    rows = e.crossJoin(height).select("*", F.lit(0).cast("long").alias("image_id"), F.expr("cast(vec_id div 20 + 1 as int)").alias("row"), F.expr("cast(vec_id % 20 + 1 as int)").alias("col"))
    return _grid(e, rows)


def pixels_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 10 by 10 pixels from ``embeddings``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(
        "*",
        F.expr("vec_id div 100").alias("image_id"),
        F.expr("cast(vec_id % 100 div 10 + 1 as int)").alias("row"),
        F.expr("cast(vec_id % 100 % 10 + 1 as int)").alias("col"),
        F.lit(10).alias("h"),
    )
    return _grid(e, rows)


def pixels_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 25 by 40 pixels from ``events``: one colour, depth and label."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.expr("event_id div 1000").alias("image_id"),
        F.expr("cast(event_id % 1000 % 40 * 25 + event_id % 1000 div 40 + 1 as bigint)").alias("pid"),
        F.expr("cast(event_id % 1000 div 40 + 1 as int)").alias("row"),
        F.expr("cast(event_id % 1000 % 40 + 1 as int)").alias("col"),
        (F.col("value").cast("double") / 500).alias("c1"),
        (1 + F.col("value").cast("double") / 100).alias("z"),
        F.expr("cast(user_id % 8 + 1 as int)").alias("label"),
    )


def blocky(df: DataFrame, out: str = "label") -> DataFrame:
    """``df`` with a labelling by blocks of 5 by 5 pixels."""
    return df.withColumn(out, F.expr("cast((row div 5) * 4 + (col div 5) as int)"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (image_id, algorithm, metric, value), some without value, from ``events``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("image_id"),
        F.col("event_type").alias("algorithm"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("metric"),
        F.when(F.col("event_id") % 11 != 0, F.col("value").cast("double")).alias("value"),
    )
