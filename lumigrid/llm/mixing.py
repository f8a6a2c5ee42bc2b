"""Operator 9: mixing sources to target weights by Poisson replication.

A source's rate is its target weight times all rows over its own rows.  Each
row draws its number of copies from the Poisson distribution with that mean, by
inverting the distribution function at a number hashed from its key and a seed;
so the expected mixture is the target mixture, and a row's copies depend on the
row and the counts alone.  A mean above ``PART`` is drawn as the sum of independent parts of that
mean at most, which has the same distribution: exp(-mean) would come to nothing.  Rows are exploded by their number of copies and
shuffled globally by a hash of key, copy and seed.  A row of more than ``COPIES`` copies is dealt
in blocks of so many first, so that no task makes all copies of the row of a rare source.

Defined results: rows with a null source are a source of their own; a source
without target weight gets weight 0; weights are scaled to sum to 1 over the
sources that have rows; a null text is mixed like any other; a null key hashes
as empty text; repeated rows draw alike; an empty table gives no rows; columns
named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this mean a rate is drawn as a sum of Poisson parts with this mean at most.
PART = 16.0
#: The distribution function of a part is inverted over this many steps; beyond, its mass is under 1e-16.
STEPS = 64
#: Copies of a row that one task makes.
COPIES = 1 << 16
#: Sources whose rates are small enough to send to all executors.
FEW = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def inverted(u: Column, mean: Column) -> Column:
    """The least k at which the Poisson distribution function exceeds ``u``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).cast("long").alias("k"))
    step = lambda s, i: F.struct(
        (s["p"] * mean / i).alias("p"),
        (s["sum"] + s["p"] * mean / i).alias("sum"),
        (s["k"] + F.when(s["sum"] <= u, 1).otherwise(0)).alias("k"),
    )
    return F.when(mean <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["k"]))


def rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", rate: float = 1.0) -> DataFrame:
    """Per source its rows and its mean number of copies.

    ``weights``: rows (source, weight); equal weights if there are none.
    ``rate``: copies to make per row of the whole table.
    """
    counts = docs.groupBy(F.col(source).alias("of")).agg(F.count("*").alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("w_of"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(w, F.col("of").eqNullSafe(F.col("w_of")), "left").select("of", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    mean = F.when(F.col("all_weight") > 0, rate * F.col("weight") / F.col("all_weight") * F.col("all_rows") / F.col("rows")).otherwise(0.0)
    return counts.crossJoin(sums).select("of", "rows", mean.alias("mean"))


def _exploded(rows: DataFrame, kept: list[str], far: bool) -> DataFrame:
    """Each row once for each of its copies; ``far``: some may have more than ``COPIES``."""
    upto = lambda low, high: F.explode(F.sequence(low, high)).alias("copy")
    one = F.lit(1).cast("long")
    near = rows.where(F.col("copies") <= COPIES) if far else rows
    out = near.select(*kept, "copies", upto(one, F.col("copies")))
    if far:
        blocks = rows.where(F.col("copies") > COPIES).select(*kept, "copies", F.explode(F.sequence(one * 0, F.expr(f"(copies - 1) div {COPIES}"))).alias("_block"))
        blocks = blocks.repartition(F.xxhash64(*[c for c, t in blocks.dtypes if "map" not in t]))
        first = F.col("_block") * COPIES
        out = out.unionByName(blocks.select(*kept, "copies", upto(first + 1, F.least(first + COPIES, F.col("copies")))))
    return out


def mixed(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", source: str = "source", seed: int = 7, rate: float = 1.0) -> DataFrame:
    """``docs`` replicated to the target mixture and shuffled; with ``copy`` (from 1),
    ``copies`` and ``shuffle_key``, the hash that the rows are dealt and sorted by.

    The rates are sent to all executors if there are ``FEW`` sources at most;
    else they are joined by a shuffle, whose skewed partitions Spark splits.
    """
    kept = [c for c in docs.columns if c not in ("copy", "copies", "shuffle_key")]
    found = rates(docs, weights, source, rate).select("of", "mean")
    few, largest = found.limit(FEW + 1).collect(), None
    if len(few) <= FEW:
        largest = max((r["mean"] for r in few), default=0.0)
        found = F.broadcast(docs.sparkSession.createDataFrame(few, found.schema))
    rows = docs.select(*kept).join(found, F.col(source).eqNullSafe(F.col("of"))).drop("of")
    parts = F.ceil(F.col("mean") / PART).cast("long")
    one = inverted(uniform(F.lit(seed), F.col(key)), F.col("mean"))
    more = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(parts, F.lit(1).cast("long"))),
        F.lit(0).cast("long"),
        lambda n, i: n + inverted(uniform(F.lit(seed), F.col(key), i), F.col("mean") / parts),
    )
    copies = F.when(F.col("mean") <= PART, one).otherwise(more)
    rows = rows.withColumn("copies", copies).where("copies > 0")
    rows = _exploded(rows, kept, largest is None or largest > COPIES // 2)
    mark = F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string")))
    dealt = rows.withColumn("shuffle_key", mark)
    return dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
