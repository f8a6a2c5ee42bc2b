"""Connected components by contracting edges to least neighbours.

Labels and edges are tables in the shared folder; nothing goes to the driver
but whether edges are left.  A hub's messages are combined before the shuffle, and
both sides of each join are plain tables, so Spark can split a skewed key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): each node with ``label``, the least node that it is joined with.

    Nodes are longs.  Repeated edges, both directions and loops do no harm.  Each
    round sends every node to the least neighbour of its least neighbour and
    keeps the edges between different targets, so edges fall away quickly.
    """
    e = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or e.limit(1).count():
        ends = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        to = written(ends.groupBy(F.col("e.a").alias("node")).agg(F.min(F.least("e.a", "e.b")).alias("to")))
        far = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
        to = written(to.join(far, "to").select("node", F.col("next").alias("to")))
        old = labels
        if old is None:
            labels = to.withColumnRenamed("to", "label")
        else:
            via = to.withColumnRenamed("node", "via")
            labels = written(old.join(via, F.col("label") == F.col("via"), "left").select("node", F.coalesce("to", "label").alias("label")))
        left = e.join(to.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
        left = written(left.where("x != b")).join(to.withColumnRenamed("node", "b"), "b").select("x", F.col("to").alias("y")).where("x != y")
        e = written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


class Union:
    """Disjoint sets of 0..n-1, each named by its least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def join_all(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins all pairs at once: roots are hung on lower ones until no pair is apart."""
        while True:
            roots = self.roots()
            a, b = roots[x], roots[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        while (self.up != (up := self.up[self.up])).any():
            self.up = up
        return self.up
