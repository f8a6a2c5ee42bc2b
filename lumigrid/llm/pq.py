"""Operator 2: embedding near-dedup by product quantisation.

Vectors are scaled to length 1.  A coarse quantiser deals them to inverted
lists.  A list keeps of each vector a code of its residual, one byte for each of
``PARTS`` subspaces, and how far the code is off in each of them.  A query probes
every list whose cell its neighbourhood can reach: with r the largest distance of
a pair to be found, those whose bisecting plane with the query's own cell is
nearer than r.  A pair is found from either side, so lists before the query's own
are left out.  In a list the distances from the query to all codes come from one
table per query and subspace (asymmetric).  In each subspace query and vector are
apart by the distance to the code less what the code is off, at least; vectors
for which these add up to r at most are candidates, so no pair is lost, and
candidates are ranked by their exact cosine in double precision.

Equal vectors of one label are one class with a count, known by 128 bits.  A list
over ``BLOCK`` vectors is searched in blocks, so no task grows with a list.
Vectors are dealt in the type that they come in, codes stand beside them.  The
quantisers are fitted on a sample of ``SAMPLE`` classes, or four for each list if that is
more; there are half as many lists as the root of the classes; all are indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing; vectors of different
lengths never link; rows with a null id are nodes of their own that share the
component name null; repeated rows link with each other; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.common import written
from lumigrid.llm.graph import Union, components

PARTS, CODES = 8, 64
#: Classes that the quantisers are fitted on at least, and vectors of a list in a task.
SAMPLE, BLOCK = 16_384, 2048
#: Rows whose distances to all centres are held at once; more than such distances, from norms and products, are off.
ROWS, SLACK = 512, 1e-6


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        square = np.einsum("ij,ij->i", centres, centres)
        own = np.concatenate([(square - 2 * x[i : i + ROWS] @ centres.T).argmin(axis=1) for i in range(0, len(x), ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centres, and codebooks of the residuals by subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, lists)
        own = np.concatenate([self.nearest(sample[i : i + ROWS])[0] for i in range(0, len(sample), ROWS)])
        residual = sample - self.centres[own]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.books = [_kmeans(residual[:, c], CODES) for c in self.cuts]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", self.centres, self.centres) - 2 * x @ self.centres.T
        return d.argmin(axis=1), np.maximum(d, 0)

    def probes(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each row, and the mask of all lists that its neighbourhood reaches."""
        own, d = self.nearest(x)
        gap = _apart(self.centres[own], self.centres) + SLACK
        return own, d - d[np.arange(len(x)), own][:, None] <= 2 * gap * (r + 1e-9) + SLACK

    def coded(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by subspace, and how far each is off."""
        codes, off = np.empty((len(residual), len(self.cuts)), np.uint8), np.empty((len(residual), len(self.cuts)), np.float32)
        for k, (c, book) in enumerate(zip(self.cuts, self.books)):
            d = _apart(residual[:, c], book)
            codes[:, k] = d.argmin(axis=1)
            off[:, k] = d[np.arange(len(d)), codes[:, k]]
        return codes, off

    def least(self, residual: np.ndarray, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The least square of the distance from each query to each vector, by table look-up."""
        out = np.zeros((len(residual), len(codes)), np.float32)
        for k, (c, book) in enumerate(zip(self.cuts, self.books)):
            gap = _apart(residual[:, c], book).astype(np.float32)[:, codes[:, k]]
            gap -= off[:, k]
            gap *= gap
            out += gap
        return out


def _apart(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", book, book) - 2 * x @ book.T
    return np.sqrt(np.maximum(square, 0))


def _rows(column) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``vectors``: node, n_links (other rows at cosine ``least`` or more with
    the same label), component (least key reached), kept."""
    r = sqrt(max(0.0, 2 - 2 * least)) + 1e-7
    single = dict(vectors.dtypes)[vector] == "array<float>"
    v = F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("node"), F.col(label).cast("string").alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    plain = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))
    names = [F.xxhash64(F.lit(k), F.col("label"), plain) for k in range(2)]
    rows = written(rows.withColumns({f"name{k}": F.when(F.col("sound"), x) for k, x in enumerate(names)}))
    both = ["name0", "name1"]
    classes = rows.where("sound").groupBy(*both).agg(F.count("*").alias("n"), F.min("node").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes.withColumns({"class": F.monotonically_increasing_id(), "d": F.size("v")}))
    sizes = [x["d"] for x in classes.select("d").distinct().collect()]
    found = None
    for d in sizes:
        one = _linked(classes.where(F.col("d") == d), least, r, sample, "float" if single else "double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component"), F.lit(True).alias("kept"))
    found = written(found)
    counts = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    parts = components(found.where("links = 0").select("a", "b"))
    named = classes.select(*both, "class", "n", "least").join(counts, F.col("class") == F.col("a"), "left").drop("a")
    named = named.join(parts, F.col("class") == F.col("node"), "left")
    named = written(named.select(*both, "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "class").alias("part")))
    leasts = written(named.groupBy("part").agg(F.min("least").alias("component")))
    named = written(named.join(leasts, "part").select(*both, "n_links", "component"))
    out = rows.select("node", *both).join(named, both, "left")
    component = F.when(F.col("n_links").isNull(), F.col("node")).otherwise(F.col("component"))
    return out.select("node", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"))


def indexed(classes: DataFrame, quantiser: Quantiser, r: float, kind: str) -> DataFrame:
    """Each vector in its list, with code and what the code is off, and as a query (without them)
    in all later lists that it probes."""
    arrow = pa.list_(pa.float32() if kind == "float" else pa.float64())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "list", "class", "n", "codes", "off", "v"]
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                x = _unit(_rows(part.column(3)))
                own, mask = quantiser.probes(x, r)
                codes, off = quantiser.coded(x - quantiser.centres[own])
                i, j = np.nonzero(mask & (np.arange(mask.shape[1]) >= own[:, None]))
                member, at = own[i] == j, pa.array(i)
                texts = [[bytes(y[k]) if m else None for k, m in zip(i, member)] for y in (codes, off)]
                columns = [part.column(0).take(at), pa.array(j, pa.int32()), part.column(1).take(at), part.column(2).take(at), *(pa.array(t, pa.binary()) for t in texts), part.column(3).take(at).cast(arrow)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("label", "class", "n", "v").mapInArrow(dealt, f"label string, list int, class long, n long, codes binary, off binary, v array<{kind}>")


def _linked(classes: DataFrame, least: float, r: float, sample: int, kind: str) -> DataFrame:
    """Rows (a, b, links): link counts of class a with links > 0, and joining edges with links = 0."""
    total = classes.count()
    lists = max(1, int(sqrt(total)) // 2)
    sample = max(sample, 4 * lists)
    some = classes if total <= sample else classes.where(F.pmod(F.xxhash64("class"), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    found = some.select("v").limit(2 * sample).toArrow().column("v")
    quantiser = Quantiser(_unit(_rows(found if len(found) else classes.select("v").limit(1).toArrow().column("v"))), lists)
    flat = written(indexed(classes, quantiser, r, kind))
    member = F.col("codes").isNotNull()
    sizes = flat.groupBy("label", "list").agg(F.sum(member.cast("int")).alias("members"), F.count("*").alias("queries")).where("members > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    placed = flat.join(written(sizes.select("label", "list", blocks("members").alias("mb"), blocks("queries").alias("qb"))), ["label", "list"])
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spread = F.xxhash64("class")
    own_q, own_m = F.pmod(F.shiftright(spread, 20), F.col("qb")), F.pmod(spread, F.col("mb"))
    bare = F.lit(None).cast("binary")
    as_query = placed.select("label", "list", own_q.alias("q"), all_of("mb").alias("m"), "class", "n", member.alias("here"), bare.alias("codes"), bare.alias("off"), "v")
    as_member = placed.where(member).select("label", "list", all_of("qb").alias("q"), own_m.alias("m"), "class", "n", F.lit(True).alias("here"), "codes", "off", "v")
    units = as_query.unionByName(as_member)

    def searched(unit: pa.Table) -> pa.Table:
        kept = unit.column("codes").is_valid()
        q, m = unit.filter(pa.compute.invert(kept)), unit.filter(kept)
        if not len(q) or not len(m):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        centre, parts = quantiser.centres[unit.column("list")[0].as_py()], len(quantiser.cuts)
        codes = np.frombuffer(b"".join(m.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
        off = np.frombuffer(b"".join(m.column("off").to_pylist()), np.float32).reshape(-1, parts)
        xq, xm = _unit(_rows(q.column("v"))), _unit(_rows(m.column("v")))
        cq, cm, nq, nm = (t.column(c).to_numpy() for c in ("class", "n") for t in (q, m))
        here = q.column("here").to_numpy()
        names, at = np.unique(np.concatenate([cq, cm]), return_inverse=True)
        aq, am = at[: len(cq)], at[len(cq) :]
        links, join = np.zeros(len(names), np.int64), Union(len(names))
        for start in range(0, len(xq), 256):
            x = xq[start : start + 256]
            i, j = np.nonzero(quantiser.least(x - centre, codes, off) <= (r + 1e-4) ** 2)
            once = ~here[i + start] | (cq[i + start] < cm[j])  # two vectors of one list meet twice
            i, j = i[once], j[once]
            exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 50_000]], xm[j[k : k + 50_000]]) >= least for k in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
            i, j = i[exact] + start, j[exact]
            np.add.at(links, aq[i], nm[j])
            np.add.at(links, am[j], nq[i])
            join.join_all(aq[i], am[j])
        roots = join.roots()
        far, some_ = np.flatnonzero(roots != np.arange(len(names))), np.flatnonzero(links)
        return pa.table({"a": np.concatenate([names[some_], names[far]]), "b": np.concatenate([names[some_], names[roots[far]]]), "links": np.concatenate([links[some_], np.zeros(len(far), np.int64)])})

    return units.groupBy("label", "list", "q", "m").applyInArrow(searched, "a long, b long, links long")
