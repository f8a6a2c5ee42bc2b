"""Operator 1: n-gram Jaccard join by signature trees.

A text's set holds 64-bit hashes of its word n-grams.  Equal sets form a class.
Classes that share one of ``BANDS`` min-hash bands, directly or through others,
form a family, and each family is joined with itself by signature trees: leaves
hold exact bitmaps over the n-grams that at least two classes of the family
share, nodes the OR of their children's bitmaps and the range of their sizes.
Neighbours in the trees' order are compared first.  Then two trees are walked at
once; a pair of nodes is dropped when its sizes or the most n-grams that it can
share rule out every pair below, or when all below is joined already.  At the
leaves the count of shared bits is the size of the intersection, so links are
exact.  Families over ``BLOCK`` classes or ``BLOCK_GRAMS`` n-grams are joined
block by block.

A pair at the least similarity of 0.85 shares no band with a probability of 7e-11
(40 bands of 5; 1e-7 at 0.8), and that is the only way to lose a link.  Segments of
the sets, of which two linked ones must share one, lose none at all; but they
glue texts that share a passage into families of most of the corpus.

Defined results: a null text counts as empty; an empty set links with nothing;
fewer words than ``n`` make one n-gram; equal texts have one class; rows with
the same key are one node each but share the key's component; a null key is
kept and never the name of a component unless all members are null; an empty
table gives no rows; a very long text is one set in one task, in memory of some
40 bytes a word; extra columns are ignored.  Equality of n-grams and of whole
sets rests on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.common import small_batches, tidy, written
from lumigrid.llm.graph import Union, components

BANDS, ROWS = 40, 5
#: Classes, and n-grams, of a family that meet in one task, from each of two blocks.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
FANOUT = 8
#: Bits of a bitmap at most; with more shared n-grams several take one bit, and leaves are checked by their sets.
MOST_BITS = 1 << 15
#: Classes after which a task forgets which it has named, and words after which it starts its memo anew.
MEMO = 100_000
CHUNK = 1 << 15
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of hashed n-grams of texts; ASCII letters in lower case, words without ASCII white space."""

    def __init__(self, n: int):
        self.n, self.hashes = n, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.hashes) > MEMO:
            self.hashes.clear()
        w = np.array(list(map(self.hashes.__getitem__, words)), np.uint64)
        size = min(self.n, len(w))
        grams = w[: len(w) - size + 1].copy()
        for k in range(1, size):
            grams = mixed(grams) * _STEP + w[k : len(w) - size + 1 + k]
        return np.unique(mixed(grams + np.uint64(size)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band hashes of non-empty sets: one row each."""
    out, start = np.empty((len(sets), BANDS), np.uint64), 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (size == 0 or size + len(sets[stop]) <= CHUNK):
            size += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[start:stop])
        at = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        for b in range(BANDS):
            h = np.full(stop - start, b, np.uint64)
            for k in range(b * ROWS, b * ROWS + ROWS):
                h = mixed(h * _STEP + np.minimum.reduceat((x ^ _B[k]) * _A[k], at))
            out[start:stop, b] = h
        start = stop
    return out


def digest(s: np.ndarray) -> int:
    """The class of a set, as a signed number."""
    both = np.array([mixed(s + _STEP).sum(dtype=np.uint64)]) * _STEP + np.uint64(len(s))
    return int(mixed(both)[0].view(np.int64))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)


def classed(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Per row (doc, size, class) and the bands, which are left out where the task has met the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = Shingler(n), set()
        for batch in batches:
            for rows in _slices(batch):
                sets = [shingles(t) for t in rows.column(1).to_pylist()]
                names = [digest(s) for s in sets]
                new = [i for i, (c, s) in enumerate(zip(names, sets)) if len(s) and c not in met and not met.add(c)]
                found = dict(zip(new, bands([sets[i] for i in new]).view(np.int64))) if new else {}
                if len(met) > MEMO:
                    met.clear()
                lists = pa.array([found.get(i) for i in range(len(rows))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), lists], ["doc", "size", "class", "bands"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("t")).mapInArrow(tidy(run), "doc long, size long, class long, bands array<long>")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (band, class): each class with the least one of its band."""
    band, least = None, None
    for batch in batches:
        if not len(batch):
            continue
        s, c = (batch.column(k).to_numpy() for k in range(2))
        first = np.diff(s, prepend=s[0]).astype(bool)
        first[0] = band is None or s[0] != band
        starts = np.flatnonzero(first)
        at = np.cumsum(first) - 1
        heads = np.where(at >= 0, c[starts[np.maximum(at, 0)]] if len(starts) else 0, least if least is not None else 0)
        band, least = s[-1], heads[-1]
        pair = np.unique(np.stack([heads, c])[:, heads != c], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


class Tree:
    """A signature tree over rows of bitmaps, sorted so that alike ones lie together."""

    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray, group: np.ndarray):
        self.levels = [(bits, low, high, slack, group)]
        while len(self.levels[-1][0]) > FANOUT:
            bits, low, high, slack, group = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            first, last = np.minimum.reduceat(group, at), np.maximum.reduceat(group, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.where(first == last, first, -1)))


def dual(tree: Tree, percent: int, split: int, settle) -> None:
    """Walks the tree against itself and calls ``settle(i, j, most)`` with leaf pairs that
    may reach the similarity; ``most``: shared n-grams at most.  With a ``split``,
    only pairs of a leaf before it and one from it on."""
    level = len(tree.levels) - 1
    n = len(tree.levels[level][0])
    i, j = np.triu_indices(n)
    while True:
        bits, low, high, slack, group = tree.levels[level]
        width = FANOUT**level
        keep = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i]) & ((group[i] < 0) | (group[i] != group[j]))
        keep &= (i != j) if level == 0 else True
        if split:
            keep &= (i * width < split) & ((j + 1) * width > split)
        i, j = i[keep], j[keep]
        parts = []
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            most = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(slack[a], slack[b])
            fits = most * (100 + percent) >= percent * (low[a] + low[b])
            if level == 0:
                settle(a[fits], b[fits], most[fits])
            else:
                parts.append((a[fits], b[fits]))
        if level == 0 or not parts:
            return
        i, j = (np.concatenate(p) for p in zip(*parts))
        level -= 1
        n = len(tree.levels[level][0])
        step = np.arange(FANOUT)
        i = (i[:, None, None] * FANOUT + step[:, None] + 0 * step).ravel() if len(i) else i
        j = np.repeat(j, FANOUT * FANOUT) * FANOUT + np.tile(step, FANOUT * len(j)) if len(j) else j
        ok = (i < n) & (j < n) & (i <= j)
        i, j = i[ok], j[ok]


def joined(sets: list[np.ndarray], split: int, percent: int) -> Union:
    """Components of sets under links of at least ``percent``; with ``split``, of links across it alone.

    Neighbours in the order by size and least n-gram are compared first, so nodes whose leaves are
    all joined name their component and are not walked against each other.
    """
    sizes = np.array([len(s) for s in sets])
    side = np.arange(len(sets)) >= split if split else np.zeros(len(sets), bool)
    least = np.array([int(s[0]) for s in sets], np.uint64)
    order = np.lexsort((least, sizes, side))
    all_, inverse, count = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes[order])
    use = shared[inverse]
    width = int(shared.sum())
    m = max(64, min(MOST_BITS, -(-width // 64) * 64))
    row, bit = row[use], place[inverse[use]] % m
    bits = np.zeros((len(sets), m // 64), np.uint64)
    np.bitwise_or.at(bits, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    n = sizes[order]
    slack = np.bincount(row, minlength=len(sets)) - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    found = Union(len(sets))

    def settle(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> None:
        """Joins the pairs that are links; those in one component already are left out."""
        roots = found.roots()
        fits = (roots[i] != roots[j]) & (most * (100 + percent) >= percent * (n[i] + n[j]))
        for a, b, k in zip(i[fits].tolist(), j[fits].tolist(), most[fits].tolist()):
            if found.root(a) != found.root(b):
                if width > m:
                    k = len(np.intersect1d(sets[order[a]], sets[order[b]], assume_unique=True))
                if k * (100 + percent) >= percent * (int(n[a]) + int(n[b])):
                    found.join(a, b)

    first = int((~side).sum()) if split else 0
    for step in (1, 2, 4):
        i = np.arange(len(sets) - step)
        i = i[(i < first) & (i + step >= first)] if split else i
        settle(i, i + step, np.bitwise_count(bits[i] & bits[i + step]).sum(axis=1, dtype=np.int64) + np.minimum(slack[i], slack[i + step]))
    dual(Tree(bits, n, n, slack, found.roots().copy()), percent, first, settle)
    out = Union(len(sets))
    for a, b in enumerate(found.roots().tolist()):
        out.join(int(order[a]), int(order[b]))
    return out


def linked(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc, size of its set, class, and ``component``, the least key
    that it reaches by links of Jaccard similarity ``percent`` / 100 or more."""
    rows = written(classed(docs, n, key, text))
    banded = rows.where("bands is not null").select(F.explode("bands").alias("band"), "class")
    banded = banded.repartition("band").sortWithinPartitions("band", "class")
    families = components(banded.mapInArrow(tidy(_stars), "a long, b long")).select(F.col("node").alias("class"), F.col("label").alias("family"))
    keys = rows.groupBy("class").agg(F.min("doc").alias("least"))
    one = written(rows.where("size > 0").groupBy("class").agg(F.min("doc").alias("doc"), F.max("size").alias("size")).join(families, "class"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    large = one.groupBy("family").agg(blocks.alias("blocks")).where("blocks > 1")
    one = written(one.join(large, "family", "left").select("class", "doc", "family", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("t"))
    wanted = texts.join(one.hint("merge"), "doc").select("t", "class", "family", "blocks")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The class of each text that no key names."""
        shingles = Shingler(n)
        for batch in batches:
            for rows_ in _slices(batch):
                classes = [digest(shingles(t)) for t in rows_.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), rows_.column(0)], ["class", "t"])

    lone = texts.where("doc IS NULL AND t IS NOT NULL").select("t").mapInArrow(tidy(named), "class long, t string").groupBy("class").agg(F.first("t").alias("t"))
    wanted = wanted.unionByName(lone.join(one.where("doc IS NULL").hint("merge"), "class").select("t", "class", "family", "blocks"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The set of each class, once for each pair of blocks that it takes part in."""
        shingles = Shingler(n)
        for batch in batches:
            for rows_ in _slices(batch):
                out = []
                for t, c, f, k in zip(*(x.to_pylist() for x in rows_.columns)):
                    s = shingles(t)
                    if digest(s) == c:
                        own = c % k
                        out += [(f, min(own, b), max(own, b), int(own > b), c, s.tobytes()) for b in range(k)]
                columns = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["family", "i", "j", "side", "class", "grams"])

    def walked(group: pa.Table) -> pa.Table:
        classes, first = np.unique(group.column("class").to_numpy(), return_index=True)
        side = group.column("side").to_numpy()[first]
        diagonal = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        order = np.lexsort((classes, side))
        grams = group.column("grams")
        sets = [np.frombuffer(grams[int(first[k])].as_py(), np.uint64) for k in order]
        names, split = classes[order], 0 if diagonal else int((side == 0).sum())
        if len(sets) < 2 or (not diagonal and split in (0, len(sets))):
            roots = np.arange(len(sets))
        else:
            roots = joined(sets, split, percent).roots()
        return pa.table({"a": pa.array(names[roots], pa.int64()), "b": pa.array(names, pa.int64())}).filter(pa.array(roots != np.arange(len(sets))))

    edges = wanted.mapInArrow(tidy(dealt), "family long, i int, j int, side int, class long, grams binary")
    edges = edges.groupBy("family", "i", "j").applyInArrow(walked, "a long, b long")
    parts = components(edges).select(F.col("node").alias("class"), "label")
    names = written(keys.join(parts, "class", "left").select("class", "least", F.coalesce("label", "class").alias("label")))
    named = written(names.groupBy("label").agg(F.min("least").alias("component")))
    names = written(names.join(named, "label").select("class", "component"))
    out = rows.select("doc", "size", "class").join(names, "class")
    return out.select("doc", "size", "class", F.when(F.col("size") == 0, F.col("doc")).otherwise(F.col("component")).alias("component"))
