"""Operator 13: ranked lexical search by inverted treaps.

Terms are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case.
N counts the documents with a term, L all their terms, n one document's, df the documents
that hold a term, tf its occurrences in one.  A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))),
a document has m = 50 + (50 n N) div L and the impact of a term in it is
w ((10^9 tf) div (1000 tf + 20 m)).  A document's score is the sum of its impacts over the
item's distinct terms.

A first job writes, for each document, the terms that some item asks for, as numbers, with tf and n;
sums over that table give N, L and df.  A second one cuts its part of the table into
shards of documents in the order of their ids.  A shard holds an inverted treap for each term: a
binary tree in search order of the documents and in heap order of the impacts, so
a subtree's root has its maximum.  For an item, the treaps of its terms are walked
together over halves of the range of documents: in each stretch every term stands at
the root of the subtree that lies in it, and where the roots' impacts add up to
less than the item's least of the ``k`` best so far, the stretch is dropped; a stretch of one
document has its exact score.  The most promising stretches go first, down to single documents,
which sets a high bar for the rest.  The bar is kept from shard to shard of a task; Spark ranks what the tasks found.

Items are taken in blocks of ``ITEMS``, so that what goes to the tasks is bounded.

Defined results: null texts have no terms and are never found, nor do they count in N; items
without terms find nothing; equal scores rank by ascending id, null ids last; repeated rows
and items are documents and items of their own (equal ids and scores rank next to each other); texts are read whole; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.common import tidy, written

#: Items whose terms are sent to the tasks at once; postings of a shard, about; stretches that are walked to the end first.
ITEMS, POSTINGS, BEAM = 4096, 1 << 21, 64
LAST = (1 << 63) - 1
#: Each byte in lower case, or a blank where it parts terms.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


@dataclass(frozen=True)
class Treaps:
    """Treaps over postings that are sorted by (term, document); places are those of the postings, -1 is none."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: dict[int, int]

    @classmethod
    def of(cls, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> Treaps:
        """The parent of a posting is the lesser of its nearest greater ones on either side, among its term's."""
        n = len(term)
        before, after = _greater(term, impact), n - 1 - _greater(term[::-1], impact[::-1], True)[::-1]
        before_impact = np.where(before >= 0, impact[before], -1)
        after_impact = np.where(after < n, impact[np.minimum(after, n - 1)], -1)
        up_left = (before >= 0) & ((after >= n) | (before_impact < after_impact))  # of equal impacts the first stands higher
        up_right = (after < n) & ~up_left
        left, right = np.full(n, -1), np.full(n, -1)
        places = np.arange(n)
        right[before[up_left]] = places[up_left]
        left[after[up_right]] = places[up_right]
        tops = places[~up_left & ~up_right]
        return cls(doc, impact, left, right, dict(zip(term[tops].tolist(), tops.tolist())))

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each node down to the root of its subtree's part in [low, high), all at once."""
        node = node.copy()
        on = np.flatnonzero(node >= 0)
        while len(on):
            doc = self.doc[node[on]]
            far, near = doc >= high[on], doc < low[on]
            off = far | near
            on, far = on[off], far[off]
            node[on] = np.where(far, self.left[node[on]], self.right[node[on]])
            on = on[node[on] >= 0]
        return node


def _greater(term: np.ndarray, impact: np.ndarray, strict: bool = False) -> np.ndarray:
    """Of each place the nearest before it, in the same term, with an impact that is at least as great (``strict``: greater); -1 is none."""
    g = np.arange(len(term)) - 1
    on = np.flatnonzero(g >= 0)
    while len(on):
        at = g[on]
        other = term[at] != term[on]
        g[on[other]] = -1
        less = impact[at] <= impact[on] if strict else impact[at] < impact[on]
        on = on[~other & less]
        g[on] = g[g[on]]
        on = on[g[on] >= 0]
    return g


class Best:
    """The k best (score, document) of an item so far; ``bar`` is the least score that may enter."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.bar = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        some = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[some], doc[some]
        if len(some) == self.k:
            self.bar = max(self.bar, int(self.score[-1]))


def walk(treaps: Treaps, terms: list[int], ids: np.ndarray, best: Best) -> int:
    """Adds a shard's documents that may be among the best; returns how many stretches were looked at."""
    roots = np.array([r for r in (treaps.root.get(t, -1) for t in terms) if r >= 0], np.int64)
    if not len(roots):
        return 0
    looked, impact = 0, np.append(treaps.impact, 0)  # -1 is the last

    def descend(nodes: np.ndarray, low: np.ndarray, high: np.ndarray, beam: int | None) -> tuple | None:
        """Halves the stretches until all are single documents; with a beam, follows the best and returns the others."""
        nonlocal looked
        rest = []
        while len(low):
            bound = impact[nodes].sum(axis=0)
            looked += len(low)
            on = bound >= best.bar
            if beam is not None and on.sum() > beam:
                some = np.flatnonzero(on)
                first = some[np.argsort(-bound[some], kind="stable")]
                later = first[beam:]
                rest.append((nodes[:, later], low[later], high[later]))
                on = np.sort(first[:beam])
            else:
                on = np.flatnonzero(on)
            nodes, low, high, bound = nodes[:, on], low[on], high[on], bound[on]
            single = high - low == 1
            if single.any():
                best.add(bound[single], ids[low[single]])
                nodes, low, high = nodes[:, ~single], low[~single], high[~single]
            middle = (low + high) // 2
            nodes, low, high = np.concatenate([nodes, nodes], axis=1), np.concatenate([low, middle]), np.concatenate([middle, high])
            flat = treaps.within(nodes.ravel(), np.tile(low, len(roots)), np.tile(high, len(roots)))
            nodes = flat.reshape(len(roots), -1)
            some = (nodes >= 0).any(axis=0)
            nodes, low, high = nodes[:, some], low[some], high[some]
        return rest

    start = np.zeros(1, np.int64)
    for part in descend(roots[:, None], start, start + len(ids), BEAM):
        descend(*part, None)
    return looked


def searched(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard: int = POSTINGS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents of a score above 0."""
    wanted = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t"))
    blocks = 1 + wanted.count() // ITEMS
    if blocks > 1:
        wanted = written(wanted)
    name = F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("t"))
    found = [_block(rows, wanted.where(name == b), k, shard) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _block(rows: DataFrame, wanted: DataFrame, k: int, shard: int) -> DataFrame:
    asked = [(r["item_id"], sorted(set(terms_of((r["t"] or "").encode("utf-8", "surrogatepass"))))) for r in wanted.collect()]
    words = sorted({w for _, ws in asked for w in ws})
    spark = rows.sparkSession
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = number.value
        for batch in batches:
            docs, sizes, starts, terms, tfs = [], [], [0], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                if found:
                    met = Counter(map(place.get, found))
                    met.pop(None, None)
                    docs.append(d)
                    sizes.append(len(found))
                    terms += met
                    tfs += met.values()
                    starts.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    notes = written(rows.mapInArrow(tidy(noted), "doc long, n long, terms array<int>, tfs array<long>"))
    documents, total = notes.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(words), np.int64)
    for r in notes.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    at = {w: i for i, w in enumerate(words)}
    queries = spark.sparkContext.broadcast((weight, [[at[w] for w in ws if weight[at[w]] > 0 and df[at[w]]] for _, ws in asked]))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, questions = queries.value
        best = [Best(k) for _ in questions]
        held, n = [], 0

        def search() -> None:
            t = pa.Table.from_batches(held).sort_by("doc").combine_chunks()
            ids = t.column("doc").combine_chunks().fill_null(LAST).to_numpy()
            terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            sizes = pa.compute.list_value_length(terms).to_numpy()
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
            doc = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + 50 * t.column("n").to_numpy() * documents // total
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            order = np.argsort(term, kind="stable")
            treaps = Treaps.of(term[order], doc[order], impact[order])
            for question, own in zip(questions, best):
                walk(treaps, question, ids, own)

        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n >= shard:
                search()
                held, n = [], 0
        if held:
            search()
        rows = [np.concatenate([x, *y]) for x, y in ((np.zeros(0, np.int64), c) for c in ([np.full(len(b.doc), i) for i, b in enumerate(best)], [b.doc for b in best], [b.score for b in best]))]
        doc = pa.array(rows[1], mask=rows[1] == LAST)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), doc, pa.array(rows[2])], ["at", "doc", "score"])

    found = notes.mapInArrow(tidy(ranked), "at int, doc long, score long").where("score > 0")
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], "at int, item_id long")  # ITEMS rows at most
    return found.join(F.broadcast(names), "at").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
