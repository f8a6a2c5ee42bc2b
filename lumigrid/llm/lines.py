"""Operator 7: line dedup by winnowing over line hashes.

A text is the sequence of the hashes of its lines (white space at their ends does
not count).  A run of lines repeats if it stands in an earlier text, or earlier in
its own, and has ``LINES`` lines that are not blank or ``WORDS`` words, at least.

From each line on, and back from each line, the shortest stretch that is long
enough for a run is a window.  The least hash of its lines is its fingerprint: equal
windows have equal ones, so a window whose fingerprint stands in one place alone
is not repeated and goes no further.  Places that share a fingerprint are compared by all lines
of their windows to both sides (by 128 bits from two independent hashes of each line), for
the line may have stood elsewhere first in other surroundings.  A window with an earlier
equal is a repeated run, runs that overlap are one, and every line of a repeated run lies in a window within that run,
so deleting the repeated windows deletes the repeated runs and no more.  The
first holder stays whole unless it repeats something earlier.

Order is that of the key, then of a hash of the text.  Defined results: rows
with equal key and text count as one place, so they keep or lose the same lines;
a null key comes first; a null text stays null and an empty one empty; a
text all of whose lines go becomes empty; a very long text takes memory for the hashes of its
lines; an empty table gives no rows; extra columns are kept, one named like the
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm.common import BLANKS, WORD, small_batches, tidy, written

LINES, WORDS = 4, 50
FIRST_KEY = -(1 << 63)
#: Fingerprints are polynomials of the line hashes, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per text its place in the order (doc, mark), and hash and words of each line."""
    lines = F.split(text, "\n")
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    words = F.transform(trimmed, lambda x: F.regexp_count(x, F.lit(WORD)))
    return docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("long"), F.lit(FIRST_KEY)).alias("doc"),
        F.xxhash64(text).alias("mark"),
        *[F.transform(trimmed, lambda x: F.xxhash64(F.lit(seed), x)).alias(f"lines{seed}") for seed in range(2)],  # noqa: B023
        words.alias("words"),
    )


def windows(hashes: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and fingerprints (by each of the lines' hashes) of the windows of one text."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    full = np.concatenate([[0], np.cumsum(words > 0)])
    ends = np.minimum(np.searchsorted(sums, sums[:n] + WORDS), np.searchsorted(full, full[:n] + LINES))
    starts = np.maximum(np.searchsorted(sums, sums[1:] - WORDS, "right"), np.searchsorted(full, full[1:] - LINES, "right")) - 1
    there, back = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([there * (n + 1) + ends[there], starts[back] * (n + 1) + back + 1]))
    start, end = both // (n + 1), both % (n + 1)
    powers, inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, _INVERSE))
    uptos = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * powers[:n])]) for h in hashes]
    return start, end, *(((upto[end] - upto[start]) * inverses[start]).view(np.int64) for upto in uptos)


def minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the least value in each stretch, the last of equal ones, by tables of doubling width."""
    n, width = len(values), end - start
    best = np.arange(n)
    out = np.empty(len(start), np.int64)
    level = np.frexp(width.astype(float))[1] - 1  # floor of the binary logarithm
    for k in range(int(level.max(initial=0)) + 1):
        some = np.flatnonzero(level == k)
        one, other = best[start[some]], best[end[some] - (1 << k)]
        out[some] = np.where(values[one] < values[other], one, other)
        later = best[np.minimum(np.arange(n) + (1 << k), n - 1)]
        best = np.where(values[best] < values[later], best, later)
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and least line hash of its windows: in how many places that line stands, and those windows."""
    for batch in batches:
        for k in range(0, len(batch), 500):
            docs, marks, *hashes, words = batch.slice(k, 500).columns
            texts, least, places, cuts, parts = [], [], [], [0], []
            for t, (*x, w) in enumerate(zip(*(c.to_pylist() for c in (*hashes, words)))):
                lines, full = [np.array(h, np.int64) for h in x], np.array(w, np.int64)
                start, end, *prints = windows(lines, full)
                if not len(start):
                    continue
                at = minima(np.where(full > 0, lines[0], np.iinfo(np.int64).max), start, end)
                order = np.lexsort((at, lines[0][at]))
                value = lines[0][at][order]
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                new = np.concatenate([[True], at[order][1:] != at[order][:-1]])
                texts += [t] * len(first)
                least.append(value[first])
                places.append(np.add.reduceat(new, first))
                cuts += (cuts[-1] + np.append(first[1:], len(order))).tolist()
                parts.append([c[order] for c in (start, end - start, *prints)])
            at, empty = pa.array(texts, pa.int64()), np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([empty, *c]), pa.int64())) for c in (zip(*parts) if parts else [()] * 4)]
            rows = [docs.take(at), marks.take(at), *(pa.array(np.concatenate([empty, *c]), pa.int64()) for c in (least, places)), *lists]
            yield pa.RecordBatch.from_arrays(rows, ["doc", "mark", "least", "places", "at", "n", "print", "print1"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated windows (doc, mark, start, end): lines from start, before end, of a text."""
    texts = hashed(small_batches(docs), key, text).dropDuplicates(["doc", "mark"])
    lists = "at array<long>, n array<long>, print array<long>, print1 array<long>"
    found = written(texts.mapInArrow(tidy(_windows), f"doc long, mark long, least long, places long, {lists}"))
    shared = written(found.groupBy("least").agg(F.sum("places").alias("c")).where("c > 1").select("least"))
    met = found.join(shared.hint("merge"), "least", "left_semi")
    prints = written(met.select("doc", "mark", F.inline(F.arrays_zip("at", "n", "print", "print1"))))
    place = F.struct("doc", "mark", "at")
    firsts = written(prints.groupBy("print", "print1", "n").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("print", "print1", "n", "f"))
    met = prints.join(firsts, ["print", "print1", "n"]).where(place != F.col("f"))
    return met.select("doc", "mark", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that any of a text's spans holds."""
    for batch in batches:
        gone = []
        for starts, ends in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            size = max(ends) + 1
            gone.append(np.flatnonzero(np.cumsum(np.bincount(starts, minlength=size) - np.bincount(ends, minlength=size))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(gone, pa.list_(pa.int64()))], ["doc", "mark", "gone"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", deleted: str = "deleted") -> DataFrame:
    """``docs`` without repeated runs of lines, and ``deleted``: the places of the lines
    that went (empty for most texts; a column of that name is replaced)."""
    spans = repeats(docs, key, text).groupBy("doc", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    spans = spans.mapInArrow(tidy(_united), "doc long, mark long, gone array<long>")
    kept = [c for c in docs.columns if c != deleted]
    named = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)])
    old = F.col(f"_{kept.index(text)}")
    named = named.withColumns({"doc": F.coalesce(F.col(f"_{kept.index(key)}").cast("long"), F.lit(FIRST_KEY)), "mark": F.xxhash64(old)})
    rows = named.join(written(spans).hint("merge"), ["doc", "mark"], "left")
    lines = F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains("gone", i.cast("long")))
    new = F.when(F.col("gone").isNull() | old.isNull(), old).otherwise(F.array_join(lines, "\n"))
    gone = F.coalesce("gone", F.array().cast("array<long>"))
    return rows.select(*[(new if c == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(kept)], gone.alias(deleted))
