"""Operator 12: source divergence audit.

Which sources of a language speak differently from each other, and in which terms from
the language as a whole.  Terms are maximal runs of ASCII letters and non-ASCII characters,
A-Z in lower case.  A language keeps the terms that stand in ``least`` of its documents.
A group (language and source), and a language, gives each kept term the smoothed share
p = 1 + floor(10^9 (count + 1) / (N + V)); p diverges from q by floor((p - q)^2 / q).

Texts of a batch are one buffer of UTF-8 bytes.  A table of 256 entries maps each byte to
lower case or a boundary, so changes between the two are the terms' edges; slices are grouped
by xxHash and their bytes compared with those of the group's first, exactly (a slice that
differs gets a group of its own).  Each batch gives its counts by group and term, and
Spark adds them up.

The divergence of two groups is a sum over all kept terms, most of which neither has.
With f the divergence and a zero share p0 for each group, it is

    V f(p0, q0) + sum over p's terms of (f(p, q0) - f(p0, q0)) + sum over q's terms of (f(p0, q) - f(p0, q0))
    + sum over common terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).

The first two sums depend on a group's counts alone, so they go over its distinct
counts.  The last is taken in blocks of terms: a sparse matrix (CSR) of groups by
terms, in which each group's shares, spread out by term, meet all rows at once and
are added up by ``reduceat``.  All of it is integer arithmetic, without rounding.

Defined results: null text, language and source are ''; rows are documents each, repeated ones
too; a group without terms has its pairs and no terms; a language without
kept terms has pairs of value 0; equal values rank by the item's bytes; texts are
read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigrid.llm.common import tidy, written

#: Bytes of text that are cut at once, and cells (group, term) of a block, about (more where a language
#: has so many sources that a block's pairs would outnumber its cells, up to ``MOST``).
CHUNK, CELLS, MOST = 1 << 23, 1 << 16, 1 << 21
SCALE = 1_000_000_000
#: Each byte in lower case, or 0 where it parts terms.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms, and of each occurrence the term's place and the text's."""
    joined = b"\0".join(texts)
    low = LOWER[np.frombuffer(joined, np.uint8)]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low != 0
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    buffer = low.tobytes()
    slices = [buffer[i:j] for i, j in zip(start.tolist(), end.tolist())]
    mark = np.fromiter(map(xxhash.xxh3_64_intdigest, slices), np.uint64, len(slices))
    _, first, term = np.unique(mark, return_index=True, return_inverse=True)
    terms = [slices[i] for i in first.tolist()]
    size = end - start
    if (size != size[first][term]).any() or b"".join(slices) != b"".join([terms[t] for t in term.tolist()]):
        place: dict[bytes, int] = {}  # two terms share a hash
        term = np.fromiter((place.setdefault(s, len(place)) for s in slices), np.int64, len(slices))
        terms = list(place)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return terms, term, np.searchsorted(ends, start, "right")


def counted(texts: list[bytes], groups: np.ndarray, n_groups: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms; and of each (group, term) that occurs: both places, occurrences, and texts that hold it."""
    terms, term, text = terms_of(texts)
    t = max(len(terms), 1)
    held, n = np.unique(text * t + term, return_counts=True)
    cell, at = np.unique(groups[held // t] * t + held % t, return_inverse=True)
    docs = np.bincount(at, minlength=len(cell))
    sums = np.zeros(len(cell), np.int64)
    np.add.at(sums, at, n)
    return terms, cell // t, cell % t, sums, docs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch by group and term; a row without term says that there is such a group."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        texts, langs, sources = (batch.column(k) for k in range(3))
        place: dict[tuple[str, str], int] = {}
        group = np.array([place.setdefault(k, len(place)) for k in zip(langs.to_pylist(), sources.to_pylist())], np.int64)
        of = [pa.array(c, pa.string()) for c in zip(*place)]
        none = np.zeros(len(place), np.int64)
        yield pa.RecordBatch.from_arrays([*of, pa.nulls(len(place), pa.string()), pa.array(none), pa.array(none)], names)
        sizes = pa.compute.binary_length(texts).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, prepend=0)).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(batch)]):
            part = [t.as_buffer().to_pybytes() for t in texts[i:j]]
            terms, g, t, n, docs = counted(part, group[i:j], len(place))
            word = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(t))
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(g)) for x in of), word, pa.array(n), pa.array(docs.astype(np.int64))], names)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 n / total), three digits at a time so that nothing overflows."""
    found, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        scaled = rest * 1000
        found, rest = found * 1000 + F.floor(_div(scaled, total)), scaled % total
    return found + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays of longs."""
    found, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // total, rest % total
    return found + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def common_sums(group: np.ndarray, term: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the common terms of each pair of groups: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

    Cells of a sparse matrix: rows are ``group``, columns ``term``; ``total`` is N + V of the group.
    Returns the pair's groups and the sum, without pairs that have no common term.
    """
    order = np.lexsort((term, group))
    group, total = group[order], total[order]
    _, term = np.unique(term[order], return_inverse=True)
    q, q0 = shares(n[order] + 1, total), shares(np.ones(len(order), np.int64), total)
    names, row = np.unique(group, return_index=True)
    ends = np.append(row[1:], len(group))
    spread, here = np.zeros(int(term.max(initial=-1)) + 1, np.int64), np.zeros(int(term.max(initial=-1)) + 1, bool)
    a, b, sums = [], [], []
    for k, (i, j) in enumerate(zip(row.tolist(), ends.tolist())):
        spread[term[i:j]], here[term[i:j]] = q[i:j], True
        some = np.flatnonzero(here[term])
        p, p0, x, x0 = spread[term[some]], q0[i], q[some], q0[some]
        value = np.zeros(len(term), np.int64)
        value[some] = apart(p, x) - apart(p, x0) - apart(p0, x) + apart(p0, x0)
        met = np.zeros(len(term), np.int64)
        met[some] = 1
        found = np.flatnonzero(np.add.reduceat(met, row))
        a.append(np.full(len(found), names[k]))
        b.append(names[found])
        sums.append(np.add.reduceat(value, row)[found])
        here[term[i:j]] = False
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, sums))


def _common(block: pa.Table) -> pa.Table:
    columns = (block.column(c).to_numpy().astype(np.int64) for c in ("gid", "tid", "n", "total"))
    a, b, value = common_sums(*columns)
    other = a != b
    return pa.table({"a": a[other], "b": b[other], "value": value[other]})


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): see the module."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = rows.mapInArrow(tidy(_counts), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts)
    by_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    kept = by_lang.where(F.col("docs") >= least).select("lang", "term", "all")
    kept = written(kept.withColumn("tid", F.monotonically_increasing_id()))
    cells = counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept.hint("merge"), ["lang", "term"])
    cells = written(cells)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "all_n", "sum")])
    groups = groups.withColumns({"total": F.col("sum") + F.col("v"), "gid": F.monotonically_increasing_id()})
    groups = written(groups.withColumn("p0", F.when(F.col("total") > 0, _share(F.lit(1).cast("long"), F.col("total")))))
    named = cells.join(groups.select("lang", "source", "gid", "total", "v", "all_n"), ["lang", "source"])
    return _pairs(named, groups).unionByName(_terms(named, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(named: DataFrame, top: int) -> DataFrame:
    p, q = _share(F.col("n") + 1, F.col("total")), _share(F.col("all") + 1, F.col("all_n") + F.col("v"))
    rows = named.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(rows.select("lang", "source", "item", _apart(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= top)


def _pairs(named: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of each ordered pair of a language's groups; as many rows as the result."""
    ours = groups.select("lang", F.col("source"), F.col("gid").alias("a"), F.col("p0").alias("a0"), "v", F.col("total").alias("a_total"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("p0").alias("b0"), F.col("total").alias("b_total"))
    pairs = written(ours.join(others, "lang").where("a <> b"))
    neither = F.when(F.col("v") > 0, _apart(F.col("a0"), F.col("b0")))
    parts = pairs.select("a", "b", F.coalesce(F.col("v") * neither, F.lit(0)).alias("value"))
    counts = written(named.groupBy("gid", "n").agg(F.count("*").alias("terms")))
    p = _share(F.col("n") + 1, F.col("total"))
    for one, total, zero, other, pq in (("a", "a_total", "a0", "b0", lambda x: _apart(x, F.col("b0"))), ("b", "b_total", "b0", "a0", lambda x: _apart(F.col("a0"), x))):
        met = pairs.select("a", "b", "a0", "b0", F.col(total).alias("total"), F.col(one).alias("gid")).join(counts, "gid")
        value = F.col("terms") * (pq(p) - _apart(F.col("a0"), F.col("b0")))
        parts = parts.unionByName(met.groupBy("a", "b").agg(F.sum(value).alias("value")))
    cells = named.select("gid", "tid", "n", "total", "lang")
    sources = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = 1 + cells.count() // max(CELLS, min(sources * sources, MOST))
    both = cells.withColumn("block", F.pmod(F.xxhash64("tid"), F.lit(blocks))).groupBy("lang", "block").applyInArrow(_common, "a long, b long, value long")
    value = parts.unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    return _ranked(pairs.select("lang", "source", "item", "a", "b").join(value, ["a", "b"]).select("lang", "source", "item", "value"), "pair")
